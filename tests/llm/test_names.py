"""Every stage with columns that have the names which operators use inside."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, language_id, licenses, mixing, ngram_join, quality_rules, textscan, toxicity
from tests.llm.helpers import docs, invented, labels, sentence

INTERNAL = [
    "__id", "__at", "__maybe", "__gone", "__several", "__word", "__bits", "__place", "__lang", "__logit", "__threshold", "__kept", "__row", "__n_words",
    "__rule", "__base_failed", "__features", "__own", "__hash", "__cell", "__prefix", "__n", "__count", "__group", "__order", "__known", "__before", "id", "row",
    "h", "h2", "key", "label", "at", "words", "good", "part", "lang_pred", "proportions", "predicted", "taken", "copies", "ids", "decoded",
]


def corpus(spark, n=120):
    rng, vocabulary = random.Random(12), invented(12)
    rows = [(i, sentence(rng, vocabulary, rng.randint(55, 90)) + (" vile hateful" * 6 if i % 3 == 0 else ""), "en" if i % 2 else "de", "ab"[i % 2]) for i in range(n)]
    rows += [(None, "without an id", "en", None), (5, None, None, "a")]
    frame = docs(spark, rows)
    for name in INTERNAL:
        frame = frame.withColumn(name, F.lit("own"))
    return frame, labels(spark, [(i, int(i % 3 == 0)) for i in range(n)], "toxic"), labels(spark, [(i, int(i % 2)) for i in range(n)], "quality")


def unchanged(frame, whole):
    assert frame.columns == whole.columns
    return frame.count() > 0 and frame.filter(" OR ".join(f"`{c}` <> 'own'" for c in INTERNAL)).count() == 0


@pytest.mark.parametrize("stage", ["toxic", "poor", "duplicates", "mixed"])
def test_stages_return_the_columns_they_were_given(spark, stage):
    whole, toxic, quality = corpus(spark)
    frame = {
        "toxic": lambda: toxicity.drop_toxic(whole, toxic),
        "poor": lambda: quality_rules.drop_poor(whole, quality),
        "duplicates": lambda: ngram_join.drop_near_duplicates(whole),
        "mixed": lambda: mixing.emit(whole),
    }[stage]()
    assert unchanged(frame, whole)


def test_operators_that_add_columns(spark):
    whole, toxic, _ = corpus(spark, 60)
    model = language_id.learn(whole, F.lit(True))
    predicted = language_id.predict(model, whole)
    assert {r.lang_pred for r in predicted.collect()} <= {"en", "de", "und"}
    scored = toxicity.score(toxicity.train(whole, toxic), whole)
    assert scored.filter("score BETWEEN 0 AND 1").count() == 62 and scored.filter("__logit <> 'own' OR __lang <> 'own'").count() == 0
    measured = quality_rules.with_statistics(whole)
    assert measured.filter("__n_words > 40").count() == 60
    assert licenses.scan(whole).count() == 0
    from millrace.llm.queries import vocabulary_text

    assert bpe.encode_digests(whole, vocabulary_text()).filter("n_tokens > 0").count() == 61


def test_a_labelled_id_with_very_many_rows(spark):
    """What reaches the driver is one row for each labelled id."""
    rng, vocabulary = random.Random(13), invented(13)
    rows = [(i, sentence(rng, vocabulary, 60 + i)) for i in range(20)]
    many = docs(spark, rows).union(docs(spark, rows[:1]).crossJoin(spark.range(5000).select()))
    quality = labels(spark, [(i, i % 2) for i in range(20)], "quality")
    collected = []
    frame = type(many)
    inner = frame.toPandas
    frame.toPandas = lambda self: collected.append(inner(self)) or collected[-1]
    try:
        quality_rules.learn(quality_rules.with_statistics(many), quality)
    finally:
        frame.toPandas = inner
    assert [len(t) for t in collected] == [20]


def test_more_languages_than_a_model_holds_are_refused(spark):
    frame = docs(spark, [(i, "some text", f"l{i}") for i in range(language_id.LANGUAGES + 1)])
    with pytest.raises(ValueError, match="more than"):
        language_id.learn(frame, F.lit(True))


def test_long_words_are_hashed_as_short_ones_are(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(14)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    lengths = np.array([1, 63, 64, 65, 66, 4095, 4096, 4097, 8192, 8193, 20_000, 100])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    found = textscan.hashes(data, starts, lengths)
    monkeypatch.setattr(textscan, "_STEPS", 10**9)
    assert found.tolist() == textscan.hashes(data, starts, lengths).tolist()


def test_a_word_of_twenty_megabytes_takes_seconds():
    import time

    import pyarrow as pa

    text = pa.array(["x" * 20_000_000 + " y"])
    started = time.perf_counter()
    data, bounds = textscan.utf8(text)
    starts, lengths, _ = textscan.spans(data, bounds, textscan.SPACE)
    assert len(textscan.hashes(data, starts, lengths)) == 2
    assert time.perf_counter() - started < 15
