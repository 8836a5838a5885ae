from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id
from tests.llm.helpers import SMALL, docs, sentence

ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ñopéqrst"}


def vocabulary(lang):
    rng = random.Random(lang)
    return ["".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(200)]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, vocabulary(lang), 60), lang) for i, lang in enumerate(sorted(ALPHABETS) * 20)]
    rows += [(100, None, "aa"), (101, "abc", None)]
    return language_id.learn(docs(spark, rows), F.lit(True))


def found(spark, model, rows):
    result = language_id.predict(model, docs(spark, rows))
    assert result.columns[:4] == ["doc_id", "text", "lang", "source"] and "size" in result.columns
    return {r.doc_id: r for r in result.collect()}


def test_pure_and_mixed_texts(spark, model):
    rng = random.Random(2)
    a, b = (sentence(rng, vocabulary(x), 300) for x in ("aa", "cc"))
    rows = found(spark, model, [(1, a), (2, b), (3, a + " " + b + " " + b), (4, (a + " ") * 60)])
    assert (rows[1].lang_pred, rows[2].lang_pred, rows[4].lang_pred) == ("aa", "cc", "aa")
    assert rows[1].score > 0.99 and list(rows[1].proportions) == ["aa"]
    assert rows[3].lang_pred == "cc" and set(rows[3].proportions) == {"aa", "cc"}
    assert rows[3].proportions["cc"] == pytest.approx(2 / 3, abs=0.05)
    assert sum(rows[3].proportions.values()) == pytest.approx(1)


def test_texts_without_letters(spark, model):
    rows = found(spark, model, [(1, None), (2, ""), (3, "12 34 !?"), (4, "x"), (None, "abc")])
    assert [(rows[i].lang_pred, rows[i].score, rows[i].proportions) for i in (1, 2, 3)] == [("und", 0.0, None)] * 3
    assert rows[4].lang_pred in ALPHABETS and 0 < rows[4].score <= 1
    assert rows[None].lang_pred == "aa"


def test_nothing_to_learn_from(spark):
    empty = language_id.learn(docs(spark, []), F.lit(True))
    assert empty.names == ()
    assert found(spark, empty, [(1, "abc")])[1].lang_pred == "und"
    assert language_id.predict(empty, docs(spark, [])).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 3)
    model = language_id.learn(docs(spark, [(i, "abc", "aa") for i in range(50)]), F.lit(True))
    assert (model.shares[:, 0] > model.shares[:, 0].min() * 1.5).sum() == 3  # " ab", "abc", "bc "


def test_expectation_maximisation_against_a_grid(model):
    import numpy as np

    rng = random.Random(3)
    text = sentence(rng, vocabulary("aa"), 80) + " " + sentence(rng, vocabulary("bb"), 40)
    grams, counts = next(language_id._profiles(pa.array([text])))
    shares = model.shares[grams][:, :2]
    weights, reached = language_id._proportions(shares, counts, np.array([0.5, 0.5]))
    grid = [(counts @ np.log(shares @ np.array([p, 1 - p])), p) for p in np.linspace(0.001, 0.999, 999)]
    assert reached == pytest.approx(max(grid)[0], rel=1e-4)
    assert weights[0] == pytest.approx(max(grid)[1], abs=0.02)


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    told = language_id.predict(language_id.learn(rows, ~held), rows.filter(held))
    right, n = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95
