from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity
from tests.llm.helpers import docs, invented, labels, sentence

BAD = ["zzbad", "qqfoul"]


def corpus(n=260, seed=1):
    rng, vocabulary = random.Random(seed), invented(9)
    rows, marks = [], []
    for i in range(n):
        text = sentence(rng, vocabulary, rng.randint(20, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text), "xx"))
        marks.append((i, int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def model(spark):
    rows, marks = corpus()
    return toxicity.train(docs(spark, rows), labels(spark, marks, "toxic"))


def test_unseen_texts(spark, model):
    rows, marks = corpus(seed=2)
    result = toxicity.score(model, docs(spark, rows))
    assert "lang" in result.columns and result.schema["score"].dataType.simpleString() == "double"
    told = {r.doc_id: r for r in result.collect()}
    right = sum(told[i].predicted == m for i, m in marks)
    assert right / len(marks) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in told.values())


def test_whole_texts_count(spark, model):
    filler = " ".join(invented(9)[:300])
    long = (filler + " ") * 900  # more words than are taken at a time
    rows = [(1, long), (2, long + BAD[0]), (3, BAD[0] + " " + long), (4, filler + " " + BAD[1].upper() + "! " + filler)]
    told = {r.doc_id: r.predicted for r in toxicity.score(model, docs(spark, rows)).collect()}
    assert told == {1: 0, 2: 1, 3: 1, 4: 1}


def test_parts_of_a_long_text_give_what_the_whole_gives(model, monkeypatch):
    words, first = toxicity._words(pa.array([" ".join(invented(3)), "", None, "one", " ".join(invented(9))]))
    whole = toxicity._logits(model.network, words, first)
    stretches = toxicity._stretches
    monkeypatch.setattr(toxicity, "_stretches", lambda first, filled, step: stretches(first, filled, 37))
    assert toxicity._logits(model.network, words, first) == pytest.approx(whole, abs=1e-4)


def test_convolution_against_plain_loops(model):
    network = model.network
    texts = [invented(5)[:9], ["alone"], invented(6)[:4]]
    words, first = toxicity._words(pa.array([" ".join(t) for t in texts]))
    embedded = toxicity._embedded(network, toxicity._buckets(words))
    plain = []
    for s, e in zip(first[:-1], first[1:]):
        pooled = []
        for width in toxicity._WIDTHS:
            at = [sum(embedded[i + o] @ network.filters[width][o] for o in range(width) if i + o < e) for i in range(s, e)]
            pooled.append(np.max(at, axis=0))
        plain.append(np.tanh(np.concatenate(pooled) + network.bias) @ network.out + network.base)
    assert toxicity._logits(network, words, first) == pytest.approx(plain, abs=1e-4)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (5, 9, 7, 6)]
    target = np.array([1, 0, 1, 0], np.float32)
    network = toxicity._started(texts, target, rng)

    def loss():
        words, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        logits = toxicity._logits(network, words, first)
        return float(np.mean(np.log1p(np.exp(-np.where(target > 0, logits, -logits)))))

    rates = {"tables": np.full(network.tables.shape, 1e-3, np.float32), "bias": np.full(network.bias.shape, 1e-2, np.float32)}
    rates |= {"out": np.full(network.out.shape, 1e-2, np.float32)} | {w: np.full(f.shape, 1e-2, np.float32) for w, f in network.filters.items()}
    before = loss()
    for _ in range(20):
        toxicity._step(network, rates, [toxicity._buckets(t) for t in texts], target, np.ones(4, np.float32))
    assert loss() < before / 2


def test_odd_texts_and_tables(spark, model):
    rows = [(1, None), (2, ""), (3, "?!"), (None, "words here")]
    told = {r.doc_id: r for r in toxicity.score(model, docs(spark, rows)).collect()}
    assert told[1].score == told[2].score == told[3].score and told[1].predicted == 0
    assert toxicity.score(model, docs(spark, [])).count() == 0


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, None), (None, 1)], [(i, 0) for i in range(9)]])
def test_without_both_labels_everything_scores_nothing(spark, marks):
    rows = [(i, "some words") for i in range(9)]
    model = toxicity.train(docs(spark, rows), labels(spark, marks, "toxic"))
    assert {(r.score, r.predicted) for r in toxicity.score(model, docs(spark, rows)).collect()} == {(0.0, 0)}


def test_a_giant_labelled_text_pushes_no_other_out(spark):
    """It comes first by each hash of its id, and has more words than were once learned from in all."""
    rows, marks = corpus()
    name = F.col("id").cast("string")
    drawn, ordered = F.pmod(F.xxhash64(name, F.lit(6)), F.lit(1 << 40)), F.xxhash64(name, F.lit(7))
    least = spark.range(len(rows)).agg(F.min(drawn), F.min(ordered)).first()
    giant = spark.range(1000, 3_000_000).filter((drawn < least[0]) & (ordered < least[1])).first().id
    frame = docs(spark, [*rows, (giant, "word " * 3_000_001, "xx")])
    model = toxicity.train(frame, labels(spark, [*marks, (giant, 0)], "toxic"))
    assert model.network is not None
    rows, marks = corpus(seed=2)
    told = {r.doc_id: r.predicted for r in toxicity.score(model, docs(spark, rows)).collect()}
    assert sum(told[i] == m for i, m in marks) / len(marks) > 0.95


def test_long_texts_are_learned_from_all_over():
    words = np.arange(1_000_003, dtype=np.uint64)
    kept = toxicity._spread(words)
    assert len(kept) == toxicity.TEXT_WORDS and (np.diff(kept.astype(np.int64)) > 0).all()
    assert np.histogram(kept, 10, (0, len(words)))[0].min() >= toxicity.TEXT_WORDS // 10 - 2 * toxicity.RUN
    assert all(len(toxicity._spread(words[:n])) == n for n in (0, 7, toxicity.TEXT_WORDS))


def test_thresholds_are_set_with_all_labelled_rows_not_trained_with(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    greek = str.maketrans("abcdefghijklmnoprstuvw", "αβγδεζηθικλμνξοπρστυφχ")
    rows, marks = corpus(1600)
    rows = [(i, text.translate(greek) + " zzbad" * m, "yy") if i // 4 % 8 == 0 else (i, text, lang) for (i, text, lang), (_, m) in zip(rows, marks)]
    frame, marked = docs(spark, rows), labels(spark, marks, "toxic")
    counted, by_cell = [], toxicity._by_cell
    monkeypatch.setattr(toxicity, "_by_cell", lambda *given: counted.append(by_cell(*given)) or counted[0])
    model = toxicity.train(frame, marked)
    # A fifth of 100 rows of either label is held; a language with an eighth of the rows has few among them.
    assert set(model.thresholds) == {"xx", "yy"}
    seen = counted[0].groupby("label")["n"].sum()
    assert seen.to_dict() == {0: 1200 - 80, 1: 400 - 80}
    # Cells are fine enough: rows are on the side that the exact logits would put them.
    told = toxicity.score(model, frame).join(marked, "doc_id")
    assert told.filter("predicted = toxic").count() > 0.95 * len(rows)


def test_five_thousand_rows_of_a_label_less_a_fifth_are_learned_from(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "_fit", lambda texts, truth: fitted.extend(truth) or toxicity._started(texts, truth, np.random.default_rng(0)))
    rows = [(i, f"word{i % 7} zz{i % 2}", "xx") for i in range(10_400)]
    toxicity.train(docs(spark, rows), labels(spark, [(i, i % 2) for i, *_ in rows], "toxic"))
    assert (fitted.count(0), fitted.count(1)) == (4000, 4000)


def test_cells_hold_the_exact_logits(spark, model):
    rows, marks = corpus(seed=2)
    ids = labels(spark, marks, "label").withColumnRenamed("doc_id", "__id")
    texts = docs(spark, [*rows, (None, "no id", "xx"), (5000, "no label", "xx")]).selectExpr("doc_id AS __id", "text")
    cells = toxicity._by_cell(model, texts, ids)
    words, first = toxicity._words(pa.array([text for _, text, _ in rows]))
    exact = np.sort(toxicity._logits(model.network, words, first))
    step = float(2 * np.abs(model.network.out).sum() / toxicity.CELLS)
    assert np.repeat(np.sort(cells["logit"]), cells["n"].to_numpy()[np.argsort(cells["logit"], kind="stable")]) == pytest.approx(exact, abs=step)


def test_threshold_makes_the_fewest_mistakes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        logits, truth = np.round(rng.normal(size=40), 1), rng.random(40) < 0.4
        weights = rng.uniform(0.5, 3, 40)

        def cost(cut):
            return (weights * ((logits >= cut) != truth)).sum()

        cut = toxicity._threshold(logits, truth, weights)
        assert cost(cut) == pytest.approx(min(cost(x) for x in [*logits, logits.max() + 1]))


def test_filter_keeps_clean_documents_and_all_columns(spark):
    rows, marks = corpus()
    frame = docs(spark, rows + [(None, None), (999, "")])
    kept = toxicity.drop_toxic(frame, labels(spark, marks, "toxic"))
    assert kept.columns == frame.columns
    gone = {i for i, _, *_ in rows} - {r.doc_id for r in kept.collect()}
    toxic = {i for i, m in marks if m}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 0.03 * len(rows)
    assert kept.filter("doc_id IS NULL OR doc_id = 999").count() == 2


def test_held_out_rows_of_the_tables(spark):
    rows, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(rows, marks, ~held)
    told = toxicity.score(model, rows.filter(held)).join(marks, "doc_id")
    right, n = told.agg(F.count_if(F.col("toxic") == F.col("predicted")), F.count("*")).first()
    assert right / n > 0.93
