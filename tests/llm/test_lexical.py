from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical, textscan
from tests.llm.helpers import docs, invented, sentence

ITEMS = "item_id long, text string, rank string, score string, nth string"


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def expected(rows, items, k=20):
    split = [(r[0], terms(r[1])) for r in rows]
    documents, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(x for _, t in split for x in set(t))
    out = Counter()
    for item, text in items:
        ranked = []
        for name, own in split:
            tf, m, score = Counter(own), 0, 0
            for x in terms(text):
                if x in tf:
                    m = 75 + (25 * len(own) * documents) // total
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1)))
                    score += w * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m))
            if score:
                ranked.append((-score, name is None, name if name is not None else 0, name))
        out.update((item, n + 1, r[3], -r[0]) for n, r in enumerate(sorted(ranked)[:k]))
    return out


def found(spark, rows, items, **how):
    frame = lexical.search(docs(spark, rows), asked(spark, items), **how)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(frame.dtypes)["rank"] == "int" and dict(frame.dtypes)["score"] == "bigint"
    return Counter(tuple(r) for r in frame.collect())


def asked(spark, items):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in items], ITEMS).repartition(2)


def corpus(seed, n=300):
    rng, words = random.Random(seed), invented(seed, 60)
    rows = [(i, sentence(rng, words, rng.randint(0, 40))) for i in range(n)]
    return rows, [(i, sentence(rng, words, rng.randint(1, 12))) for i in range(15)]


@pytest.mark.parametrize("k", [1, 3, 20, 1000])
def test_equals_the_formula(spark, k):
    rows, items = corpus(5)
    assert found(spark, rows, items, k=k) == expected(rows, items, k)


def test_blocks_of_documents_and_of_queries_change_nothing(spark, monkeypatch):
    rows, items = corpus(6)
    whole = expected(rows, items, 4)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 20)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 30)
    spark_rows = docs(spark, rows).coalesce(1)
    frame = lexical.search(spark_rows, asked(spark, items), k=4)
    assert Counter(tuple(r) for r in frame.collect()) == whole


ODD = [
    (1, "A-b_c a'B"), (2, None), (3, ""), (4, "..."), (5, "É é Ünï x1y2"), (6, "é"), (None, "a b"), (7, "a b"), (8, "a b"), (8, "a b"),
    (9, "b " * 5000), (10, "z" * 100_000), (11, "x\x00y\x7fz"), (12, "naïve naïve İ"),
]


def test_odd_texts_ties_and_repeated_rows(spark):
    items = [(1, "a B"), (2, None), (3, ""), (4, "!?"), (5, "é É"), (6, "z" * 100_000 + " x"), (1, "b b b"), (None, "naïve"), (7, "absent")]
    got, want = found(spark, ODD, items, k=3), expected(ODD, items, 3)
    assert got == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == Counter()
    assert found(spark, [(1, "a")], []) == Counter()
    assert found(spark, [(1, None)], [(1, "a")]) == Counter()


def test_other_columns_do_not_matter(spark):
    rows, items = docs(spark, [(1, "a b"), (2, "a")]), asked(spark, [(1, "b a")])
    for name in ("id", "n", "terms", "tfs", "nth", "item", "term", "df", "rank"):
        rows, items = rows.withColumn(name, F.lit("own")), items.withColumn(name, F.lit("own"))
    assert Counter(tuple(r) for r in lexical.search(rows, items).collect()) == expected([(1, "a b"), (2, "a")], [(1, "b a")])


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(textscan, "hashes", lambda data, starts, lengths: lengths.astype(np.uint64))
    known = lexical._Dictionary(["ab", "cd", "xyz"])
    raw = b"ab cd ef xyz xyy"
    data = np.frombuffer(raw, np.uint8)
    _, starts, lengths, _ = lexical._terms(pa.array([raw.decode()]))
    words, numbers = known.find(data, starts, lengths)
    assert list(zip(words.tolist(), numbers.tolist())) == [(0, 0), (1, 1), (3, 2)]


def test_no_accumulators_are_made_once_the_bounds_are_too_low(monkeypatch):
    """A rare term decides, so documents that hold only the common one get none."""
    rows = [(i, "rare common" if i < 30 else "common" if i < 1000 else "other") for i in range(2000)]
    held = [[0, 1] if i < 30 else [0] if i < 1000 else [] for i in range(2000)]
    block = pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows]),
            pa.array([len(r[1].split()) for r in rows]),
            pa.array([np.array(x, "<u4").tobytes() for x in held], pa.binary()),
            pa.array([np.ones(len(x), "<u4").tobytes() for x in held], pa.binary()),
        ],
        ["id", "n", "terms", "tfs"],
    )
    made = []
    inner = lexical.Postings._kth
    monkeypatch.setattr(lexical.Postings, "_kth", lambda self, at, k: made.append(len(at)) or inner(self, at, k))
    weights = [math.floor(1000 * math.log(4002 / (2 * df + 1))) for df in (1000, 30)]
    lists = lexical.Postings(block, np.array(weights), 2000, 2030)
    at, scores = lists.best(np.array([1, 0]), np.array([1, 1]), 20)
    assert made == [30]  # the 30 with the rare term, and none after them
    assert Counter((1, n + 1, rows[x][0], s) for n, (x, s) in enumerate(zip(at.tolist(), scores.tolist()))) == expected(rows, [(1, "common rare")])


def test_documents_are_put_together_up_to_a_block(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    parts = [
        pa.RecordBatch.from_arrays([pa.array(range(s, s + 3)), pa.array([b"\0\0\0\0"] * 3, pa.binary())], ["id", "terms"]) for s in range(0, 30, 3)
    ]
    blocks = list(lexical._blocks(iter(parts)))
    assert [b.num_rows for b in blocks] == [6] * 5
    assert [i for b in blocks for i in b.column("id").to_pylist()] == list(range(30))
