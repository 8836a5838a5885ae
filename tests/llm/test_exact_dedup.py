from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace import workspace
from millrace.llm import exact_dedup
from tests.llm.helpers import docs


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_OUT", 8)


def expected(rows):
    groups = defaultdict(list)
    for name, text, *_ in rows:
        groups[text or ""].append(name)
    out = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i), reverse=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.update((x, ids[0], len(ids), n == 0, digest) for n, x in enumerate(ids))
    return out


def found(frame):
    assert frame.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return Counter(tuple(r) for r in frame.collect())


ODD = [
    (1, "one"), (2, "one"), (2, "one"), (2, "two"), (3, "One"), (4, "one "), (5, None), (6, ""), (None, "one"), (None, "none"), (None, "none"),
    (7, "x" * 300_000), (8, "x" * 300_000), (9, "x" * 299_999), (10, "é"), (11, "é"), (12, "\x00"), (None, None), (-4, "two"),
]


@pytest.mark.parametrize("table_bytes", [60, 1 << 20])
def test_any_table_size_gives_the_same_groups(spark, table_bytes):
    rows = ODD + [(100 + i, f"text {i % 37}") for i in range(200)]
    assert found(exact_dedup.exact_duplicates(docs(spark, rows, 7), table_bytes=table_bytes)) == expected(rows)


def test_full_tables_spill_and_spilled_records_are_partitioned_again(spark, monkeypatch):
    rounds = []
    inner = exact_dedup._round
    monkeypatch.setattr(exact_dedup, "_round", lambda *a: rounds.append(1) or inner(*a))
    rows = [(i, f"text number {i % 300}") for i in range(700)]
    assert found(exact_dedup.exact_duplicates(docs(spark, rows), table_bytes=200)) == expected(rows)
    assert len(rounds) > 2


def test_crowded_contents_are_compared_in_parts_first(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MANY_COPIES", 5)
    monkeypatch.setattr(exact_dedup, "HELD_ROWS", 4)  # so that a task sends many copies on
    rows = [(i, "the same" if i % 3 else f"text {i % 50}") for i in range(600)]
    assert found(exact_dedup.exact_duplicates(docs(spark, rows, 5))) == expected(rows)
    assert found(exact_dedup.exact_duplicates(docs(spark, rows, 5), table_bytes=30)) == expected(rows)


def test_equal_hashes_are_told_apart_by_content(spark):
    table = exact_dedup.Table(1000, slots=4)
    assert [table.find(7, c) for c in (b"a", b"b", b"a", b"b", b"c")] == [(0, True), (1, True), (0, False), (1, False), (2, True)]
    for i in range(100):
        assert table.find(i << 32, b"%d" % i) == (3 + i, True)
    assert all(table.find(i << 32, b"%d" % i) == (3 + i, False) for i in range(100))
    full = exact_dedup.Table(3)
    assert full.find(1, b"large text") == (0, True)
    assert full.find(2, b"") == (-1, False)
    assert full.find(1, b"large text") == (0, False)


def test_empty_table_other_columns_and_normalised_texts(spark):
    assert found(exact_dedup.exact_duplicates(docs(spark, []))) == Counter()
    rows = docs(spark, [(1, "One"), (2, "one"), (3, None)])
    for name in ("node", "hash", "root", "ids", "digest", "copies", "best", "place", "wins", "id", "__maybe", "__at", "keep_id", "kept"):
        rows = rows.withColumn(name, F.lit("own"))
    assert found(exact_dedup.exact_duplicates(rows)) == expected([(1, "One"), (2, "one"), (3, None)])
    lowered = exact_dedup.exact_duplicates(rows, text_col=F.lower("text"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in lowered.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}


def test_a_content_reaches_a_bucket_once_for_each_task(spark):
    rows = docs(spark, [(i, "hot" if i % 3 == 0 else f"{i}") for i in range(9000)], 4)
    exact_dedup.exact_duplicates(rows)
    folder = workspace.shared_folder(spark)
    newest = max((p for p in Path(folder.removeprefix("file:")).rglob("spill-*") if p.is_dir()), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(str(newest)).filter(F.col("size") == 3).count() <= 4 + 1000  # "hot" and three-digit numbers
