from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import entities
from millrace.schemas import MERGED_CHANGES


def test_derived_fields_count_distinct_members(spark):
    rows = spark.createDataFrame(
        [(["a", "b", "a"], [], 1000, 4500), (None, ["x"], 2000, None)],
        "authors array<string>, reviewers array<string>, createdTimeMillis bigint, mergedTimeMillis bigint",
    )
    derived = entities.with_derived_fields(rows)
    assert [(r.numAuthors, r.numReviewers, r.elapsedTimeMillis) for r in derived.collect()] == [(2, 0, 3500), (None, 1, None)]
    assert "numCommitters" not in derived.columns


def test_merged_changes_have_the_declared_fields(spark):
    at = dt.datetime(2024, 1, 1, 12)
    events = spark.createDataFrame(
        [(7, "view", at), (7, "click", at + dt.timedelta(seconds=90)), (7, "view", at), (8, "view", at)],
        "user_id bigint, event_type string, ts timestamp_ntz",
    )
    wide = entities.merged_changes(events)
    assert wide.schema.names == MERGED_CHANGES.struct().names
    row = {r.userId: r for r in wide.collect()}["7"]
    assert (row.labels, row["count"], row.numAuthors, row.elapsedTimeMillis) == (["click", "view"], 3, 2, 90_000)
    assert (row.title, row.reviewers, row.numReviewers) == ("", [""], None)


def test_members_are_counted_once_per_row(spark):
    rows = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],), (None,)], "tags array<string>")
    counted = entities.count_members(rows, "tags", n=F.count("*"))
    assert {(r.member, r.n) for r in counted.collect()} == {("a", 2), ("b", 1)}
