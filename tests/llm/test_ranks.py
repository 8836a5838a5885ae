from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import ranks


def numbered(rows, strata=("s",), **how):
    hashed = ranks.with_hash(rows, F.col("id"))
    return ranks.numbered(hashed, hashed, "g", list(strata), [F.col("id")], "n", **how)


def test_numbers_follow_stratum_and_hash_without_gaps(spark):
    rows = spark.range(3000, numPartitions=5).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "small").alias("g"), (F.col("id") % 4).alias("s")
    )
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.g].append((r.s, hashlib.md5(str(r.id).encode()).hexdigest(), r.id))
    expected = {x[2]: i for own in groups.values() for i, x in enumerate(sorted(own), 1)}
    found = numbered(rows)
    assert found.columns == ["id", "g", "s", "__hash", "n"]
    assert {r.id: r.n for r in found.collect()} == expected


def test_no_task_holds_a_hot_group(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")  # so few rows would be broadcast themselves
    rows = spark.range(4000, numPartitions=4).select("id", F.lit("hot").alias("g"))
    held = numbered(rows, ()).groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.max("n").alias("last")).collect()
    assert max(r["rows"] for r in held) < 1000 and max(r["last"] for r in held) == sum(r["rows"] for r in held) == 4000


def test_what_is_known_of_groups_comes_along(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, g string")
    known = spark.createDataFrame([("a", 5), (None, 6)], "g string, extra int")
    assert {r.id: r.extra for r in numbered(rows, (), known=known).collect()} == {1: 5, 2: 5, 3: 6}


def test_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a")] * 5 + [(None, "a")] * 2, "id long, g string")
    assert sorted(r.n for r in numbered(rows, ()).collect()) == list(range(1, 8))
    assert numbered(rows.limit(0), ()).count() == 0
