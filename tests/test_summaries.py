from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pathlib import Path
from pyspark.sql import functions as F

from millrace import workspace
from millrace.operators import segments, zorder
from millrace.streaming import sketches

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    """Three independent columns, one of them text, with nulls and a value of a third of the rows."""
    made = spark.range(0, 20000, 1, 8).withColumns(
        {
            "a": F.when(F.col("id") % 3 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000))).otherwise(F.lit(500)),
            "b": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 7,
            "c": F.when(F.col("id") % 50 != 0, F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8)),
            "day": F.lit("2024-01-01").cast("date"),
        }
    )
    return workspace.written(made, "points")


def touched(path, column, low, high):
    """Row groups that a filter cannot skip by their least and greatest value."""
    count = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            count += stats is None or not stats.has_min_max or (stats.min <= high and stats.max >= low)
    return count, total


def test_every_column_skips_files(spark, conf, points):
    conf("spark.sql.shuffle.partitions", "64")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    laid, linear = workspace.fresh_path(spark, "z"), workspace.fresh_path(spark, "linear")
    zorder.write_clustered(points, laid, COLUMNS, 400)
    segments.write_segments(points, linear, "day", 400, COLUMNS)
    for column, low, high in (("a", 100, 120), ("b", 20.0, 24.0), ("c", "30", "33")):
        z, n = touched(laid, column, low, high)
        assert z < n / 2, (column, z, n)
        if column != "a":
            assert z < touched(linear, column, low, high)[0]
    kept = spark.read.schema(points.schema).parquet(laid)
    assert kept.exceptAll(points).count() == 0 and kept.count() == points.count()
    sizes = kept.groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] <= 400


def test_a_hot_value_is_cut(spark, conf):
    conf("spark.sql.shuffle.partitions", "16")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    hot = spark.range(8000).withColumns({"a": F.lit(1), "b": F.lit("x")})
    path = workspace.fresh_path(spark, "hot")
    zorder.write_clustered(hot, path, ["a", "b"], 100_000)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] < 8000 / 4


def test_cells_are_ordered_and_interleaved(spark):
    rows = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "x int, y int")
    cuts = {"x": [1.0, 2.0, 3.0], "y": [1.0, 2.0, 3.0]}
    found = {(r.x, r.y): r[zorder.Z_KEY] for r in zorder.with_key(rows, ["x", "y"], cuts, 2).collect()}

    def interleaved(x, y):
        return sum((x >> b & 1) << 2 * b + 1 | (y >> b & 1) << 2 * b for b in range(2))

    assert found == {(x, y): interleaved(x, y) for x in range(4) for y in range(4)}
    with pytest.raises(ValueError):
        zorder.with_key(rows, ["x"] * 8, cuts)


def test_texts_keep_their_order(spark):
    texts = sorted(["", "a", "a\x01", "ab", "abc", "b", "zebra", "é", "日本"], key=lambda t: t.encode())
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.o for r in rows.withColumn("o", zorder.ordinal(rows, "t")).collect()}
    assert [found[t] for t in texts] == sorted(found.values())


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, None), (1, "x")], "a int, b string")
    for frame, n in ((rows, 2), (rows.limit(0), 0), (rows.filter("a IS NULL"), 1)):
        path = workspace.fresh_path(spark, "few")
        zorder.write_clustered(frame, path, ["a", "b"], 10)
        assert spark.read.schema(rows.schema).parquet(path).count() == n


def test_merged_sketches_are_near(spark):
    rows = spark.range(40000).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("event_type"),
        (F.col("id") % 5000).alias("user_id"),
        F.when(F.col("id") % 1000 != 1, F.col("id").cast("double")).otherwise(F.lit(float("nan"))).alias("value"),
    )
    parts = workspace.written(sketches.sketched(rows), "parts")
    found = {r.event_type: r for r in sketches.answers(sketches.merged(parts, ["event_type"]), {"p50": 0.5, "p99": 0.99}).collect()}
    for kind, n in (("hot", 13334), ("cold", 26666)):
        assert found[kind].n == n
        assert abs(found[kind].n_users - 5000) <= 5000 * 4 * sketches.DISTINCT_ERROR
        assert abs(found[kind].p50 - 20000) <= 40000 * 2 * sketches.RANK_ERROR
        assert abs(found[kind].p99 - 39600) <= 40000 * 2 * sketches.RANK_ERROR


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([], "at timestamp, event_type string, user_id bigint, value double")
    assert sketches.answers(sketches.merged(sketches.sketched(rows), ["event_type"]), {"p50": 0.5}).collect() == []
    odd = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS at, CAST(NULL AS STRING) AS event_type, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS DOUBLE) AS value")
    row = sketches.answers(sketches.merged(sketches.sketched(odd), ["event_type"]), {"p50": 0.5}).first()
    assert (row.n, row.n_users, row.p50) == (1, 0, None)
