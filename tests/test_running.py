from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import percentiles, running, segments

ROWS_SCHEMA = "g string, o bigint, v bigint"


def hot_rows(n=4000):
    """A third of the rows in one group, some without a group, and many small groups."""
    picked = random.Random(5)
    groups = ["hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{picked.randrange(200)}" for i in range(n)]
    return [(g, i, picked.randrange(-50, 100) if i % 13 else None) for i, g in enumerate(groups)]


def expected_running(rows):
    seen, result = {}, set()
    totals = {}
    for g, _, v in rows:
        totals[g] = totals.get(g, 0) + (v or 0)
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + (v or 0)
        result.add((g, o, seen[g], totals[g]))
    return result


def computed_running(spark, rows):
    frame = spark.createDataFrame(rows, ROWS_SCHEMA).repartition(5)
    done = running.running_total(frame, ["g"], [F.col("o")], {"run": F.col("v")}, totals=True)
    assert done.columns == ["g", "o", "v", "run", "run_total"]
    collected = [(r.g, r.o, r.run, r.run_total) for r in done.collect()]
    assert len(collected) == len(rows)
    return set(collected)


def test_running_total_of_hot_group(spark):
    rows = hot_rows()
    assert computed_running(spark, rows) == expected_running(rows)


def test_rows_are_shuffled_once_and_nothing_is_counted_ahead(spark, monkeypatch):
    """Building the plan writes the slices and runs no other job over the rows; reading
    them back shuffles sums of slices only."""
    frame = spark.createDataFrame(hot_rows(), ROWS_SCHEMA).repartition(5)
    for eager in ("first", "collect", "count", "take"):
        monkeypatch.setattr(type(frame), eager, lambda *a, **k: pytest.fail("a job ran while the plan was built"))
    done = running.running_total(frame, ["g"], [F.col("o")], {"run": F.col("v")}, totals=True)
    found = percentiles.exact_percentiles(frame, ["g"], "v", {"mid": 0.5})
    segments.assign_segments(frame, ["g"], "o", 50)
    monkeypatch.undo()
    plan = done._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    below = [plan[plan.index(line) :] for line in shuffles]
    assert len(shuffles) == 1 and "__of_slice" not in shuffles[0]
    assert "HashAggregate" in below[0].split("FileScan")[0]  # of one row per slice and group
    assert found.count() > 0


def test_no_tables_are_left(spark):
    before = {(r.namespace, r.tableName) for db in spark.sql("SHOW DATABASES").collect() for r in spark.sql(f"SHOW TABLES IN {db.namespace}").collect()}
    assert computed_running(spark, hot_rows(300)) == expected_running(hot_rows(300))
    after = {(r.namespace, r.tableName) for db in spark.sql("SHOW DATABASES").collect() for r in spark.sql(f"SHOW TABLES IN {db.namespace}").collect()}
    assert after == before


def test_hot_group_is_cut_into_slices(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    rows = [("hot", i, 1) for i in range(4000)]
    frame = spark.createDataFrame(rows, ROWS_SCHEMA)
    done = running.running_total(frame, ["g"], [F.col("o")], {"run": F.lit(1)})
    sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2000  # no task holds half of the only group
    assert done.filter("run <> o + 1").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-5, 5)), min_size=1, max_size=60))
def test_any_rows(spark, data):
    rows = [(g, i, v) for i, (g, v) in enumerate(data)]
    assert computed_running(spark, rows) == expected_running(rows)


def test_percentiles_are_exact(spark):
    picked = random.Random(3)
    rows = [("hot" if i % 3 else "g%d" % (i % 7), picked.choice([picked.random() * 100, 5.0, None])) for i in range(3000)]
    rows += [("empty", None), ("one", 4.5)]
    frame = spark.createDataFrame(rows, "g string, x double")
    wanted = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "high": 1.0}
    found = percentiles.exact_percentiles(frame, ["g"], "x", wanted, count_as="n")
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).extend([] if x is None else [x])
    result = {r.g: r for r in found.collect()}
    assert result.keys() == groups.keys()
    for g, held in groups.items():
        assert result[g].n == len(held)
        for name, share in wanted.items():
            if held:
                assert result[g][name] == pytest.approx(np.quantile(held, share), abs=1e-9)
            else:
                assert result[g][name] is None


def test_segments_hold_at_most_n_rows_in_order(spark):
    rows = [("hot" if i % 3 else f"p{i % 4}", i * 7, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, ROWS_SCHEMA).repartition(4)
    done = segments.assign_segments(frame, ["g"], "o", 50).collect()
    by_group = {}
    for r in done:
        by_group.setdefault(r.g, []).append((r.o, r.segment))
    assert sum(map(len, by_group.values())) == len(rows)
    for held in by_group.values():
        assert [s for _, s in sorted(held)] == [i // 50 for i in range(len(held))]


def test_written_segments_respect_the_limit(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "date'2024-01-01' + CAST(id % 2 AS INT) AS day", "CAST(id % 5 AS STRING) AS repo")
    segments.write_segments(rows, str(tmp_path / "out"), "day", 100, cluster_by=["repo"])
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 1000
    assert max(r["count"] for r in written.groupBy(F.input_file_name()).count().collect()) <= 100
    assert sorted(r.day.isoformat() for r in written.select("day").distinct().collect()) == ["2024-01-01", "2024-01-02"]
