"""Every registered query against its oracle, on the given tables and on skewed ones."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.plans import ORACLE, QUERIES
from millrace.sources import tables

from .conftest import SMALL, assert_same, oracle

WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def given():
    return oracle(SMALL)


@pytest.fixture(scope="module")
def skewed_directory(tmp_path_factory):
    """The given tables with one part, supplier, order, customer, user, type and day that
    hold a third of their rows each."""
    folder = tmp_path_factory.mktemp("skewed")
    changes = {
        "lineitem": "CASE WHEN {n} % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
        "CASE WHEN {n} % 3 = 1 THEN 2 ELSE l_suppkey END AS l_suppkey, "
        "CASE WHEN {n} % 3 = 2 THEN 11 ELSE l_orderkey END AS l_orderkey",
        "orders": "CASE WHEN {n} % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey",
        "events": "CASE WHEN {n} % 3 = 0 THEN 3 ELSE user_id END AS user_id, "
        "CASE WHEN {n} % 3 = 1 THEN 'view' ELSE event_type END AS event_type, "
        "CASE WHEN {n} % 3 = 2 THEN TIMESTAMP '2024-01-09 10:00:00' + to_seconds(event_id) ELSE ts END AS ts",
    }
    for name in tables.ALL_TABLES:
        source, target = tables.location(SMALL, name), tables.location(str(folder), name)
        if name in changes:
            changed = changes[name].format(n="(row_number() OVER ())")
            duckdb.execute(f"COPY (SELECT * REPLACE ({changed}) FROM '{source}') TO '{target}' (FORMAT parquet)")
        else:
            shutil.copy(source, target)
    return str(folder)


@pytest.fixture(scope="module")
def skewed(skewed_directory):
    return oracle(skewed_directory)


def test_every_query_is_registered_with_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(__spark_entry__.queries()) >= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) >= set(ORACLE)


def test_the_rest_stands_without_the_training_data_parts(tmp_path):
    """A copy of the repository without them still lists and imports all other queries."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], done.stderr


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, given, name):
    assert_same(QUERIES[name](spark, SMALL), given.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n.startswith(("ds_", "bi_", "rt_", "history_", "multi_"))))
def test_query_on_skewed_tables_without_broadcast(spark, conf, skewed, skewed_directory, name):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert_same(QUERIES[name](spark, skewed_directory), skewed.sql(ORACLE[name]))


@pytest.mark.parametrize("partitions", ["1", "53"])
@pytest.mark.parametrize(
    "name",
    ["bi_percentiles", "bi_time_grain", "ds_cross_scalars", "ds_deviation", "ds_multi_avg", "ds_scalar_case", "ds_share", "ds_stddev"],
)
def test_figures_do_not_depend_on_partitioning(spark, conf, given, name, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.files.maxPartitionBytes", "20KB")
    assert_same(QUERIES[name](spark, SMALL), given.sql(ORACLE[name]))


def test_approximate_distinct_is_close(spark):
    exact = {r.event_type: r.n_users for r in QUERIES["bi_distinct"](spark, SMALL).collect()}
    near = {r.event_type: r.n_users for r in QUERIES["bi_distinct_approx"](spark, SMALL).collect()}
    assert near.keys() == exact.keys()
    assert all(abs(near[t] - exact[t]) <= max(1, 0.1 * exact[t]) for t in exact)


def test_entry_runs(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["hour_start", "event_type", "n", "total"]
    assert frame.count() > 0


def test_time_zone_does_not_matter(spark, conf, given):
    conf("spark.sql.session.timeZone", "America/New_York")
    for name in ("bi_time_grain", "epoch_time_columns", "stream_hourly_metrics", "batch_hourly_metrics", "ds_deviation"):
        assert_same(QUERIES[name](spark, SMALL), given.sql(ORACLE[name]))


def test_no_test_data_is_kept_in_the_repository():
    assert not list(Path(__file__).resolve().parent.parent.glob("**/*.parquet"))
