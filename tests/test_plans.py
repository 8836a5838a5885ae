"""The physical plans that the queries rely on at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import catalog
from millrace.plans import QUERIES
from millrace.streaming import realtime

SMALL = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if n.startswith(("ds_", "bi_")))


@pytest.fixture
def plan(spark, conf, capsys):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.maxMetadataStringLength", "2000")

    def text(name):
        frame = QUERIES[name](spark, SMALL)
        capsys.readouterr()
        frame.explain("extended")
        return capsys.readouterr().out.split("== Physical Plan ==")[1]

    return text


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_no_forced_broadcast_no_python(plan, name):
    physical = plan(name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in physical
    # Running sums broadcast what slices carry over: two rows per slice at most.
    hints = [line for line in physical.splitlines() if re.search(r"BroadcastHashJoin\b.*\[", line)]
    assert all("__of_slice" in line for line in hints)


@pytest.mark.parametrize("name", ["ds_rank_topn"])
def test_ranks_are_limited_before_the_shuffle(plan, name):
    assert "WindowGroupLimit" in plan(name)
    assert plan(name).count("Partial") >= 2


@pytest.mark.parametrize("name", ["ds_top100", "bi_top_n"])
def test_top_rows_are_not_sorted_globally(plan, name):
    assert "TakeOrderedAndProject" in plan(name)
    assert "rangepartitioning" not in plan(name)


@pytest.mark.parametrize(
    "name", ["ds_left_outer", "ds_having", "ds_share", "ds_rank_topn", "ds_in_subquery"]
)
def test_facts_are_summed_below_the_join(plan, name):
    """Between the fact table's scan and the first join there is a partial aggregate."""
    physical = plan(name).split("\n")
    fact = "lineitem.parquet" if "l_" in plan(name) else "orders.parquet"
    scans = [i for i, line in enumerate(physical) if "FileScan" in line and fact in line]
    for scan in scans:
        depth = physical[scan].index("FileScan")
        above = []
        for line in reversed(physical[:scan]):
            start = len(line) - len(line.lstrip(" :+-"))
            if start < depth:
                above.append(line)
                depth = start
        joined = next(i for i, line in enumerate(above) if "Join" in line) if any("Join" in a for a in above) else len(above)
        assert any("HashAggregate" in line and "partial" in line for line in above[:joined])


@pytest.mark.parametrize("name", ["ds_intersect", "ds_except"])
def test_set_operations_do_not_join(plan, name):
    physical = plan(name)
    assert "Join" not in physical
    assert physical.count("Exchange") == 1


def test_conditional_figures_read_the_lines_once(plan):
    assert plan("ds_cross_scalars").count("FileScan") == 1


def test_scalar_subqueries_share_one_scan(spark):
    frame = QUERIES["ds_scalar_case"](spark, SMALL)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedSubquery" in final
    assert final.count("FileScan") == 1


def test_both_sides_of_a_self_join_share_one_scan(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("ds_in_subquery", "ds_yoy", "ds_rank_topn"):
        frame = QUERIES[name](spark, SMALL)
        frame.collect()
        assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString(), name


@pytest.mark.parametrize(
    ("name", "filters"),
    [
        ("ds_star_join", "EqualTo(p_type,PROMO)"),
        ("ds_anti", "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)"),
        ("ds_semi", "EqualTo(o_orderpriority,1-URGENT)"),
        ("ds_left_outer", "EqualTo(l_returnflag,R)"),
        ("ds_or_ranges", "GreaterThanOrEqual(p_size,1)"),
    ],
)
def test_filters_reach_the_scan(plan, name, filters):
    assert filters in plan(name)


@pytest.fixture(scope="module")
def skewed_lines(spark, tmp_path_factory):
    """The small tables with one order and one part that hold a third of the lines each,
    and one customer with a third of the orders."""
    folder = tmp_path_factory.mktemp("hot")
    for name in ("region", "nation", "customer", "part"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    hot_customer = F.when(F.rand(3) < 0.33, 5).otherwise(F.col("o_custkey")).cast("bigint")
    orders = orders.withColumn("o_custkey", hot_customer)
    many = orders.crossJoin(spark.range(16).select(F.col("id").alias("copy")))
    many = many.withColumn("o_orderkey", F.col("o_orderkey") + 100_000 * F.col("copy")).drop("copy")
    many.repartition(8).write.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    hot_part = F.when(F.rand(1) < 0.33, 7).otherwise(F.col("l_partkey"))
    hot_order = F.when(F.rand(2) < 0.33, 11).otherwise(F.col("l_orderkey"))
    lines = lines.withColumn("l_partkey", hot_part.cast("bigint")).withColumn("l_orderkey", hot_order.cast("bigint"))
    for _ in range(4):
        lines = lines.unionAll(lines)
    lines.repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["ds_star_join", "ds_multi_avg", "ds_theta_residual", "ds_or_ranges", "ds_rollup", "ds_lag_lead", "ds_date_funcs", "ds_correlated"],
)
def test_hot_keys_of_joined_rows_are_split(spark, conf, skewed_lines, name):
    """Where lines are joined as they are, adaptive execution cuts a hot partition up; the
    real threshold is 256 MB, scaled down here with the data."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "2KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2KB")
    frame = QUERIES[name](spark, skewed_lines)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final


def test_day_filter_prunes_partitions(spark, capsys):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])
    database = catalog.create_scratch_database(spark, "pruned")
    realtime.create_realtime_table(spark, f"{database}.t", schema)
    rows = spark.range(50).selectExpr("id", "CAST(id % 3 AS STRING)", "date'2024-01-01' + CAST(id % 5 AS INT)", "'q-0'")
    rows.write.insertInto(f"{database}.t", overwrite=True)
    held = realtime.read_realtime(spark, f"{database}.t")
    chosen = held.filter("day >= date'2024-01-04' AND kind = '1'").select("id")
    assert chosen.count() == 7
    chosen.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "EqualTo(kind,1)" in plan
    assert "ReadSchema: struct<id:bigint,kind:string>" in plan
