"""The decision-support pack: one query per operator, on the star schema.

Two shapes keep a key that holds a third of all rows from ending up in one task:

* Facts whose sums by the join key are enough are summed by it before the join. The sum
  and the join share one shuffle, and the hot key reaches it as one row per task.
* Facts that are needed row by row, or by more than the join key, are joined as they are,
  with a scan or a join on either side and other keys above. Adaptive execution can split
  such a join at the hot key; summing first would only add a shuffle.

What must not happen is raw rows meeting a side that is aggregated by the join key: that
join cannot be split. No join here is told to broadcast; Spark does so for a side whose
size it knows is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import workspace
from millrace.functions import clock
from millrace.functions.money import amount, cents, revenue
from millrace.operators import running, sets
from millrace.operators.sqljobs import run_sql
from millrace.plans.registry import query
from millrace.sources import tables

# The same amounts in the oracle's SQL.
_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _sum_sql(expression: str) -> str:
    return f"CAST(sum({expression}) AS DOUBLE)"


def _read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return tables.read(spark, directory, name)


def _year(ts: str) -> Column:
    return F.year(ts).alias("year")


# Joins


@query(
    f"""
SELECT CAST(year(l_shipdate) AS INTEGER) AS "year", p_brand AS brand, {_sum_sql(_REVENUE)} AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type = 'PROMO' AND month(l_shipdate) = 11
GROUP BY 1, 2
"""
)
def ds_star_join(spark: SparkSession, directory: str) -> DataFrame:
    """November revenue of promotional parts by year and brand."""
    november = _read(spark, directory, "lineitem").filter(F.month("l_shipdate") == 11)
    promotional = _read(spark, directory, "part").filter("p_type = 'PROMO'")
    return (
        november.join(promotional, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(_year("l_shipdate"), F.col("p_brand").alias("brand"))
        .agg(amount(F.sum(revenue()), 4).alias("revenue"))
    )


@query(
    """
SELECT p_type AS part_type, round(avg(l_quantity), 6) AS avg_quantity,
       round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / count(*), 6) AS avg_price,
       round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*), 6) AS avg_discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN part ON l_partkey = p_partkey
WHERE c_mktsegment = 'MACHINERY'
GROUP BY p_type
"""
)
def ds_multi_avg(spark: SparkSession, directory: str) -> DataFrame:
    """Average quantity, price and discount by part type, for one market segment."""
    segment = _read(spark, directory, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    orders = _read(spark, directory, "orders").select("o_orderkey", "o_custkey")
    chosen = orders.join(segment, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    lines = _read(spark, directory, "lineitem")
    parts = _read(spark, directory, "part").select("p_partkey", "p_type")
    return (
        lines.join(chosen, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_type").alias("part_type"))
        .agg(
            F.round(F.avg("l_quantity"), 6).alias("avg_quantity"),
            F.round(amount(F.sum(cents("l_extendedprice"))) / F.count("*"), 6).alias("avg_price"),
            F.round(amount(F.sum(cents("l_discount"))) / F.count("*"), 6).alias("avg_discount"),
        )
    )


@query(
    f"""
SELECT o_orderpriority AS priority, count(*) AS n_orders,
       CAST(sum(CASE WHEN returned IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_return,
       CAST(sum(coalesce(returned, 0)) AS DOUBLE) AS returned_value
FROM orders LEFT JOIN (SELECT l_orderkey, sum({_REVENUE}) AS returned FROM lineitem
                       WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey
GROUP BY o_orderpriority
"""
)
def ds_left_outer(spark: SparkSession, directory: str) -> DataFrame:
    """Orders with the value of their returned lines, or 0, by priority."""
    returned = (
        _read(spark, directory, "lineitem")
        .filter("l_returnflag = 'R'")
        .groupBy("l_orderkey")
        .agg(F.sum(revenue()).alias("returned"))
    )
    orders = _read(spark, directory, "orders").select("o_orderkey", "o_orderpriority")
    return (
        orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(
            F.count("*").alias("n_orders"),
            F.count_if(F.col("returned").isNull()).alias("n_without_return"),
            amount(F.sum(F.coalesce("returned", F.lit(0))), 4).alias("returned_value"),
        )
    )


def _in_year(spark: SparkSession, directory: str, year: int) -> DataFrame:
    """The customer of every order of a year."""
    orders = _read(spark, directory, "orders").filter(clock.in_year("o_orderdate", year))
    return orders.select(F.col("o_custkey").alias("custkey"))


def _year_customers_sql(year: int) -> str:
    return (
        f"SELECT DISTINCT o_custkey AS custkey FROM orders "
        f"WHERE o_orderdate >= TIMESTAMP '{year}-01-01' AND o_orderdate < TIMESTAMP '{year + 1}-01-01'"
    )


@query(
    f"""
SELECT CAST(sum(CASE WHEN b.custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_1996,
       CAST(sum(CASE WHEN a.custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_1997,
       CAST(sum(CASE WHEN a.custkey IS NOT NULL AND b.custkey IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_years
FROM ({_year_customers_sql(1996)}) a FULL JOIN ({_year_customers_sql(1997)}) b ON a.custkey = b.custkey
"""
)
def ds_full_outer(spark: SparkSession, directory: str) -> DataFrame:
    """Customers active in one year only, the other only, and both."""
    first = _in_year(spark, directory, 1996).distinct().withColumnRenamed("custkey", "a")
    second = _in_year(spark, directory, 1997).distinct().withColumnRenamed("custkey", "b")
    a, b = F.col("a"), F.col("b")
    return first.join(second, a == b, "full").agg(
        F.count_if(b.isNull()).alias("only_1996"),
        F.count_if(a.isNull()).alias("only_1997"),
        F.count_if(a.isNotNull() & b.isNotNull()).alias("both_years"),
    )


@query(
    """
SELECT c_mktsegment AS segment, count(*) AS n_customers FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
GROUP BY c_mktsegment
"""
)
def ds_semi(spark: SparkSession, directory: str) -> DataFrame:
    """Customers with an urgent order, by segment."""
    urgent = _read(spark, directory, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    customers = _read(spark, directory, "customer").select("c_custkey", "c_mktsegment")
    return (
        customers.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count("*").alias("n_customers"))
    )


@query(
    """
SELECT c_mktsegment AS segment, count(*) AS n_customers FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'
                  AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')
GROUP BY c_mktsegment
"""
)
def ds_anti(spark: SparkSession, directory: str) -> DataFrame:
    """Customers with no partly shipped order in a year, by segment."""
    orders = _read(spark, directory, "orders").filter(clock.in_year("o_orderdate", 1997))
    partly = orders.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    customers = _read(spark, directory, "customer").select("c_custkey", "c_mktsegment")
    return (
        customers.join(partly, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count("*").alias("n_customers"))
    )


@query(
    f"""
SELECT c_mktsegment AS segment, count(*) AS n_customers FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_PRICE} > 490000)
   OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1995-03-01')
GROUP BY c_mktsegment
"""
)
def ds_exists_or(spark: SparkSession, directory: str) -> DataFrame:
    """Customers with a very large order or a very early one, by segment."""
    orders = _read(spark, directory, "orders")
    return run_sql(
        spark,
        """
        SELECT c_mktsegment AS segment, count(*) AS n_customers FROM {customer}
        WHERE EXISTS (SELECT 1 FROM {large} l WHERE l.o_custkey = c_custkey)
           OR EXISTS (SELECT 1 FROM {early} e WHERE e.o_custkey = c_custkey)
        GROUP BY c_mktsegment
        """,
        customer=_read(spark, directory, "customer"),
        large=orders.filter("o_totalprice > 490000").select("o_custkey").distinct(),
        early=orders.filter(F.col("o_orderdate") < clock.midnight("1995-03-01")).select("o_custkey").distinct(),
    )


@query(
    """
SELECT o_orderpriority AS priority, count(*) AS n_late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY
GROUP BY o_orderpriority
"""
)
def ds_theta_residual(spark: SparkSession, directory: str) -> DataFrame:
    """Lines shipped more than sixty days after their order, by priority."""
    lines = _read(spark, directory, "lineitem").select("l_orderkey", "l_shipdate")
    orders = _read(spark, directory, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    return (
        lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & late)
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count("*").alias("n_late"))
    )


_QUANTITY_BUCKETS = {"small": (1, 10), "middle": (11, 30), "large": (31, 50)}


@query(
    "SELECT * FROM "
    + " CROSS JOIN ".join(
        f"""(SELECT count(*) AS n_{name}, count(DISTINCT l_partkey) AS parts_{name},
              round(avg(l_quantity), 6) AS avg_{name} FROM lineitem WHERE l_quantity BETWEEN {low} AND {high})"""
        for name, (low, high) in _QUANTITY_BUCKETS.items()
    )
)
def ds_cross_scalars(spark: SparkSession, directory: str) -> DataFrame:
    """Figures of three quantity buckets side by side: one pass instead of a join of three."""
    quantity = F.col("l_quantity")
    per_part, figures = [], []
    for name, (low, high) in _QUANTITY_BUCKETS.items():
        held = quantity.between(low, high)
        per_part += [F.count_if(held).alias(f"n_{name}"), F.sum(F.when(held, quantity)).alias(f"sum_{name}")]
        figures += [
            F.sum(f"n_{name}").alias(f"n_{name}"),
            F.count_if(F.col(f"n_{name}") > 0).alias(f"parts_{name}"),
            F.round(F.sum(f"sum_{name}") / F.sum(f"n_{name}"), 6).alias(f"avg_{name}"),
        ]
    # By part first: a bucket's distinct parts are then those that have a line in it.
    return _read(spark, directory, "lineitem").groupBy("l_partkey").agg(*per_part).agg(*figures)


@query(
    f"""
SELECT p_brand AS brand, count(*) AS n_lines, {_sum_sql(_REVENUE)} AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 1 AND 15 AND l_discount BETWEEN 0.05 AND 0.07)
   OR (p_size BETWEEN 11 AND 25 AND l_quantity BETWEEN 16 AND 30 AND l_discount BETWEEN 0.01 AND 0.03)
   OR (p_size BETWEEN 26 AND 50 AND l_quantity BETWEEN 31 AND 45 AND l_discount >= 0.08)
GROUP BY p_brand
"""
)
def ds_or_ranges(spark: SparkSession, directory: str) -> DataFrame:
    """Lines in one of three bands of part size, quantity and discount, by brand."""
    size, quantity, discount = F.col("p_size"), F.col("l_quantity"), F.col("l_discount")
    bands = (
        (size.between(1, 10) & quantity.between(1, 15) & discount.between(0.05, 0.07))
        | (size.between(11, 25) & quantity.between(16, 30) & discount.between(0.01, 0.03))
        | (size.between(26, 50) & quantity.between(31, 45) & (discount >= 0.08))
    )
    return (
        _read(spark, directory, "lineitem")
        .join(_read(spark, directory, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .filter(bands)
        .groupBy(F.col("p_brand").alias("brand"))
        .agg(F.count("*").alias("n_lines"), amount(F.sum(revenue()), 4).alias("revenue"))
    )


# Aggregates


@query(
    """
SELECT o_orderkey AS orderkey, c_name AS customer, n_lines
FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey HAVING count(*) BETWEEN 8 AND 10)
     JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
)
def ds_having(spark: SparkSession, directory: str) -> DataFrame:
    """Orders of eight to ten lines, with the customer's name."""
    counted = _read(spark, directory, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    orders = _read(spark, directory, "orders").select("o_orderkey", "o_custkey")
    customers = _read(spark, directory, "customer").select("c_custkey", "c_name")
    return (
        counted.filter(F.col("n_lines").between(8, 10))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("orderkey"), F.col("c_name").alias("customer"), "n_lines")
    )


def _nation_status_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Order totals by region, nation and status: few rows, ready for rollups."""
    orders = _read(spark, directory, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    customers = _read(spark, directory, "customer").select("c_custkey", "c_nationkey")
    by_nation = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "o_orderstatus")
        .agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
    )
    nations = _read(spark, directory, "nation")
    regions = _read(spark, directory, "region")
    return (
        by_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            F.col("o_orderstatus").alias("status"),
            "n",
            "cents",
        )
    )


_NATION_ORDERS_SQL = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey"""


@query(
    f"""
SELECT r_name AS region, o_orderstatus AS status, CAST(grouping(r_name) + grouping(o_orderstatus) AS BIGINT) AS level,
       count(*) AS n_orders, {_sum_sql(_PRICE)} AS total
FROM {_NATION_ORDERS_SQL}
GROUP BY ROLLUP (r_name, o_orderstatus)
"""
)
def ds_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Order totals by region and status, by region, and overall."""
    return (
        _nation_status_totals(spark, directory)
        .rollup("region", "status")
        .agg(
            (F.grouping("region") + F.grouping("status")).cast("bigint").alias("level"),
            F.sum("n").alias("n_orders"),
            amount(F.sum("cents")).alias("total"),
        )
    )


@query(
    f"""
SELECT channel, "year", count(*) AS n_orders, {_sum_sql(_PRICE)} AS total
FROM (SELECT 'urgent' AS channel, CAST(year(o_orderdate) AS INTEGER) AS "year", o_totalprice FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
      UNION ALL
      SELECT 'regular', CAST(year(o_orderdate) AS INTEGER), o_totalprice FROM orders
      WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
GROUP BY ROLLUP (channel, "year")
"""
)
def ds_union_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Two classes of orders as channels, put together and rolled up by channel and year."""
    orders = _read(spark, directory, "orders")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")

    def channel(name: str, held: Column) -> DataFrame:
        by_year = orders.filter(held).groupBy(_year("o_orderdate"))
        totals = by_year.agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
        return totals.withColumn("channel", F.lit(name))

    return (
        channel("urgent", urgent)
        .unionByName(channel("regular", ~urgent))
        .rollup("channel", "year")
        .agg(F.sum("n").alias("n_orders"), amount(F.sum("cents")).alias("total"))
    )


@query(
    """
SELECT l_returnflag AS returnflag, count(DISTINCT l_partkey) AS n_parts,
       count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_orderkey) AS n_orders
FROM lineitem GROUP BY l_returnflag
"""
)
def ds_multi_distinct(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct parts, suppliers and orders by return flag, in one pass."""
    return (
        _read(spark, directory, "lineitem")
        .groupBy(F.col("l_returnflag").alias("returnflag"))
        .agg(
            F.count_distinct("l_partkey").alias("n_parts"),
            F.count_distinct("l_suppkey").alias("n_suppliers"),
            F.count_distinct("l_orderkey").alias("n_orders"),
        )
    )


@query(
    """
SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, round(stddev_samp(l_quantity), 6) AS stddev_quantity,
       round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS variation
FROM lineitem GROUP BY 1, 2
"""
)
def ds_stddev(spark: SparkSession, directory: str) -> DataFrame:
    """Standard deviation and coefficient of variation of quantities."""
    deviation = F.stddev_samp("l_quantity")
    return (
        _read(spark, directory, "lineitem")
        .groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
        .agg(
            F.round(deviation, 6).alias("stddev_quantity"),
            F.round(deviation / F.avg("l_quantity"), 6).alias("variation"),
        )
    )


# Spark counts weekdays from Sunday = 1, the oracle from Sunday = 0.
_WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


@query(
    'SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", o_orderpriority AS priority, '
    + ", ".join(
        f"CAST(sum(CASE WHEN dayofweek(o_orderdate) = {i} THEN {_PRICE} ELSE 0 END) AS DOUBLE) AS {day}"
        for i, day in enumerate(_WEEKDAYS)
    )
    + " FROM orders GROUP BY 1, 2"
)
def ds_case_pivot(spark: SparkSession, directory: str) -> DataFrame:
    """Order value by weekday, side by side, by year and priority."""
    weekday = F.dayofweek("o_orderdate")
    value = cents("o_totalprice")
    sums = [
        amount(F.sum(F.when(weekday == i, value).otherwise(F.lit(0)))).alias(day)
        for i, day in enumerate(_WEEKDAYS, start=1)
    ]
    orders = _read(spark, directory, "orders")
    return orders.groupBy(_year("o_orderdate"), F.col("o_orderpriority").alias("priority")).agg(*sums)


# Windows


def _part_revenue(spark: SparkSession, directory: str) -> DataFrame:
    """Each sold part's revenue with its brand and type, one row per part."""
    sold = _read(spark, directory, "lineitem").groupBy("l_partkey").agg(F.sum(revenue()).alias("units"))
    parts = _read(spark, directory, "part").select("p_partkey", "p_brand", "p_type")
    return sold.join(parts, F.col("l_partkey") == F.col("p_partkey"))


@query(
    f"""
WITH sold AS (SELECT p_brand, p_partkey, sum({_REVENUE}) AS units
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
     best AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY units DESC, p_partkey) AS place FROM sold),
     worst AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY units, p_partkey) AS place FROM sold)
SELECT 'best' AS side, p_brand AS brand, place, p_partkey AS partkey, CAST(units AS DOUBLE) AS revenue
FROM best WHERE place <= 3
UNION ALL
SELECT 'worst', p_brand, place, p_partkey, CAST(units AS DOUBLE) FROM worst WHERE place <= 3
"""
)
def ds_rank_topn(spark: SparkSession, directory: str) -> DataFrame:
    """The three best and three worst selling parts of each brand."""
    sold = _part_revenue(spark, directory)

    def side(name: str, by_units: Column) -> DataFrame:
        # The filter on the number keeps three rows per brand and task before the shuffle.
        place = F.row_number().over(Window.partitionBy("p_brand").orderBy(by_units, "p_partkey"))
        placed = sold.withColumn("place", place).filter("place <= 3")
        return placed.select(
            F.lit(name).alias("side"),
            F.col("p_brand").alias("brand"),
            F.col("place").cast("bigint").alias("place"),
            F.col("p_partkey").alias("partkey"),
            amount("units", 4).alias("revenue"),
        )

    return side("best", F.desc("units")).unionByName(side("worst", F.asc("units")))


@query(
    f"""
SELECT region, nation, level, total, rank() OVER (PARTITION BY level, CASE WHEN level = 0 THEN region END
                                                  ORDER BY total DESC) AS place
FROM (SELECT r_name AS region, n_name AS nation, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level,
             {_sum_sql(_PRICE)} AS total
      FROM {_NATION_ORDERS_SQL}
      GROUP BY ROLLUP (r_name, n_name))
"""
)
def ds_rank_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Nations ranked within their region and regions among each other, in one rollup."""
    totals = (
        _nation_status_totals(spark, directory)
        .rollup("region", "nation")
        .agg(
            (F.grouping("region") + F.grouping("nation")).cast("bigint").alias("level"),
            amount(F.sum("cents")).alias("total"),
        )
    )
    # One row per nation and region: the window sees no fact rows.
    parent = F.when(F.col("level") == 0, F.col("region"))
    place = F.rank().over(Window.partitionBy("level", parent).orderBy(F.desc("total")))
    return totals.withColumn("place", place.cast("bigint"))


@query(
    f"""
SELECT part_type, brand, CAST(units AS DOUBLE) AS total,
       round(100 * CAST(units AS DOUBLE) / CAST(sum(units) OVER (PARTITION BY part_type) AS DOUBLE), 6) AS share
FROM (SELECT p_type AS part_type, p_brand AS brand, sum({_REVENUE}) AS units
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
"""
)
def ds_share(spark: SparkSession, directory: str) -> DataFrame:
    """Each brand's share of its part type's revenue."""
    brands = (
        _part_revenue(spark, directory)
        .groupBy(F.col("p_type").alias("part_type"), F.col("p_brand").alias("brand"))
        .agg(F.sum("units").alias("units"))
    )
    total, of_type = amount("units", 4), amount(F.sum("units").over(Window.partitionBy("part_type")), 4)
    return brands.select("part_type", "brand", total.alias("total"), F.round(100 * total / of_type, 6).alias("share"))


@query(
    f"""
SELECT * FROM (
  SELECT "year", "month", CAST(total AS DOUBLE) AS total,
         round(CAST(sum(total) OVER (PARTITION BY "year") AS DOUBLE) / count(*) OVER (PARTITION BY "year"), 4) AS year_mean
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", CAST(month(o_orderdate) AS INTEGER) AS "month",
               sum({_PRICE}) AS total FROM orders GROUP BY 1, 2))
WHERE abs(total - year_mean) > 0.05 * year_mean
"""
)
def ds_deviation(spark: SparkSession, directory: str) -> DataFrame:
    """Months whose order value is more than five percent off their year's mean. The mean is
    made of exact sums: a mean of doubles would depend on the order of the months."""
    months = (
        _read(spark, directory, "orders")
        .groupBy(_year("o_orderdate"), F.month("o_orderdate").alias("month"))
        .agg(F.sum(cents("o_totalprice")).alias("cents"))
    )
    year = Window.partitionBy("year")
    mean = F.round(amount(F.sum("cents").over(year)) / F.count("*").over(year), 4)
    compared = months.select("year", "month", amount("cents").alias("total"), mean.alias("year_mean"))
    return compared.filter("abs(total - year_mean) > 0.05D * year_mean")


@query(
    f"""
SELECT o_custkey AS custkey, o_orderkey AS orderkey,
       CAST(sum({_PRICE}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total
FROM orders
"""
)
def ds_running_sum(spark: SparkSession, directory: str) -> DataFrame:
    """Every order with what its customer has spent up to it."""
    orders = _read(spark, directory, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    summed = running.running_total(
        orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], {"spent": cents("o_totalprice")}
    )
    return summed.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), amount("spent").alias("running_total")
    )


@query(
    f"""
SELECT brand, "year", "month", total, lag(total) OVER w AS previous, lead(total) OVER w AS following
FROM (SELECT p_brand AS brand, CAST(year(l_shipdate) AS INTEGER) AS "year", CAST(month(l_shipdate) AS INTEGER) AS "month",
             {_sum_sql(_REVENUE)} AS total
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY brand ORDER BY "year", "month")
"""
)
def ds_lag_lead(spark: SparkSession, directory: str) -> DataFrame:
    """Monthly revenue per brand beside the month before and the month after."""
    lines = _read(spark, directory, "lineitem")
    parts = _read(spark, directory, "part").select("p_partkey", "p_brand")
    months = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("brand"), _year("l_shipdate"), F.month("l_shipdate").alias("month"))
        .agg(amount(F.sum(revenue()), 4).alias("total"))
    )
    # One row per brand and month.
    in_order = Window.partitionBy("brand").orderBy("year", "month")
    return months.withColumns(
        {"previous": F.lag("total").over(in_order), "following": F.lead("total").over(in_order)}
    )


# Set operations


@query(
    """
SELECT n_name AS nation, count(*) AS n_accounts, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM (SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer
      UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) JOIN nation ON nationkey = n_nationkey
GROUP BY n_name
"""
)
def ds_union_all(spark: SparkSession, directory: str) -> DataFrame:
    """Balances of customers and suppliers together, by nation."""
    customers = _read(spark, directory, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"))
    suppliers = _read(spark, directory, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b"))
    by_nation = customers.unionByName(suppliers).groupBy("k").agg(F.count("*").alias("n"), F.sum(cents("b")).alias("cents"))
    nations = _read(spark, directory, "nation")
    return by_nation.join(nations, F.col("k") == F.col("n_nationkey")).select(
        F.col("n_name").alias("nation"), F.col("n").alias("n_accounts"), amount("cents").alias("balance")
    )


@query(f"{_year_customers_sql(1996)} INTERSECT {_year_customers_sql(1997)}")
def ds_intersect(spark: SparkSession, directory: str) -> DataFrame:
    """Customers active in both years."""
    return sets.intersect(_in_year(spark, directory, 1996), _in_year(spark, directory, 1997))


@query(f"{_year_customers_sql(1996)} EXCEPT {_year_customers_sql(1997)}")
def ds_except(spark: SparkSession, directory: str) -> DataFrame:
    """Customers active in the first year but not in the second."""
    return sets.subtract(_in_year(spark, directory, 1996), _in_year(spark, directory, 1997))


# Subqueries


@query(
    """
SELECT l_returnflag AS returnflag, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM lineitem a
WHERE l_quantity > 1.2 * (SELECT avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)
GROUP BY l_returnflag
"""
)
def ds_correlated(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of more than 1.2 times their part's mean quantity, by return flag.

    Each part's mean is written down first, one row per part. Lines and means are then both
    scans, so the join can be split where a part is hot, however many quantities it has;
    the subquery itself would join behind a sum, where it cannot.
    """
    lines = _read(spark, directory, "lineitem").filter("l_quantity IS NOT NULL AND l_partkey IS NOT NULL")
    path = workspace.fresh_path(spark, "part-means")
    means = lines.groupBy("l_partkey").agg((F.sum("l_quantity") / F.count("*")).alias("mean"))
    means.write.parquet(path)
    known = spark.read.schema(means.schema).parquet(path)
    return (
        lines.join(known, "l_partkey")
        .filter("l_quantity > 1.2D * mean")
        .groupBy(F.col("l_returnflag").alias("returnflag"))
        .agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    )


def _bucket_sql(table: str, low: int, high: int) -> str:
    held = f"FROM {table} WHERE l_quantity BETWEEN {low} AND {high}"
    return f"""CASE WHEN (SELECT count(*) {held}) > (SELECT count(*) / 4 FROM {table})
        THEN (SELECT round(avg(l_quantity), 6) {held})
        ELSE (SELECT round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*), 6) {held}) END"""


@query(
    f"SELECT {_bucket_sql('lineitem', 1, 10)} AS small, {_bucket_sql('lineitem', 11, 30)} AS middle, "
    f"{_bucket_sql('lineitem', 31, 50)} AS large"
)
def ds_scalar_case(spark: SparkSession, directory: str) -> DataFrame:
    """Each quantity bucket shows its mean quantity if it is large, else its mean discount."""
    choices = ", ".join(
        f"""CASE WHEN (SELECT n_{b} FROM figures) > (SELECT n FROM figures) / 4
            THEN (SELECT q_{b} FROM figures) ELSE (SELECT d_{b} FROM figures) END AS {b}"""
        for b in _QUANTITY_BUCKETS
    )
    # The subqueries all read one row, so the lines are scanned once.
    figures = ", ".join(
        f"""count(*) FILTER ({held}) AS n_{b},
            round(avg(l_quantity) FILTER ({held}), 6) AS q_{b},
            round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) FILTER ({held}) AS DOUBLE) / count(*) FILTER ({held}), 6) AS d_{b}"""
        for b, held in ((b, f"WHERE l_quantity BETWEEN {low} AND {high}") for b, (low, high) in _QUANTITY_BUCKETS.items())
    )
    return run_sql(
        spark,
        f"WITH figures AS (SELECT count(*) AS n, {figures} FROM {{lineitem}}) SELECT {choices}",
        lineitem=_read(spark, directory, "lineitem"),
    )


@query(
    f"""
SELECT o_orderpriority AS priority, count(*) AS n_orders, {_sum_sql(_PRICE)} AS total
FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey
                    HAVING sum({_PRICE}) > 1.5 * (SELECT sum({_PRICE}) / count(DISTINCT o_custkey) FROM orders
                                                  WHERE o_custkey IS NOT NULL))
GROUP BY o_orderpriority
"""
)
def ds_in_subquery(spark: SparkSession, directory: str) -> DataFrame:
    """Orders of customers who spent half as much again as the average one, by priority.

    The subquery's customers are distinct, so an inner join keeps the same orders as IN.
    Spark would move the semi join of an IN below the sums, onto the raw orders.
    """
    per_customer = (
        _read(spark, directory, "orders")
        .filter("o_custkey IS NOT NULL")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
    )
    return run_sql(
        spark,
        """
        WITH spent AS (SELECT o_custkey, sum(cents) AS cents FROM {orders} GROUP BY o_custkey),
             high AS (SELECT o_custkey FROM spent
                      WHERE cents > 1.5D * (SELECT CAST(sum(cents) AS DOUBLE) / count(*) FROM spent))
        SELECT o_orderpriority AS priority, sum(n) AS n_orders, CAST(sum(cents) AS DOUBLE) / 100.0D AS total
        FROM {orders} JOIN high USING (o_custkey)
        GROUP BY o_orderpriority
        """,
        orders=per_customer,
    )


@query(
    f"""
WITH yearly AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS "year", {_sum_sql(_PRICE)} AS total
                FROM orders GROUP BY 1, 2)
SELECT a.o_custkey AS custkey, a."year" AS "year", a.total AS total, b.total AS next_total,
       round(b.total / a.total, 6) AS growth
FROM yearly a JOIN yearly b ON a.o_custkey = b.o_custkey AND b."year" = a."year" + 1
WHERE b.total > 1.5 * a.total
"""
)
def ds_yoy(spark: SparkSession, directory: str) -> DataFrame:
    """Customers who spent half as much again in the year after, from one yearly table."""
    yearly = (
        _read(spark, directory, "orders")
        .groupBy("o_custkey", _year("o_orderdate"))
        .agg(amount(F.sum(cents("o_totalprice"))).alias("total"))
    )
    return run_sql(
        spark,
        """
        WITH yearly AS (SELECT * FROM {yearly})
        SELECT a.o_custkey AS custkey, a.year AS year, a.total AS total, b.total AS next_total,
               round(b.total / a.total, 6) AS growth
        FROM yearly a JOIN yearly b ON a.o_custkey = b.o_custkey AND b.year = a.year + 1
        WHERE b.total > 1.5D * a.total
        """,
        yearly=yearly,
    )


# Scalar functions and sorting


@query(
    """
SELECT upper(substr(p_name, 1, 3)) AS prefix, concat(p_brand, '/', p_type) AS label, count(*) AS n_parts,
       max(length(p_name)) AS longest
FROM part WHERE p_name LIKE '%e%' GROUP BY 1, 2
"""
)
def ds_string_funcs(spark: SparkSession, directory: str) -> DataFrame:
    """Parts by the start of their name and a label made of brand and type."""
    return (
        _read(spark, directory, "part")
        .filter(F.col("p_name").like("%e%"))
        .groupBy(
            F.upper(F.substring("p_name", 1, 3)).alias("prefix"),
            F.concat("p_brand", F.lit("/"), "p_type").alias("label"),
        )
        .agg(F.count("*").alias("n_parts"), F.max(F.length("p_name")).cast("bigint").alias("longest"))
    )


@query(
    f"""
SELECT l_linestatus AS linestatus, CAST(l_quantity AS INTEGER) // 10 AS tens,
       round(CAST(sum({_REVENUE}) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE), 6) AS paid_ratio,
       coalesce(max(nullif(l_discount, 0.1)), 0) AS top_discount_below_limit,
       abs(CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT)
           - CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT)) AS flag_gap
FROM lineitem GROUP BY 1, 2
"""
)
def ds_math_funcs(spark: SparkSession, directory: str) -> DataFrame:
    """Ratios, rounding, casts and defaults by tens of quantity."""
    flag = F.col("l_returnflag")
    return (
        _read(spark, directory, "lineitem")
        .groupBy(
            F.col("l_linestatus").alias("linestatus"),
            F.floor(F.col("l_quantity").cast("int") / 10).cast("int").alias("tens"),
        )
        .agg(
            F.round(amount(F.sum(revenue()), 4) / amount(F.sum(cents("l_extendedprice"))), 6).alias("paid_ratio"),
            F.coalesce(F.max(F.nullif("l_discount", F.lit(0.1))), F.lit(0.0)).alias("top_discount_below_limit"),
            F.abs(F.count_if(flag == "R") - F.count_if(flag == "A")).alias("flag_gap"),
        )
    )


@query(
    """
SELECT l_returnflag AS returnflag, CAST(year(o_orderdate) AS INTEGER) AS "year",
       CAST(sum(CASE WHEN delay <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS within_30,
       CAST(sum(CASE WHEN delay > 30 AND delay <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS within_60,
       CAST(sum(CASE WHEN delay > 60 AND delay <= 90 THEN 1 ELSE 0 END) AS BIGINT) AS within_90,
       CAST(sum(CASE WHEN delay > 90 THEN 1 ELSE 0 END) AS BIGINT) AS beyond
FROM (SELECT l_returnflag, o_orderdate, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delay
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-01' + INTERVAL 730 DAY)
GROUP BY 1, 2
"""
)
def ds_date_funcs(spark: SparkSession, directory: str) -> DataFrame:
    """Lines by days from order to shipment, for the two years after a date."""
    lines = _read(spark, directory, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    first = clock.midnight("1996-01-01")
    two_years = F.col("o_orderdate").between(first, first + F.expr("INTERVAL 730 DAYS"))
    orders = _read(spark, directory, "orders").filter(two_years).select("o_orderkey", "o_orderdate")
    delay = F.col("delay")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("delay", F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))
        .groupBy(F.col("l_returnflag").alias("returnflag"), _year("o_orderdate"))
        .agg(
            F.count_if(delay <= 30).alias("within_30"),
            F.count_if((delay > 30) & (delay <= 60)).alias("within_60"),
            F.count_if((delay > 60) & (delay <= 90)).alias("within_90"),
            F.count_if(delay > 90).alias("beyond"),
        )
    )


@query(
    """
SELECT o_orderkey AS orderkey, o_custkey AS custkey, nullif(o_orderstatus, 'P') AS status, o_totalprice AS total
FROM orders ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100
"""
)
def ds_top100(spark: SparkSession, directory: str) -> DataFrame:
    """The report's first hundred rows, empty values last."""
    status = F.nullif("o_orderstatus", F.lit("P"))
    ordered = _read(spark, directory, "orders").orderBy(
        status.asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), "o_orderkey"
    )
    return ordered.limit(100).select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        status.alias("status"),
        F.col("o_totalprice").alias("total"),
    )
