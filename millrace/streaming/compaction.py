"""Compaction: the many small batches of closed days of a real-time table become few segments.

A stream leaves a partition per day and batch. ``compact`` writes what a closed day holds into
one partition of a new *generation*, and then commits it by one file in the table's log of
merges. The log says, for a day and a query, up to which batch its rows are merged, and which
generation of a day counts. What follows from this at any moment, also between two steps:

* a generation that was not committed is never read, and the next run writes it over;
* batches that were merged are never read again, also when a stream replays one of them;
* nothing that is read goes away: ``drop_replaced`` removes replaced partitions later, once the
  queries that began before the commit are done.

The newest batch of each query is left alone, since only that one can still be replayed.
Batches that come late for a merged day are read beside its generation, and merged with it by
a later run. One run at a time may compact a table; streams and readers need not wait for it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import catalog

DAY = "day"
BATCH = "batch"
#: What stands in place of a query in the partition names of merged rows.
MERGED = "merged"

_PRODUCER, _NUMBER, _UPTO = "__producer", "__number", "__upto"
_LOG = "day date, producer string, upto bigint, generation bigint, at timestamp"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def log_of(table: str) -> str:
    """The table that keeps a real-time table's merges."""
    return f"{table}_merges"


def create_log(spark: SparkSession, table: str) -> None:
    catalog.create_table(spark, log_of(table), _LOG)


def visible(spark: SparkSession, table: str) -> DataFrame:
    """The rows that count, each of them once, with their batch. The log is looked up now and
    the table's partitions later, so that a merge that is committed in between changes nothing."""
    rows = spark.table(table)
    merges = _merges(spark, table)
    if merges is None:
        return rows.filter(~F.col(BATCH).startswith(f"{MERGED}-"))
    return _counting(rows, merges).select(rows.columns)


def compact(
    spark: SparkSession, table: str, before: dt.date, cluster_by: Sequence[str] = (), fewest: int = 2, now: dt.datetime | None = None
) -> int:
    """Merge the batches of days before ``before``, and of rows without a day; says how many
    partitions were replaced. A day is rewritten when it has at least ``fewest`` batches that
    are not merged yet. Files hold as many rows as the table allows to a segment, and are
    sorted by ``cluster_by``."""
    spark.catalog.refreshTable(table)
    create_log(spark, table)
    merges = _merges(spark, table)
    generation = 1 if merges is None else merges.agg(F.max("generation")).first()[0] + 1
    todo = _replaceable(spark, table, merges, before, fewest)
    # Days and queries, never batches: bounded by the calendar.
    days = [row.day for row in todo.select(DAY).distinct().toLocalIterator()]
    if not days:
        return 0

    wanted = F.col(DAY).isin([d for d in days if d is not None])
    if None in days:
        wanted = wanted | F.col(DAY).isNull()
    rows = spark.table(table)
    counted = rows.filter(~F.col(BATCH).startswith(f"{MERGED}-")) if merges is None else _counting(rows, merges)
    told = _parsed(counted.filter(wanted), BATCH)
    limits = todo.select(F.col(DAY).alias("__of"), F.col("producer").alias("__by"), F.col("upto").alias(_UPTO))
    same = F.col(DAY).eqNullSafe(F.col("__of")) & (F.col(_PRODUCER) == F.col("__by")) & (F.col(_NUMBER) <= F.col(_UPTO))
    merged = told.join(limits, same, "left_semi").select(rows.columns)
    merged = merged.withColumn(BATCH, F.lit(f"{MERGED}-{generation}"))
    # Small days share a task and a large one is split over several.
    merged = merged.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, *cluster_by)
    merged.write.insertInto(table, overwrite=True)
    _commit(todo, table, generation, now or dt.datetime.now(dt.timezone.utc))
    return todo.agg(F.sum("parts")).first()[0]


def drop_replaced(spark: SparkSession, table: str, merged_before: dt.datetime | None = None) -> int:
    """Remove the partitions that merges committed before ``merged_before`` have replaced, and
    generations that were never committed; says how many went. Queries that began before the
    commit still read them, so leave such queries the time to end."""
    spark.catalog.refreshTable(table)
    merges = _merges(spark, table)
    if merges is None:
        return 0
    old = merges if merged_before is None else merges.filter(F.col("at") < F.lit(merged_before))
    newest = _latest(old)
    last = F.lit(merges.agg(F.max("generation")).first()[0])
    ours = F.col("producer") == MERGED
    listed = _partitions(spark, table).alias("p").join(newest.alias("m"), _same("p", "m"), "left")
    committed = merges.filter(ours).select(F.col(DAY).alias("__of"), F.col("upto").alias("__made")).distinct()
    listed = listed.select("p.*", "m.upto")
    made = listed.join(committed, F.col(DAY).eqNullSafe(F.col("__of")) & (F.col("number") == F.col("__made")), "left")
    abandoned = ours & F.col("__made").isNull() & (F.col("number") <= last)
    replaced = F.when(ours, F.col("number") < F.col("upto")).otherwise(F.col("number") <= F.col("upto"))
    gone = made.filter(F.coalesce(replaced, F.lit(False)) | abandoned)
    specs = [
        {DAY: row.day.isoformat() if row.day else None, BATCH: f"{row.producer}-{row.number}"} for row in gone.toLocalIterator()
    ]
    catalog.drop_partitions(spark, table, specs)
    return len(specs)


def _merges(spark: SparkSession, table: str) -> DataFrame | None:
    """The log as its files are now, or nothing where there are none."""
    if not spark.catalog.tableExists(log_of(table)):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {catalog.quoted(log_of(table))}")
    where = described.filter("col_name = 'Location'").first().data_type
    files = spark.read.schema(_LOG).parquet(where)
    return files if files.inputFiles() else None


def _commit(todo: DataFrame, table: str, generation: int, at: dt.datetime) -> None:
    """One file, which is there or not: all that this generation replaces, and itself."""
    made = todo.select(DAY).distinct().select(DAY, F.lit(MERGED).alias("producer"), F.lit(generation).cast("bigint").alias("upto"))
    replaced = todo.filter(F.col("producer") != MERGED).select(DAY, "producer", "upto")
    entry = replaced.unionByName(made).withColumns(
        {"generation": F.lit(generation).cast("bigint"), "at": F.lit(at).cast("timestamp")}
    )
    entry.coalesce(1).write.insertInto(log_of(table))


def _latest(merges: DataFrame) -> DataFrame:
    return merges.groupBy(DAY, "producer").agg(F.max("upto").alias("upto"))


def _parsed(rows: DataFrame, batch: str) -> DataFrame:
    """Who wrote a partition, and as which batch or generation."""
    number = F.substring_index(batch, "-", -1)
    producer = F.expr(f"substring(`{batch}`, 1, length(`{batch}`) - length(substring_index(`{batch}`, '-', -1)) - 1)")
    return rows.withColumns({_PRODUCER: producer, _NUMBER: number.try_cast("bigint")})


def _counting(rows: DataFrame, merges: DataFrame) -> DataFrame:
    latest = _latest(merges).select(
        F.col(DAY).alias("__day"), F.col("producer").alias("__by"), F.col("upto").alias("__last")
    )
    same = F.col(DAY).eqNullSafe(F.col("__day")) & (F.col(_PRODUCER) == F.col("__by"))
    found = _parsed(rows, BATCH).join(latest, same, "left")
    fresh = F.coalesce(F.col(_NUMBER) > F.col("__last"), F.lit(True))
    newest = F.coalesce(F.col(_NUMBER) == F.col("__last"), F.lit(False))
    kept = F.when(F.col(_PRODUCER) == MERGED, newest).otherwise(fresh)
    return found.filter(kept).select(rows.columns)


def _partitions(spark: SparkSession, table: str) -> DataFrame:
    """Day, producer and number of each partition, by its name alone."""
    listed = spark.sql(f"SHOW PARTITIONS {catalog.quoted(table)}")
    day = F.regexp_extract("partition", f"^{DAY}=([^/]*)", 1)
    named = listed.select(
        F.when(day != _NO_DAY, day.cast("date")).alias(DAY), F.regexp_extract("partition", f"/{BATCH}=([^/]*)$", 1).alias(BATCH)
    )
    return _parsed(named, BATCH).select(DAY, F.col(_PRODUCER).alias("producer"), F.col(_NUMBER).alias("number"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.{DAY}").eqNullSafe(F.col(f"{right}.{DAY}")) & (F.col(f"{left}.producer") == F.col(f"{right}.producer"))


def _replaceable(
    spark: SparkSession, table: str, merges: DataFrame | None, before: dt.date, fewest: int
) -> DataFrame:
    """Up to which batch each query's rows of a day are to be merged, and the generation that
    a day has by now; ``parts`` partitions each."""
    parts = _partitions(spark, table)
    last = F.max("number").over(Window.partitionBy("producer"))
    batches = parts.filter(F.col("producer") != MERGED).withColumn("last", last).filter("number < last")
    batches = batches.filter((F.col(DAY) < F.lit(before)) | F.col(DAY).isNull())
    if merges is not None:
        known = batches.alias("p").join(_latest(merges).alias("m"), _same("p", "m"), "left")
        batches = known.filter(F.coalesce(F.col("p.number") > F.col("m.upto"), F.lit(True))).select("p.*")
    enough = F.sum("parts").over(Window.partitionBy(DAY)) >= fewest
    todo = batches.groupBy(DAY, "producer").agg(F.max("number").alias("upto"), F.count("*").alias("parts"))
    todo = todo.withColumn("enough", enough).filter("enough").drop("enough")
    if merges is not None:
        before_now = _latest(merges).filter(F.col("producer") == MERGED).withColumn("parts", F.lit(1).cast("bigint"))
        same_day = F.col(f"m.{DAY}").eqNullSafe(F.col(f"d.{DAY}"))
        again = before_now.alias("m").join(todo.select(DAY).distinct().alias("d"), same_day, "left_semi")
        todo = todo.unionByName(again)
    return todo
