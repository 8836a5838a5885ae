"""Word counts, sums by key, and the life of a warehouse table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import workspace
from millrace.functions.money import amount, cents
from millrace.operators import catalog, reduce, sqljobs
from millrace.plans.registry import query
from millrace.sources import tables

# The words of the word-count example, repeated one included.
EXAMPLE_WORDS = ("apple", "banana", "hello", "apple")
# Common words of the documents, so that the lookup below also finds something.
COMMON_WORDS = ("the", "que", "der", "los")

_WORD_COUNT_SQL = r"""
SELECT word, count(*) AS "count"
FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS word FROM documents)
WHERE word <> ''
GROUP BY word
"""


def _corpus_words(spark: SparkSession, directory: str) -> DataFrame:
    return reduce.words_of(tables.read(spark, directory, "documents"))


@query(_WORD_COUNT_SQL)
def word_count(spark: SparkSession, directory: str) -> DataFrame:
    return reduce.count_words(_corpus_words(spark, directory))


@query(
    r"""
WITH listed(word) AS (VALUES ('apple'), ('banana'), ('hello'), ('apple'), ('the'), ('que'), ('der'), ('los')),
     corpus AS (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS word FROM documents)
SELECT l.word, l.n AS listed, (SELECT count(*) FROM corpus c WHERE c.word = l.word) AS in_documents
FROM (SELECT word, count(*) AS n FROM listed GROUP BY word) l
"""
)
def literal_word_count(spark: SparkSession, directory: str) -> DataFrame:
    """How often each word of a literal list is in the list, and in all documents."""
    words = EXAMPLE_WORDS + COMMON_WORDS
    listed = reduce.count_words(spark.createDataFrame([(w,) for w in words], "word string"))
    # The list is a literal, so it goes into the plan as one, and other words are not counted.
    found = reduce.count_words(_corpus_words(spark, directory).filter(F.col("word").isin(*words)))
    in_documents = F.coalesce("in_documents", F.lit(0)).cast("bigint").alias("in_documents")
    return (
        listed.withColumnRenamed("count", "listed")
        .join(found.withColumnRenamed("count", "in_documents"), "word", "left")
        .select("word", "listed", in_documents)
    )


@query(
    """
SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY event_type
"""
)
def reduce_by_key(spark: SparkSession, directory: str) -> DataFrame:
    events = tables.read(spark, directory, "events")
    summed = reduce.reduce_by_key(events, "event_type", cents("value"), "total")
    return summed.select("event_type", amount("total").alias("total"))


_WORD_TABLE = "word string, `count` bigint"


def _event_words(spark: SparkSession, directory: str) -> str:
    """A session view of (word, count) rows: every event's type and user."""
    view = workspace.fresh_name("word_rows")
    events = tables.read(spark, directory, "events")
    events.select(F.col("event_type").alias("word"), F.col("user_id").alias("count")).createOrReplaceTempView(view)
    return view


def _summary(spark: SparkSession, table: str) -> DataFrame:
    return sqljobs.run_sql(
        spark,
        f"SELECT word, sum(`count`) AS `count`, count(*) AS n_rows FROM {catalog.quoted(table)} GROUP BY word",
    )


@query(_WORD_COUNT_SQL)
def table_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """View, database, typed table, positional insert, and all rows read back."""
    view = workspace.fresh_name("word_rows")
    word_count(spark, directory).createOrReplaceTempView(view)
    database = catalog.create_scratch_database(spark, "round_trip")
    table = f"{database}.words"
    catalog.create_table(spark, table, _WORD_TABLE)
    catalog.append(spark, table, view)
    spark.catalog.dropTempView(view)
    return sqljobs.run_sql(spark, f"SELECT * FROM {catalog.quoted(table)}")


@query(_WORD_COUNT_SQL)
def catalog_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """The same through a three-part name and another table format."""
    database = catalog.create_scratch_database(spark, "catalog_trip")
    table = f"spark_catalog.{database}.words"
    catalog.create_table(spark, table, _WORD_TABLE, fmt="orc")
    catalog.append_rows(spark, table, word_count(spark, directory))
    return spark.table(table)


@query(
    """
SELECT event_type AS word, CAST(2 * sum(user_id) AS BIGINT) AS "count", 2 * count(*) AS n_rows
FROM events GROUP BY event_type
"""
)
def table_append_twice(spark: SparkSession, directory: str) -> DataFrame:
    view = _event_words(spark, directory)
    table = f"{catalog.create_scratch_database(spark, 'append_twice')}.words"
    catalog.create_table(spark, table, _WORD_TABLE)
    catalog.append(spark, table, view)
    catalog.append(spark, table, view)
    spark.catalog.dropTempView(view)
    return _summary(spark, table)


@query(
    """
SELECT event_type AS word, CAST(sum(user_id) AS BIGINT) AS "count", count(*) AS n_rows
FROM events GROUP BY event_type
"""
)
def table_reset_reload(spark: SparkSession, directory: str) -> DataFrame:
    view = _event_words(spark, directory)
    table = f"{catalog.create_scratch_database(spark, 'reset_reload')}.words"
    catalog.create_table(spark, table, _WORD_TABLE)
    catalog.append(spark, table, view)
    catalog.reset_table(spark, table)
    catalog.append(spark, table, view)
    spark.catalog.dropTempView(view)
    return _summary(spark, table)


def _table_counts_sql(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in names)


def _table_counts(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    counts = [
        spark.table(table).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, table in names.items()
    ]
    union = counts[0]
    for more in counts[1:]:
        union = union.unionByName(more)
    return union


@query(_table_counts_sql(tables.ALL_TABLES))
def dataset_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Every table of a benchmark directory, by its registered view, and its rows."""
    views = tables.register_views(spark, directory, prefix=f"{workspace.fresh_name('dataset')}_")
    counts = _table_counts(spark, views)
    for view in views.values():  # the counts know their files; only the names go
        spark.catalog.dropTempView(view)
    return counts


@query(
    f"""
SELECT 'star' AS database_name, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_tables
FROM ({_table_counts_sql(tables.STAR_TABLES)})
UNION ALL
SELECT 'activity', CAST(sum(n_rows) AS BIGINT), count(*)
FROM ({_table_counts_sql(tables.ACTIVITY_TABLES)})
"""
)
def list_databases(spark: SparkSession, directory: str) -> DataFrame:
    """Two databases over the given tables, found again in the list of databases."""
    run = f"{catalog.scratch_database(spark)}_{workspace.fresh_name('run')}"
    contents = {"star": tables.STAR_TABLES, "activity": tables.ACTIVITY_TABLES}
    counts = None
    for kind, names in contents.items():
        database = f"{run}_{kind}"
        catalog.create_database(spark, database, workspace.fresh_path(spark, database))
        catalog.register_dataset(spark, directory, database, names)
        held = _table_counts(spark, {name: f"{database}.{name}" for name in names})
        held = held.agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_tables"))
        held = held.withColumn("namespace", F.lit(database))
        counts = held if counts is None else counts.unionByName(held)
    listed = catalog.list_databases(spark, f"{run}_*")
    return listed.join(counts, "namespace").select(
        F.regexp_extract("namespace", "_([a-z]+)$", 1).alias("database_name"), "n_rows", "n_tables"
    )


@query(
    """
SELECT o_orderpriority AS priority, count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P'
GROUP BY o_orderpriority
"""
)
def sql_text_job(spark: SparkSession, directory: str) -> DataFrame:
    return sqljobs.run_sql(
        spark,
        """
        SELECT o_orderpriority AS priority, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM {orders}
        WHERE o_orderdate >= CAST(:first AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:end AS TIMESTAMP_NTZ)
          AND o_orderstatus <> :excluded
        GROUP BY o_orderpriority
        """,
        args={"first": "1997-01-01", "end": "1998-01-01", "excluded": "P"},
        orders=tables.read(spark, directory, "orders"),
    )
