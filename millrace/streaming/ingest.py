"""A topic into a table, continuously or up to its end, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.functions import decode


def triggered(writer: DataStreamWriter, seconds: float | None) -> DataStreamWriter:
    """Every so many seconds, or, without them, once over all there is."""
    if seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{seconds} seconds")


def run_to_end(query: StreamingQuery) -> None:
    """Wait for a query that ends by itself; its failure is raised here."""
    query.awaitTermination()


def stop_named(spark: SparkSession, name: str) -> None:
    """Stop this session's running query of that name, so that it can be replaced."""
    for query in spark.streams.active:
        if query.name == name:
            query.stop()


def table_rows(messages: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """What a topic's table holds: the record's columns, or with a schema the decoded fields
    and the record they came from (``record``).

    An undecodable value stays in the table as a record whose fields are NULL.
    """
    if schema is None:
        return messages
    parsed = decode.parse_json(messages, schema)
    fields = (F.col(f"row.`{f.name}`") for f in schema.fields)
    return parsed.select(*fields, F.struct(*messages.columns).alias("record"))


def ingest_topic(
    messages: DataFrame,
    table: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    trigger_seconds: float | None = None,
    name: str | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append a topic to a table.

    The checkpoint remembers what is done: a restarted job goes on where it stopped, and
    the file sink's own log keeps a half-written batch out of the table.
    """
    rows = table_rows(messages, schema)
    if name:
        stop_named(rows.sparkSession, name)
    writer = rows.writeStream.format(fmt).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return triggered(writer, trigger_seconds).toTable(table)


def print_batches(spark: SparkSession, query: StreamingQuery, table: str, rows: int, every_seconds: float = 1.0) -> None:
    """Show some rows of what each new batch added to the table, until the query ends; its
    failure is raised here.

    The topic is not read again: rows come out of the table's newest files, and no more
    than ``rows`` of them reach the driver. Batches that end close together are shown as one.
    """
    seen: tuple | None = None
    ended = False
    while not ended:
        ended = query.awaitTermination(every_seconds)
        done = [p for p in query.recentProgress if p.numInputRows]
        latest = (done[-1].batchId, done[-1].timestamp) if done else None
        if latest and latest != seen:
            since = next(p.timestamp for p in done if seen is None or p.batchId > seen[0])
            spark.catalog.refreshTable(table)
            fresh = spark.table(table).filter(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
            fresh.limit(rows).show(rows, truncate=False)
            seen = latest


def ingest_with_quarantine(
    messages: DataFrame,
    schema: T.StructType,
    folder: str,
    checkpoint: str,
    trigger_seconds: float | None = None,
) -> StreamingQuery:
    """Append decoded rows and, apart from them, the raw values that do not decode.

    Both go out in one pass over the topic and one commit per batch, as two partitions
    (``quarantined``) of one folder, so neither can be ahead of the other.
    """
    parsed = decode.parse_json(messages, schema)
    broken = F.col(decode.CORRUPT).isNotNull()
    rows = parsed.select(
        *(F.when(~broken, F.col(f"row.`{f.name}`")).alias(f.name) for f in schema.fields),
        F.col(decode.CORRUPT).alias("raw_value"),
        broken.alias("quarantined"),
    )
    writer = rows.writeStream.format("parquet").partitionBy("quarantined").option("checkpointLocation", checkpoint)
    return triggered(writer, trigger_seconds).start(folder)


def read_quarantine(spark: SparkSession, schema: T.StructType, folder: str) -> tuple[DataFrame, DataFrame]:
    """The good rows and the quarantined raw values; each reads its own partition only."""
    stored = T.StructType(
        [*schema.fields, T.StructField("raw_value", T.StringType()), T.StructField("quarantined", T.BooleanType())]
    )
    landed = spark.read.schema(stored).parquet(folder)
    good = landed.filter(~F.col("quarantined")).select(*(f"`{f.name}`" for f in schema.fields))
    return good, landed.filter("quarantined").select("raw_value")
