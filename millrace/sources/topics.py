"""Topics: ordered logs of key/value records in the columns of Spark's Kafka source.

A topic is read from Kafka when ``servers`` is given, and otherwise from a folder of
Parquet files that have the same columns, which is how topics are replayed and tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)


def records(
    rows: DataFrame,
    topic: str,
    key: Column,
    value: Column,
    offset: Column,
    timestamp: Column,
    partitions: int = 1,
) -> DataFrame:
    """Rows as topic records. Records with one key share a partition."""
    return rows.select(
        key.cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(F.hash(key.cast("string")), F.lit(partitions)).alias("partition"),
        offset.cast("bigint").alias("offset"),
        timestamp.cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def publish_to_kafka(messages: DataFrame, servers: str, topic: str, options: dict[str, str] | None = None) -> None:
    """Append messages (``value``, and ``key`` if they have one) to a Kafka topic; the broker
    assigns partitions and offsets."""
    (
        messages.select(*(c for c in ("key", "value") if c in messages.columns))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .options(**(options or {}))
        .save()
    )


def publish_to_folder(messages: DataFrame, folder: str, files: int | None = None) -> None:
    """Append records to a folder topic; with ``files``, in exactly so many files of like size,
    which a stream can count (``maxFilesPerTrigger``).

    Spark writes no file without rows, so each of these files has a record without a topic,
    which no reader of a topic sees.
    """
    writer = messages.write
    if files is not None:
        # Rows of a partition are dealt in turn, so each file gets one of these.
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in messages.schema.fields]
        spare = messages.sparkSession.range(0, files, 1, 1).select(*nothing)
        writer = messages.unionByName(spare).repartition(files).write.option("maxRecordsPerFile", 0)
    writer.mode("append").parquet(folder)


def read_topic(
    spark: SparkSession,
    topic: str,
    servers: str | None = None,
    folder: str | None = None,
    starting: str = "earliest",
    options: dict[str, str] | None = None,
    streaming: bool = True,
) -> DataFrame:
    """A topic's records. ``options`` are passed on to the source, ``kafka.*`` ones included;
    with Kafka, ``minPartitions`` splits a hot topic partition over several tasks."""
    if (servers is None) == (folder is None):
        raise ValueError("name either the Kafka servers or a folder")
    reader = spark.readStream if streaming else spark.read
    if servers is not None:
        return (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting)
            .options(**(options or {}))
            .load()
        )
    if starting != "earliest":
        raise ValueError("a folder topic is always read from its start")
    return reader.schema(RECORD).options(**(options or {})).parquet(folder).filter(F.col("topic") == topic)
