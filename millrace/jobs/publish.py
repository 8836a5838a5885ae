"""spark-submit job: the rows of files into a Kafka topic, as JSON or Avro messages.

    spark-submit --packages <kafka and avro of this Spark> millrace/jobs/publish.py \\
        --input s3a://bucket/flights.avro --inputFormat avro \\
        --bootstrapServers host:9092 --topic flights-realtime --outputFormat json
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import decode
from millrace.jobs.ingest import source_options
from millrace.sources import tables, topics

DECLARED = {s.name: s for s in (schemas.FLIGHTS, schemas.MERGED_CHANGES)}


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", required=True)
    parser.add_argument("--inputFormat", default="parquet")
    parser.add_argument("--bootstrapServers", required=True)
    parser.add_argument("--topic", required=True)
    parser.add_argument("--outputFormat", choices=("json", "avro"), default="json")
    parser.add_argument("--schema", choices=sorted(DECLARED), help="publish the fields of this declared schema only")
    parser.add_argument("--key", help="column whose value is the message key")
    parser.add_argument("--kafkaOption", action="append", default=[], metavar="NAME=VALUE")
    return parser.parse_args(arguments)


def messages(rows: DataFrame, output: str, schema: str | None = None, key: str | None = None) -> DataFrame:
    """One message per row, with a key if a column is named for it."""
    declared = DECLARED[schema] if schema else None
    key_columns = [F.col(key).cast("string").alias("key")] if key else []
    if declared is None:
        if output == "avro":
            raise ValueError("Avro messages need a declared schema")
        return rows.select(*key_columns, decode.encode_json("*").alias("value"))
    row = F.struct(*decode.projected(rows, declared.struct()))
    value = F.to_json(row, decode.JSON_OPTIONS) if output == "json" else decode.encode_avro(row, declared.avro())
    return rows.select(*key_columns, value.alias("value"))


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    rows = tables.read_files(spark, chosen.input, chosen.inputFormat)
    encoded = messages(rows, chosen.outputFormat, chosen.schema, chosen.key)
    topics.publish_to_kafka(encoded, chosen.bootstrapServers, chosen.topic, source_options(chosen.kafkaOption))


if __name__ == "__main__":
    run(SparkSession.builder.appName("Publish to a topic").getOrCreate(), options())
