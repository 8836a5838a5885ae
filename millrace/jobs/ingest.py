"""spark-submit job: a Kafka topic into a table of a database, one table per topic.

    spark-submit --packages <kafka source of this Spark> millrace/jobs/ingest.py \\
        --bootstrapServers host:9092 --database ingestion --topic topic_01 \\
        --triggerSeconds 20 --printTableData true --kafkaOption kafka.security.protocol=SASL_SSL

A run with the same --id takes up where the last one stopped. A run of the same id and
topic that is still going on in another application must be stopped first.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace import workspace
from millrace.operators import catalog
from millrace.sources import topics
from millrace.streaming import ingest

PRINTED_ROWS = 20


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--id", default="kafka-ingestion", help="name of the job and of its checkpoint")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--bootstrapServers")
    source.add_argument("--topicFolder", help="replay a topic kept as Parquet files")
    parser.add_argument("--database", required=True)
    parser.add_argument("--topic", required=True)
    parser.add_argument("--triggerSeconds", type=float, help="without it, the job ends at the topic's end")
    parser.add_argument("--printTableData", choices=("true", "false"), default="false")
    parser.add_argument("--kafkaOption", action="append", default=[], metavar="NAME=VALUE")
    return parser.parse_args(arguments)


def source_options(pairs: list[str]) -> dict[str, str]:
    """NAME=VALUE pairs; a value may hold further equals signs."""
    found = {}
    for pair in pairs:
        name, equals, value = pair.partition("=")
        if not equals:
            raise ValueError(f"expected NAME=VALUE, got {pair!r}")
        found[name] = value
    return found


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    catalog.create_database(spark, chosen.database)
    table = f"{chosen.database}.{chosen.topic}"
    messages = topics.read_topic(
        spark,
        chosen.topic,
        servers=chosen.bootstrapServers,
        folder=chosen.topicFolder,
        options=source_options(chosen.kafkaOption),
    )
    query = ingest.ingest_topic(
        messages,
        table,
        workspace.job_path(spark, f"{chosen.id}-{chosen.topic}", "checkpoint"),
        trigger_seconds=chosen.triggerSeconds,
        name=chosen.id,
    )
    if chosen.printTableData == "true":
        ingest.print_batches(spark, query, table, PRINTED_ROWS)
    else:
        ingest.run_to_end(query)


if __name__ == "__main__":
    run(SparkSession.builder.appName("Topic ingestion").enableHiveSupport().getOrCreate(), options())
