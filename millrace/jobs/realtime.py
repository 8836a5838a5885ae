"""spark-submit job: keep a real-time table from its JSON declarations.

    spark-submit --packages <kafka and avro of this Spark> millrace/jobs/realtime.py \\
        --schemaFile flights_schema.json --tableConfigFile flights_table_config.json --database realtime

Topic, servers, message format, first offset, segment size and time, retention and index
columns come from the declarations. Messages that do not decode are kept in a table of the
same name with the ending _quarantine. Expired days are dropped when the job starts; run it
with --expireOnly to do no more than that, for instance once a day, and with --compactOnly to
merge the batches of the days before as well. What a merge replaces stays for a day, for the
queries that still read it.
"""

from __future__ import annotations

import argparse
import datetime as dt
from pathlib import Path

from pyspark.sql import SparkSession

from millrace import schemas, workspace
from millrace.jobs.ingest import source_options
from millrace.operators import catalog
from millrace.sources import topics
from millrace.streaming import compaction, ingest, realtime


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--schemaFile", required=True)
    parser.add_argument("--tableConfigFile", required=True)
    parser.add_argument("--database", required=True)
    parser.add_argument("--topicFolder", help="replay a topic kept as Parquet files, up to its end")
    parser.add_argument("--kafkaOption", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--expireOnly", action="store_true")
    parser.add_argument("--compactOnly", action="store_true")
    parser.add_argument("--asOf", type=dt.date.fromisoformat, help="the day retention counts from; today (UTC) by default")
    return parser.parse_args(arguments)


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    config = Path(chosen.tableConfigFile).read_text()
    declared = schemas.table_schema(Path(chosen.schemaFile).read_text(), config)
    source = schemas.stream_config(config)
    table = f"{chosen.database}.{declared.name}"
    catalog.create_database(spark, chosen.database)
    realtime.create_declared(spark, table, declared)
    now = dt.datetime.now(dt.timezone.utc)
    as_of = chosen.asOf or now.date()
    realtime.expire_declared(spark, table, declared, as_of)
    if chosen.compactOnly:
        compaction.drop_replaced(spark, table, now - dt.timedelta(days=1))
        compaction.compact(spark, table, as_of, declared.cluster_by)
    if chosen.expireOnly or chosen.compactOnly:
        return
    messages = topics.read_topic(
        spark,
        source.topic,
        servers=None if chosen.topicFolder else source.servers,
        folder=chosen.topicFolder,
        starting=source.starting,
        options=source_options(chosen.kafkaOption),
    )
    query = realtime.ingest_declared(
        messages,
        table,
        declared,
        workspace.job_path(spark, f"{chosen.database}-{declared.name}", "checkpoint"),
        trigger_seconds=None if chosen.topicFolder else source.segment_seconds,
        message_format=source.message_format,
    )
    ingest.run_to_end(query)


if __name__ == "__main__":
    run(SparkSession.builder.appName("Real-time table").enableHiveSupport().getOrCreate(), options())
