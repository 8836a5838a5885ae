"""spark-submit job: summarise a folder of event logs into Parquet tables.

    spark-submit millrace/jobs/history.py --logs s3a://bucket/event-logs --out s3a://bucket/history
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.operators import joblog
from millrace.sources import eventlog

SUMMARIES = {"applications": joblog.applications, "stages": joblog.stages, "task_skew": joblog.task_skew}


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--logs", required=True)
    parser.add_argument("--out", required=True)
    return parser.parse_args(arguments)


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    events = eventlog.read_event_log(spark, chosen.logs)
    for name, summary in SUMMARIES.items():
        summary(events).write.mode("overwrite").parquet(f"{chosen.out}/{name}")


if __name__ == "__main__":
    run(SparkSession.builder.appName("Job history").getOrCreate(), options())
