"""spark-submit job: time the decision-support pack over a benchmark directory.

    spark-submit millrace/jobs/decision_pack.py --data-location s3a://bucket/benchmark

Every result is computed whole and thrown away; one JSON line is printed per query.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession

from millrace.plans import QUERIES

PREFIX = "ds_"


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--data-location", required=True)
    parser.add_argument("--query-filter", default="", help="comma-separated names; all without it")
    return parser.parse_args(arguments)


def timings(spark: SparkSession, location: str, names: list[str]) -> Iterator[tuple[str, float]]:
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, location).write.format("noop").mode("overwrite").save()
        yield name, time.perf_counter() - started


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    names = [n for n in chosen.query_filter.split(",") if n] or [n for n in QUERIES if n.startswith(PREFIX)]
    for name, seconds in timings(spark, chosen.data_location, names):
        print(json.dumps({"query": name, "sec": round(seconds, 3)}), flush=True)


if __name__ == "__main__":
    run(SparkSession.builder.appName("Decision-support pack").getOrCreate(), options())
