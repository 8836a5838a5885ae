"""spark-submit job: run one SQL text and show the first rows of its result.

    spark-submit millrace/jobs/run_sql.py --sql "show databases"
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.operators import sqljobs


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--sql", required=True)
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    return parser.parse_args(arguments)


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    sqljobs.run_sql(spark, chosen.sql).show(chosen.rows, truncate=False)


if __name__ == "__main__":
    run(SparkSession.builder.appName("SQL text").enableHiveSupport().getOrCreate(), options())
