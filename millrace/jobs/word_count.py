"""spark-submit job: count the words of text files and append them to a table.

    spark-submit millrace/jobs/word_count.py --input s3a://bucket/texts --table catalog.db.words --format parquet

The database and the table are created if they are missing. Without --table, the most
frequent words are shown instead.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog, reduce
from millrace.sources import tables

COLUMNS = "word string, `count` bigint"


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", required=True)
    parser.add_argument("--table", help="database.table or catalog.database.table")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    return parser.parse_args(arguments)


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    lines = tables.read_files(spark, chosen.input, "text")
    counted = reduce.count_words(reduce.words_of(lines, "value"))
    if chosen.table is None:
        counted.orderBy(F.desc("count"), "word").show(chosen.rows, truncate=False)
        return
    if database := chosen.table.rpartition(".")[0]:
        catalog.create_database(spark, database)
    catalog.create_table(spark, chosen.table, COLUMNS, chosen.format)
    catalog.append_rows(spark, chosen.table, counted)


if __name__ == "__main__":
    run(SparkSession.builder.appName("Word count").enableHiveSupport().getOrCreate(), options())
