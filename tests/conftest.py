from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    changed = {}

    def set_conf(name, value):
        changed.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield set_conf
    for name, value in changed.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def oracle(directory: str):
    from millrace.sources import tables

    connection = duckdb.connect()
    for name in tables.ALL_TABLES:
        if Path(tables.location(directory, name)).exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables.location(directory, name)}'")
    return connection


def values(rows, columns):
    """Rows as sorted tuples, columns by name; None sorts with everything."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def assert_same(frame, expected):
    """A DataFrame and an oracle relation: same columns, same rows, equal to the last digit."""
    assert sorted(frame.columns) == sorted(expected.columns)
    assert values(frame.collect(), frame.columns) == values(expected.fetchall(), expected.columns)
