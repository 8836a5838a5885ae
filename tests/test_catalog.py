from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from millrace import workspace
from millrace.operators import catalog, reduce, sqljobs
from millrace.plans.warehouse import EXAMPLE_WORDS
from millrace.sources import tables

# The rows of the warehouse example.
ROWS = [("Apple", 10), ("Banana", 20), ("Pear", 30)]
COLUMNS = "word string, `count` bigint"


@pytest.fixture
def database(spark):
    name = catalog.create_scratch_database(spark, "catalog_test")
    yield name
    catalog.reset_database(spark, name)


def contents(spark, table):
    return sorted(map(tuple, spark.table(table).collect()))


def test_word_count_example(spark):
    words = spark.createDataFrame([(w,) for w in EXAMPLE_WORDS], "word string")
    counted = reduce.count_words(words)
    assert {tuple(r) for r in counted.collect()} == {("apple", 2), ("banana", 1), ("hello", 1)}


def test_words_of_whole_texts(spark):
    texts = spark.createDataFrame([(" one\ttwo \n\n one two.",), ("",), (None,)], "text string")
    assert sorted(r.word for r in reduce.words_of(texts).collect()) == ["one", "one", "two", "two."]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
@pytest.mark.parametrize("prefix", ["", "spark_catalog."])
def test_warehouse_example(spark, database, fmt, prefix):
    spark.createDataFrame(ROWS, COLUMNS).createOrReplaceTempView("view_data")
    table = f"{prefix}{database}.table_01"
    catalog.create_table(spark, table, COLUMNS, fmt)
    catalog.create_table(spark, table, COLUMNS, fmt)  # a table that exists is left alone
    catalog.append(spark, table, "view_data")
    assert contents(spark, table) == ROWS
    assert spark.table(table).dtypes == [("word", "string"), ("count", "bigint")]
    catalog.append(spark, table, "view_data")
    assert contents(spark, table) == sorted(ROWS * 2)
    catalog.reset_table(spark, table)
    assert contents(spark, table) == []
    catalog.append(spark, table, "view_data")
    assert contents(spark, table) == ROWS


def test_append_is_positional(spark, database):
    table = f"{database}.t"
    catalog.create_table(spark, table, "a string, b string")
    catalog.append_rows(spark, table, spark.createDataFrame([("1", "2")], "b string, a string"))
    assert contents(spark, table) == [("1", "2")]


def test_unknown_format_is_sparks_own_error(spark, database):
    with pytest.raises(Exception, match="(?i)iceberg"):
        catalog.create_table(spark, f"{database}.t", COLUMNS, "iceberg")


def test_databases_are_listed_and_reset(spark, database):
    assert database in {r.namespace for r in catalog.list_databases(spark).collect()}
    assert [r.namespace for r in catalog.list_databases(spark, f"{database}*").collect()] == [database]
    catalog.create_table(spark, f"{database}.t", COLUMNS)
    catalog.create_database(spark, database)
    catalog.reset_database(spark, database)
    assert catalog.list_databases(spark, database).collect() == []
    catalog.reset_database(spark, database)


def test_dataset_becomes_a_database(spark, database):
    catalog.register_dataset(spark, "/root/testdata/sf0.001", database, tables.STAR_TABLES)
    held = spark.sql(f"SHOW TABLES IN {database}").filter("NOT isTemporary")
    assert {r.tableName for r in held.collect()} == set(tables.STAR_TABLES)
    assert spark.table(f"{database}.nation").count() == 25


def test_sql_arguments_are_values(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    found = sqljobs.run_sql(spark, "SELECT * FROM {rows} WHERE word = :w", {"w": "Pear' OR 'a' = 'a"}, rows=rows)
    assert found.collect() == []
    assert sqljobs.run_sql(spark, "show databases").columns == ["namespace"]
    with pytest.raises(AnalysisException):
        sqljobs.run_sql(spark, "SELECT * FROM nowhere.table_01")


def test_shared_folder(spark):
    class Session:
        def __init__(self, **known):
            self.conf = self
            self.known = known

        def get(self, name, default=None):
            return self.known.get(name, default)

    warehouse = {"spark.sql.warehouse.dir": "hdfs://nn/warehouse/"}
    assert workspace.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert workspace.shared_folder(Session(**warehouse, **{"spark.checkpoint.dir": "hdfs://nn/shared/"})) == "hdfs://nn/shared"
    # Without the setting, a restarted job in another process still finds its own path.
    assert workspace.job_path(Session(**warehouse), "job", "checkpoint") == "hdfs://nn/warehouse/millrace/jobs/job/checkpoint"


def test_scratch_is_dropped_whole(spark):
    from millrace.plans import QUERIES

    catalog.drop_scratch(spark)
    before = {r.namespace for r in spark.sql("SHOW DATABASES").collect()}
    views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    for name in ("table_round_trip", "dataset_tables", "list_databases", "ds_running_sum"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} == views
    assert catalog.drop_scratch(spark) > 0
    assert {r.namespace for r in spark.sql("SHOW DATABASES").collect()} == before
