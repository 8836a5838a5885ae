from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm.sampling import first_by_hash


def test_bounded_and_the_same_however_rows_are_dealt(spark):
    rows = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 60, "few"))
    one, two = (
        sorted((r.g, r.id, r["__at"]) for r in first_by_hash(rows.repartition(p), "g", F.col("id"), 100, 1).collect()) for p in (1, 7)
    )
    assert one == two
    assert [sum(r[0] == g for r in one) for g in ("hot", "few", None)] == [100, 20, 0]
    assert sorted(r[2] for r in one if r[0] == "hot") == list(range(1, 101))


def test_nothing_to_sample(spark):
    rows = spark.createDataFrame([(None, 1), (None, None)], "g string, id long")
    assert first_by_hash(rows, "g", F.col("id"), 5, 1).count() == 0
