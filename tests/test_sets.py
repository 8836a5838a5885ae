from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import sets

LEFT = [("a", 1), ("a", 1), ("b", 2), (None, 3), ("d", None)] + [("hot", 0)] * 500
RIGHT = [("a", 1), ("c", 2), (None, 3), ("d", None), ("hot", 0)]


def frames(spark):
    return spark.createDataFrame(LEFT, "k string, v int"), spark.createDataFrame(RIGHT, "k string, v int")


def rows(frame):
    return {tuple(r) for r in frame.collect()}


def test_intersect_and_subtract(spark):
    left, right = frames(spark)
    assert rows(sets.intersect(left, right)) == set(LEFT) & set(RIGHT)
    assert rows(sets.subtract(left, right)) == set(LEFT) - set(RIGHT)
    assert rows(sets.subtract(right, left)) == set(RIGHT) - set(LEFT)
    assert rows(sets.intersect(left, right)) == rows(left.intersect(right))


def test_row_differences_count_copies(spark):
    left, right = frames(spark)
    ours = {(r.k, r.v): r.left_copies - r.right_copies for r in sets.row_differences(left, right).collect()}
    expected = Counter(LEFT)
    expected.subtract(Counter(RIGHT))
    assert ours == {k: n for k, n in expected.items() if n}
    assert sets.row_differences(left, left.orderBy(F.rand())).count() == 0
