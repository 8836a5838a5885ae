"""Word counts and sums by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words_of(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The blank-separated words of whole texts, one row each."""
    words = texts.select(F.explode(F.split(F.col(text_col), r"[ \t\r\n]+")).alias("word"))
    return words.filter(F.col("word") != "")


def count_words(words: DataFrame) -> DataFrame:
    """(word, count): every word is worth one, and equal words are summed."""
    return reduce_by_key(words.select("word", F.lit(1).cast("bigint").alias("one")), "word", F.col("one"), "count")


def reduce_by_key(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """The sum of a value per key. Each task sums its own rows first, so a hot key
    reaches the shuffle as one row per task."""
    return rows.groupBy(key).agg(F.sum(value).alias(name))
