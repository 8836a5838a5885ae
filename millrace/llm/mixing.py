"""Mixing sources to target weights by systematic sampling, with DataFrame operations alone.

Every document of a source has the same expected number of copies: the source's target over
its size. Documents are lined up within their source, their expected copies are added up
along the line, one random offset is added, and a document is taken once for each whole
number that its stretch reaches. Documents are lined up by size, so the sizes of those
taken follow the sizes of all closely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import ranks
from millrace.llm.store import written

#: A source's target is at most this many times its size, and so is what a document gives.
MOST_COPIES = 3
#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)

#: Classes of like sizes to a doubling of the size.
CLASSES = 16

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The number of words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` per source of ``sized(source, size)``.

    Sources share the sum of all sizes by weight. A target stops at ``most`` times its
    source's size, and what is left over is shared by the others in the same way until
    none is above. Sources are one row each by then: those are put in order of the level
    at which they stop, and the first that does not stop ends the search.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(int(w)) for w in weights))
    weighed = sources.withColumn(
        "weight", F.element_at(listed, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    )
    cap = F.col("source_size") * most
    # cap / weight as an exact order: sources stop one by one as the level rises.
    level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = level.rowsBetween(Window.unboundedPreceding, -1)
    later = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    told = weighed.select(
        "source",
        "source_size",
        "weight",
        cap.alias("cap"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(cap).over(earlier), F.lit(0)).alias("stopped"),
        F.sum("weight").over(later).alias("sharing"),
        F.row_number().over(level).alias("at"),
    ).withColumn("rest", F.col("total") - F.col("stopped"))

    def exact(name: str, digits: int) -> Column:
        return F.col(name).cast(f"decimal({digits},0)")

    # The first source whose share of the rest does not exceed its cap sets the level.
    fits = exact("rest", 20) * exact("weight", 17) <= exact("cap", 20) * exact("sharing", 17)
    first = F.min(F.when(fits, F.struct("at", "rest", "sharing"))).over(everything)
    levelled = told.withColumn("first", first)
    free = F.col("first").isNotNull() & (F.col("at") >= F.col("first.at"))
    share = (F.col("first.rest") * F.col("weight")).cast("double") / F.col("first.sharing").cast("double")
    return levelled.select("source", "source_size", F.when(free, share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: ``id_col, source_col, size, source_size, target, copies, taken``.

    ``size`` is the number of words, ``copies`` how often the mix has the document, ``taken``
    the words it takes: ``copies`` times ``size``, at most ``most`` times the size.

    * A null text has size 0. A source of size 0 has target 0 and gives no copies. Null
      sources are one source, the last by name.
    * Rows that repeat an id are documents of their own; rows alike in id, source and size
      are interchangeable. Ids may be null. An empty table gives no rows. Other columns are
      not looked at.
    * The same documents give the same mix, however they are partitioned.
    """
    sized = _sized(docs, id_col, source_col, text_col, seed)
    # A text is read for its size alone; what follows works on a slim table.
    slim = written(sized, "sizes")
    found = _copied(slim, slim, weights, most, seed)
    results = ["size", "source_size", "target", "copies", "taken"]
    return found.select(F.col("__id").alias(id_col), F.col("source").alias(source_col), *results)


def emit(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: each document, with all columns, as often as ``mix`` takes it. The
    cases that ``mix`` names are the same here."""
    slim = written(_sized(docs, id_col, source_col, text_col, seed), "sizes")
    rows = _sized(docs.withColumn("__row", F.struct(*docs.columns)), id_col, source_col, text_col, seed, "__row")
    taken = _copied(rows, slim, weights, most, seed).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str, *kept: str) -> DataFrame:
    """Documents with their size and what they are lined up by: a class of like sizes, and
    the hash of the id."""
    sized = docs.select(
        *kept, F.col(id_col).alias("__id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")
    )
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * CLASSES)).otherwise(-1).cast("int")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    return ranks.with_hash(sized.withColumn("__class", size_class), key)


def _copied(rows: DataFrame, slim: DataFrame, weights: Sequence[int], most: int, seed: str) -> DataFrame:
    order = [F.col("size"), F.col("__id").asc_nulls_first()]
    line = ranks.numbered(rows, slim, "source", ["__class"], order, "__place", targets(slim, weights, most))
    rate = F.col("target") / F.col("source_size").cast("double")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source").cast("string"), F.lit(""))).cast("binary")), 1, 5)
    offset = F.conv(digits, 16, 10).cast("double") / (1 << 20)
    reached = F.floor(offset + F.col("__place") * rate) - F.floor(offset + (F.col("__place") - 1) * rate)
    copies = F.when(F.col("source_size") > 0, F.least(reached, F.lit(most))).otherwise(0).cast("long")
    return line.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
