"""Sharding by rendezvous hashing over weighted shards, with DataFrame operations alone.

Each shard draws a number from the hash of a record's key and the shard's own number, and
the record goes to the shard whose draw, scaled by its weight, is the best. A shard's draws
do not depend on the others, so a new shard only takes records away from the old ones, and
a removed one only gives its own records back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import ranks
from millrace.llm.store import written

SHARDS = 16


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from a key and a shard: the first 13 digits of their MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, from 0 on. Shard ``i`` gets a share of the keys in proportion to
    ``weights[i]``; one of weight 0 gets none. Of equal draws the lower shard wins. A null
    key has a shard like any other."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    scores = [
        F.struct((F.log(draw(key, i)) / F.lit(float(w))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0
    ]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]).cast("int")


def assign(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    more: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned CRC-32 (0 for a
    null text, which has no bytes), ``law`` always ``key``: id and shard count decide, so
    equal texts need not share a shard. ``slot`` numbers the rows of a shard from 0 on
    without gaps, in an order that only the ids decide. ``grown_shard`` is the shard if
    there were one more, of weight ``more``.

    Rows that repeat an id, or have none, share its shard and have slots of their own. An
    empty table gives no rows. Other columns are not looked at.
    """
    key = F.col("__id")
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumns({"shard": shard_of(key, weights), "grown_shard": shard_of(key, [*weights, more])})
    # A text is read once; what follows works on a slim table.
    slim = written(ranks.with_hash(rows, key), "shards")
    placed = ranks.numbered(slim, slim, "shard", [], [key.asc_nulls_first(), F.col("text_crc32"), F.col("size")], "__slot")
    return placed.select(
        key.alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__slot") - 1).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id") -> None:
    """Write documents, all columns, into a folder per shard. Rows are rebalanced by shard,
    so a large shard is several files rather than one long task."""
    rows = docs.withColumn("shard", shard_of(F.col(id_col), weights))
    rows.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)
