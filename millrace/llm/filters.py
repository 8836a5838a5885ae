"""Rows that may have one of many ids, told apart without shuffling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map. As 64-bit words it is a table of 524,288 rows at most, 8 MB, however
#: many ids there are; that bound is what allows it to be broadcast.
BITS = 1 << 25


def free_names(columns: Sequence[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def maybe_in(rows: DataFrame, key: Column, ids: DataFrame, id_col: str) -> DataFrame:
    """Add ``__maybe``: false where ``key`` is surely none of the ids, true otherwise.

    Ids are hashed into a map of bits of a fixed size. It spares a join the rows that it
    would not match; what it lets through by chance, the join drops. With very many ids
    it lets more through, and the join does more of the work.
    """

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(BITS))

    bits = (
        ids.select(place(F.col(id_col)).alias("__place"))
        .groupBy(F.shiftright("__place", 6).alias("__word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__place & 63 as int))")).alias("__bits"))
    )
    marked = rows.withColumn("__at", place(key))
    joined = marked.join(F.broadcast(bits), F.shiftright("__at", 6) == F.col("__word"), "left")
    held = F.expr("coalesce(getbit(__bits, cast(__at & 63 as int)) = 1, false)")
    return joined.withColumn("__maybe", held).drop("__at", "__word", "__bits")
