"""Z-order: rows laid out so that a filter on any one of several columns skips most files.

Sorting by (a, b) leaves files that a filter on b cannot skip. Here each column is cut into
cells that hold about equally many rows, and the bits of the cells' numbers are interleaved:
rows whose keys are near each other are near in every column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A column is cut into 2^BITS cells, so at most 255 borders a column reach the driver.
BITS = 8
Z_KEY = "__z"


def ordinal(rows: DataFrame, name: str) -> Column:
    """A column as a number of the same order: texts by their first six bytes."""
    kind = rows.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.substring(F.rpad(F.encode(column, "UTF-8"), 6, F.unhex(F.lit("00"))), 1, 6)), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return column.cast("double")


def borders(rows: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list[float]]:
    """Where the cells of each column begin, by sketched quantiles of all rows. Repeated
    borders of frequent values are merged."""
    cells = 1 << bits
    shares = [i / cells for i in range(1, cells)]
    found = rows.agg(*(F.percentile_approx(ordinal(rows, c), shares, 10 * cells).alias(f"c{i}") for i, c in enumerate(columns)))
    row = found.first()
    return {c: sorted(set(row[f"c{i}"] or [])) for i, c in enumerate(columns)}


def with_key(rows: DataFrame, columns: Sequence[str], cuts: dict[str, list[float]], bits: int = BITS) -> DataFrame:
    """Add the interleaved cell numbers (``Z_KEY``), the first column's bits highest. A null is
    in the first cell."""
    if len(columns) * bits > 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit a key")
    # Each cell is worked out once and then taken apart.
    cells = {f"__cell_{i}": _cell(ordinal(rows, c), cuts[c], bits) for i, c in enumerate(columns)}
    return rows.withColumns(cells).withColumn(Z_KEY, _interleaved(list(cells), bits)).drop(*cells)


def _cell(value: Column, cuts: list[float], bits: int) -> Column:
    """How many borders are at most ``value``, found by halving."""
    if not cuts:
        return F.lit(0).cast("bigint")
    held = F.array(*(F.lit(float(c)) for c in cuts))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))

    def halve(at: Column, step: Column) -> Column:
        further = at + step
        return F.when((further <= len(cuts)) & (value >= F.get(held, further - 1)), further).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve).cast("bigint")


def write_clustered(
    rows: DataFrame, path: str, columns: Sequence[str], max_rows: int, partitioned_by: Sequence[str] = (), bits: int = BITS
) -> None:
    """Write rows in the order of their key, no file above ``max_rows`` rows. One pass finds
    the borders and one range shuffle lays the rows out; a hot value is cut by a hash of the
    row, so that it is not one task."""
    cuts = borders(rows, columns, bits)
    laid = with_key(rows, columns, cuts, bits)
    by = [F.col(f"`{c}`") for c in partitioned_by]
    ranged = laid.repartitionByRange(*by, Z_KEY, F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    writer = ranged.sortWithinPartitions(*by, Z_KEY).drop(Z_KEY).write.mode("append").option("maxRecordsPerFile", max_rows)
    (writer.partitionBy(*partitioned_by) if partitioned_by else writer).parquet(path)


def _interleaved(cells: Sequence[str], bits: int) -> Column:
    key = F.lit(0).cast("bigint")
    for place, name in enumerate(cells):
        for bit in range(bits):
            one = F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(cells) + len(cells) - 1 - place))
    return key
