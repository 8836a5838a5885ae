"""Exact interpolated percentiles per group, without gathering a group anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import running


def exact_percentiles(
    rows: DataFrame,
    groups: Sequence[str],
    value: str,
    wanted: dict[str, float],
    count_as: str | None = None,
) -> DataFrame:
    """One row per group with a column per wanted percentile (0..1), and with ``count_as``
    the number of values; NULL values are left out.

    Equal values are counted first, so repeated values cost one row each. The values at
    the two neighbouring ranks are then found by their running count.
    """
    counts = rows.groupBy(*groups, value).agg(F.count(value).alias("__n"))
    ranked = running.running_total(
        counts,
        groups,
        [F.col(value).asc_nulls_first()],
        {"__upto": F.col("__n")},
        totals=True,
    )

    found = []
    for name, share in wanted.items():
        place = (F.col("__upto_total") - 1) * F.lit(float(share))
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            covers = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
            found.append(F.max(F.when(covers, F.col(value))).alias(f"__{end}_{name}"))
        found.append(F.max(place - F.floor(place)).alias(f"__part_{name}"))
    counted = [count_as] if count_as else []
    found += [F.max("__upto_total").alias(count_as)] if count_as else []
    ends = ranked.groupBy(*groups).agg(*found)
    return ends.select(
        *groups,
        *counted,
        *(
            (F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")).alias(n)
            for n in wanted
        ),
    )
