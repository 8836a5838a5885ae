"""Sessions: events of a user with less than a gap between one and the next.

In batch, events are cut into slices by user and time. Sessions are merged within slices
first; then only a slice's first and last session of a user that reaches beyond the slice
can be part of a longer one, and those are linked through a table of two rows per slice. So
a user with most of the events is many tasks. ``streaming.windows`` keeps the same sessions
by a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import workspace
from millrace.operators.carry import same_slice
from millrace.operators.running import SLICE, slices


def merged_sessions(events: DataFrame, users: Sequence[str], at: str, gap_seconds: float, sums: dict[str, Column]) -> DataFrame:
    """One row per session: the ``users`` columns, ``session_start`` (its first event),
    ``session_end`` (the gap after its last one), ``n`` (events) and the sums.

    An event that comes the gap after the one before, or later, starts a new session. Events
    without a time belong to none; events without a user are one user's.
    """
    keys = list(users)
    gap = F.make_dt_interval(secs=F.lit(gap_seconds).cast("decimal(18,6)"))
    cut = slices(events.filter(F.col(at).isNotNull()), keys, [F.col(at).asc()])
    within = Window.partitionBy(SLICE, *keys).orderBy(at)
    before = F.lag(at).over(within)
    starts = F.when(before.isNull() | (F.col(at) >= before + gap), F.col(at))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("__starts", starts).withColumn("__start", F.last("__starts", ignorenulls=True).over(upto))
    local = workspace.written(
        placed.groupBy(SLICE, *keys, "__start").agg(
            F.max(at).alias("__last"), F.count("*").alias("n"), *(F.sum(value).alias(name) for name, value in sums.items())
        ),
        "sessions",
    )

    parts = local.groupBy(*keys, SLICE).agg(
        F.min("__start").alias("__first"), F.max("__start").alias("__latest"), F.max("__last").alias("__last"), F.count("*").alias("__many")
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    reaching = parts.withColumns({"__slices": F.count("*").over(group), "__before": F.max("__last").over(earlier)}).filter("__slices > 1")
    goes_on = F.col("__first") < F.col("__before") + gap
    # A part whose only session goes on has no start of its own to hand on.
    begun = F.when(~F.coalesce(goes_on, F.lit(False)) | (F.col("__many") > 1), F.col("__latest"))
    chained = reaching.withColumn("__begun", begun).withColumn("__chain", F.last("__begun", ignorenulls=True).over(earlier))
    carried = chained.filter(goes_on).select(*(F.col(k).alias(f"__of_{k}") for k in (*keys, SLICE)), F.col("__first").alias("__head"), "__chain")

    first = same_slice(keys, "__of_") & (F.col("__start") == F.col("__head"))
    whole = local.join(F.broadcast(carried), first, "left").withColumn("session_start", F.coalesce("__chain", "__start"))
    return (
        whole.groupBy(*keys, "session_start")
        .agg((F.max("__last") + gap).alias("session_end"), F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums))
        .select(*keys, "session_start", "session_end", "n", *sums)
    )
