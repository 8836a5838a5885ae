from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import workspace
from millrace.operators import carry, catalog, intervals, panes, sessions
from millrace.streaming import ingest, windows

START = dt.datetime(2024, 1, 1)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def hot(n, seed=1):
    """A third of the rows in one group, some without one."""
    rng = random.Random(seed)
    return ["hot" if i % 3 == 0 else None if i % 40 == 1 else f"g{rng.randrange(60)}" for i in range(n)]


def test_last_before_in_a_hot_group(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(100) if rng.random() < 0.01 else None) for i, g in enumerate(hot(3000))]
    frame = spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(5)
    found = carry.last_before(frame, ["g"], ["o"], {"before": F.col("v")})
    assert found.columns == ["g", "o", "v", "before"]
    seen, expected = {}, set()
    for g, o, v in rows:
        expected.add((g, o, v, seen.get(g)))
        seen[g] = v if v is not None else seen.get(g)
    assert {tuple(r) for r in found.collect()} == expected
    slices = {r[0] for r in found.filter("g = 'hot'").select(F.spark_partition_id()).distinct().collect()}
    assert len(slices) > 1


LEFT, RIGHT = "k string, t bigint, id bigint, right string", "k string, t bigint, id bigint, v string"


def asof(left, right, inclusive=True):
    out = Counter()
    for row in left:
        best = None
        for other in right:
            if row[0] == other[0] and row[1] is not None and other[1] is not None and (other[1] < row[1] or (inclusive and other[1] == row[1])):
                if best is None or (other[1], other[2]) > (best[1], best[2]):
                    best = other
        out[(*row, best)] += 1
    return out


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_join(spark, inclusive):
    rng = random.Random(3)
    left = [(g, rng.randrange(300) if i % 50 else None, i, "own") for i, g in enumerate(hot(700, 4))]
    right = [(g, rng.randrange(300) if i % 60 else None, i, f"v{i}") for i, g in enumerate(hot(500, 5))]
    left += [left[5], left[5]]
    frames = spark.createDataFrame(left, LEFT).repartition(4), spark.createDataFrame(right, RIGHT).repartition(3)
    joined = carry.asof_join(*frames, ["k"], "t", "t", "id", inclusive)
    assert joined.columns == ["k", "t", "id", "right", "right"]
    found = Counter((*r[:4], tuple(r[4]) if r[4] else None) for r in map(tuple, joined.collect()))
    assert found == asof(left, right, inclusive)
    plan = plan_of(joined)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan


def test_asof_join_of_empty_sides(spark):
    some, none = spark.createDataFrame([("a", 1, 1, "x")], LEFT), spark.createDataFrame([], RIGHT)
    assert [r[4] for r in carry.asof_join(some, none, ["k"], "t", "t", "id").collect()] == [None]
    assert carry.asof_join(none, some, ["k"], "t", "t", "id").collect() == []


def plain_sessions(rows, gap):
    out = Counter()
    for user in {r[0] for r in rows}:
        times = sorted((t, v) for u, t, v in rows if u == user and t is not None)
        own = []
        for t, v in times:
            if own and t < own[-1][1] + gap:
                own[-1] = [own[-1][0], t, own[-1][2] + 1, own[-1][3] + v]
            else:
                own.append([t, t, 1, v])
        out.update((user, s, e + gap, n, total) for s, e, n, total in own)
    return out


@pytest.mark.parametrize("gap", [1, 40, 100_000])
def test_sessions_of_a_hot_user(spark, gap):
    """With the widest gap the hot user's only session spans all slices."""
    rng = random.Random(6)
    rows = [(g, START + dt.timedelta(seconds=rng.randrange(20_000)) if i % 70 else None, rng.randrange(9)) for i, g in enumerate(hot(2500, 7))]
    rows += [("edge", START, 1), ("edge", START + dt.timedelta(seconds=gap), 1), ("edge", START + dt.timedelta(seconds=gap), 1)]
    frame = spark.createDataFrame(rows, "u string, t timestamp_ntz, v int").repartition(6)
    found = sessions.merged_sessions(frame, ["u"], "t", gap, {"total": F.col("v")})
    assert found.columns == ["u", "session_start", "session_end", "n", "total"]
    assert Counter(tuple(r) for r in found.collect()) == plain_sessions(rows, dt.timedelta(seconds=gap))
    assert sessions.merged_sessions(frame.limit(0), ["u"], "t", gap, {}).collect() == []


def test_events_are_shuffled_once_for_sessions(spark):
    rows = [(g, START + dt.timedelta(seconds=i)) for i, g in enumerate(hot(500))]
    found = sessions.merged_sessions(spark.createDataFrame(rows, "u string, t timestamp_ntz"), ["u"], "t", 5, {})
    # Events were cut into slices and merged there; what is left reads merged sessions alone.
    assert "session" in plan_of(found) and "/slices-" not in plan_of(found)


SPANS = "k string, a bigint, b bigint, id bigint"


def spans(n, seed):
    rng = random.Random(seed)
    out = []
    for i, g in enumerate(hot(n, seed)):
        a = rng.randrange(-200, 500)
        out.append((g, a if i % 45 else None, a + rng.choice([-1, 0, 1, 3, 10, 150]) if i % 47 else None, i))
    return out


@pytest.mark.parametrize("width, part", [(1, 10_000), (16, 10_000), (16, 5), (1000, 7)])
def test_overlapping_intervals(spark, width, part):
    left, right = spans(240, 8), spans(260, 9)
    left.append(left[3])
    frames = spark.createDataFrame(left, SPANS).repartition(3), spark.createDataFrame(right, SPANS).repartition(4)
    found = intervals.overlapping(*frames, ["k"], ("a", "b"), ("a", "b"), width, part)
    pairs = Counter((tuple(r.left), tuple(r.right)) for r in found.collect())
    usable = [[r for r in side if None not in r[:3] and r[1] < r[2]] for side in (left, right)]
    assert pairs == Counter((x, y) for x in usable[0] for y in usable[1] if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("whole, part", [(0, 10_000), (0, 5), (12, 3)])
def test_overlapping_intervals_of_large_keys(spark, whole, part):
    left, right = spans(120, 8), spans(130, 9)
    frames = spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)
    found = intervals.overlapping(*frames, ["k"], ("a", "b"), ("a", "b"), 16, part, whole)
    pairs = Counter((tuple(r.left), tuple(r.right)) for r in found.collect())
    usable = [[r for r in side if None not in r[:3] and r[1] < r[2]] for side in (left, right)]
    assert pairs == Counter((x, y) for x in usable[0] for y in usable[1] if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    everywhere = intervals.overlapping(*frames, [], ("a", "b"), ("a", "b"), 16, part, whole)
    assert everywhere.count() == sum(x[1] < y[2] and y[1] < x[2] for x in left for y in right if None not in x[1:3] + y[1:3] and x[1] < x[2] and y[1] < y[2])


def test_long_spans_of_small_keys_are_sent_once(spark):
    left = spark.createDataFrame([("a", 0, 10**12, 1), ("b", 5, 6, 2)], SPANS)
    right = spark.createDataFrame([("a", 3, 10**11, 3), ("b", -(10**12), 10**12, 4), ("b", 6, 7, 5)], SPANS)
    found = intervals.overlapping(left, right, ["k"], ("a", "b"), ("a", "b"), 1)
    assert {(r.left.id, r.right.id) for r in found.collect()} == {(1, 3), (2, 4)}


def test_crowded_bins_are_split(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    left = spark.createDataFrame([("hot", i % 10, 20, i) for i in range(2000)], SPANS)
    right = spark.createDataFrame([("hot", 5, 6, 0)], SPANS)
    found = intervals.overlapping(left, right, ["k"], ("a", "b"), ("a", "b"), 100, part=100)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1200 and max(tasks) < 900


EVENTS = "id bigint, at timestamp, kind string, v int"


def streamed(spark, batches, delay, restart_after=()):
    """Hourly windows over batches of (id, minutes or None, kind, value), with restarts."""
    folder, checkpoint = workspace.fresh_path(spark, "events"), workspace.fresh_path(spark, "checkpoint")
    table = f"{catalog.create_scratch_database(spark, 'windows')}.hours"
    spark.createDataFrame([], EVENTS).write.parquet(folder)

    def run():
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(folder)
        ingest.run_to_end(
            windows.keep_windows(events, F.window("at", "1 hour"), windows.hour_end(), ["kind"], {"total": F.col("v")}, delay, table, checkpoint)
        )

    for n, batch in enumerate(batches):
        rows = [(i, START + dt.timedelta(minutes=m) if m is not None else None, k, v) for i, m, k, v in batch]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        if n in restart_after:
            run()
    run()
    closed = windows.read_closed(spark, table).collect()
    return {(r.window_start, r.kind): (r.n, r.total) for r in closed}, sorted(r.id for r in windows.read_late(spark, table).collect()), len(closed)


@pytest.mark.parametrize("restart_after", [(), (0, 1, 2), (2,)])
def test_closed_windows_and_late_events_hold_every_event(spark, conf, restart_after):
    conf("spark.sql.session.timeZone", "UTC")
    rng = random.Random(10)
    batches, n = [], 0
    for b in range(5):
        batch = []
        for _ in range(30):
            m = rng.randrange(max(0, b * 200 - 500), b * 200 + 200)
            batch.append((n, m if n % 17 else None, rng.choice("xy"), n))
            n += 1
        batches.append(batch)
    closing = [(n, 100_000, "closing", 0)]
    closed, late, rows = streamed(spark, [*batches, closing], 3600, restart_after)
    assert rows == len(closed)  # each window once
    events = {i: (m, k, v) for batch in batches for i, m, k, v in batch}
    assert {i for i, (m, _, _) in events.items() if m is None} <= set(late) and len(late) > 12
    on_time = Counter()
    totals = Counter()
    for i, (m, k, v) in events.items():
        if i not in late:
            on_time[START + dt.timedelta(hours=m // 60), k] += 1
            totals[START + dt.timedelta(hours=m // 60), k] += v
    assert closed == {w: (c, totals[w]) for w, c in on_time.items()}


def test_a_replayed_batch_overwrites_what_it_wrote(spark):
    """The last batch's commit is taken away, as if the job had died before it."""
    folder, checkpoint = workspace.fresh_path(spark, "events"), workspace.fresh_path(spark, "checkpoint")
    table = f"{catalog.create_scratch_database(spark, 'windows')}.hours"

    def run():
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(folder)
        ingest.run_to_end(windows.keep_windows(events, F.window("at", "1 hour"), windows.hour_end(), ["kind"], {"total": F.col("v")}, 60, table, checkpoint))
        late = windows.read_late(spark, table).collect()
        return sorted(map(tuple, windows.read_closed(spark, table).collect())), sorted(r.id for r in late)

    for n, m in enumerate((0, 500, 700, 10, 2000)):
        rows = [(n, START + dt.timedelta(minutes=m), "x", n)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    first = run()
    assert first[1] == [3]
    commits = sorted((p.getPath() for p in files(spark, f"{checkpoint}/commits") if p.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    assert workspace.remove(spark, commits[-1].toString())
    assert run() == first


def files(spark, path):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return list(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place))


def test_copies_are_known_across_a_restart(spark):
    folder, checkpoint = workspace.fresh_path(spark, "messages"), workspace.fresh_path(spark, "checkpoint")
    table = f"{catalog.create_scratch_database(spark, 'once')}.messages"
    schema = "id bigint, timestamp timestamp"
    for batch in ([1, 2, 2], [2, 3], [1, 4, 4, 3]):
        spark.createDataFrame([(i, START + dt.timedelta(seconds=i)) for i in batch], schema).coalesce(1).write.mode("append").parquet(folder)
        messages = spark.readStream.schema(schema).parquet(folder)
        ingest.run_to_end(windows.ingest_once(messages, ["id"], 3600, table, checkpoint))
    spark.catalog.refreshTable(table)
    assert sorted(r.id for r in spark.table(table).collect()) == [1, 2, 3, 4]


def test_sliding_windows_are_summed_from_panes(spark):
    rng = random.Random(15)
    rows = [(g, rng.randrange(-90, 200) if i % 30 else None, rng.randrange(9)) for i, g in enumerate(hot(800, 16))]
    frame = spark.createDataFrame(rows, "g string, t bigint, v bigint").repartition(4)
    found = panes.sliding_sums(frame, F.col("t"), ["g"], 60, 20, {"total": F.col("v")})
    expected = {}
    for g, t, v in rows:
        for start in range(-200, 200, 20):
            if t is not None and start <= t < start + 60:
                n, total = expected.get((start, g), (0, 0))
                expected[start, g] = n + 1, total + v
    assert {(r.window_start, r.g): (r.n, r.total) for r in found.collect()} == expected
    plan = plan_of(found)
    assert plan.index("Generate explode") < plan.rindex("HashAggregate") and "Expand" not in plan  # panes are spread, not rows
    with pytest.raises(ValueError, match="multiple"):
        panes.sliding_sums(frame, F.col("t"), [], 50, 20, {})
