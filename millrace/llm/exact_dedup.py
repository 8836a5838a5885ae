"""Exact duplicates by Grace hash partitioning.

Records are partitioned by a hash of their content until the contents of a bucket fit an
open-addressing table in memory, which compares them whole. A first pass looks for copies
within each task, so that what a task sends on holds a content once, with the ids of its
rows. These records are the first spill files. Each round then deals the spilled records
into buckets by a hash of its own; a task fills its table and finds copies in it, and spills
what is not in a full table to files that the next round partitions again. A content is in
a table with all its copies in the bucket, or spilled with all of them.

Spill files are Parquet files in the folder that all executors share, so a lost executor
costs the tasks that it ran and no round before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan
from millrace.llm.filters import maybe_in
from millrace.llm.store import written

#: Bytes of different contents that a table holds.
TABLE_BYTES = 64 << 20
#: Rows whose ids the first pass holds before it sends them on.
HELD_ROWS = 1_000_000
#: Buckets of a round at most; what they cannot hold is left to the next one.
FAN_OUT = 20_000
#: A content with more copies than this after the first pass has them dealt into
#: parts of about this size, which are compared before they meet.
MANY_COPIES = 2_000

_SALTS = 4096


class Table:
    """An open-addressing table of contents: linear probing, kept at most half full. Equal
    hashes lead to a slot; only equal bytes are a match."""

    def __init__(self, most_bytes: int, slots: int = 1 << 10):
        self.most_bytes, self.bytes = most_bytes, 0
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, hash_: int, content: bytes) -> tuple[int, bool]:
        """The number of an equal content and whether it was put in just now; -1 if there is
        none and the table is full. An empty table takes a content of any size."""
        slots, mask = self.slots, len(self.slots) - 1
        at = (hash_ ^ (hash_ >> 32)) & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        if self.contents and self.bytes + len(content) > self.most_bytes:
            return -1, False
        entry = slots[at] = len(self.contents)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, hash_ in enumerate(self.hashes):
            at = (hash_ ^ (hash_ >> 32)) & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str | Column = "text",
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``.

    Texts are equal when their bytes are; ``text_col`` may be an expression that normalises
    them. Of equal texts one row stays, with the largest id, which is ``keep_id``.

    * A null text counts as empty. Empty texts are equal to each other.
    * Ids compare as longs. A null id is smaller than any other; a group of null ids has a
      null ``keep_id``, and one of its rows stays. Where rows share an id and a text, all of
      them come back, and one stays.
    * Texts may be of any length: a text larger than ``table_bytes`` has a table to itself.
    * An empty table gives no rows. Other columns are not looked at.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))
    records = _spilled(rows.mapInArrow(_first_pass(table_bytes), "node long, hash long, size long, digest binary, ids array<long>, text binary"))
    sizes = records.select("node", "hash", "size", "digest", "ids")

    pending, met = records.select("node", "hash", "size", "text"), []
    crowded = sizes.groupBy("hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > MANY_COPIES)
    several = None
    if not crowded.isEmpty():
        pending, several = _thinned(pending, written(crowded, "crowded"), table_bytes)
    while True:
        found, pending = _round(pending, table_bytes, len(met))
        met.append(found)
        if pending.isEmpty():
            break
    roots = met[0]
    for found in met[1:]:
        roots = roots.unionByName(found)
    if several is not None:  # node -> node of its part -> node of its bucket
        onward = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        through = several.join(onward, "root").select("node", F.col("top").alias("root"))
        roots = written(roots.join(several.select("node"), "node", "left_anti").unionByName(through), "roots")

    # The ids of a node come largest first, so its first row is the one that may stay.
    named = written(sizes.drop("hash", "size").join(roots, "node"), "named")
    groups = named.groupBy("root").agg(
        F.sum(F.size("ids").cast("long")).alias("group_size"),
        F.max(F.struct(F.col("ids")[0].alias("id"), F.col("node").alias("node"))).alias("best"),
    )
    one = named.join(written(groups, "groups"), "root")
    told = one.select(
        F.posexplode("ids").alias("place", id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("node") == F.col("best.node")).alias("wins"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return told.select(id_col, "keep_id", "group_size", (F.col("wins") & (F.col("place") == 0)).alias("kept"), "text_sha256")


def _spilled(rows: DataFrame) -> DataFrame:
    return written(rows, "spill", compression="zstd")


def _first_pass(table_bytes: int):
    """Copies within a task: a record for each content of a table, with its ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        table, ids, held = Table(table_bytes), [], 0

        def records(start: int) -> Iterator[pa.RecordBatch]:
            step = 1000
            for s in range(0, len(ids), step):
                contents, own = table.contents[s : s + step], ids[s : s + step]
                for x in own:
                    x.sort(key=lambda i: (i is not None, i), reverse=True)
                digests = [hashlib.sha256(c).digest() for c in contents]
                hashes = np.array(table.hashes[s : s + step], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(start + s, start + s + len(own))),
                        pa.array(hashes),
                        pa.array([len(c) for c in contents], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(own, pa.list_(pa.int64())),
                        pa.array(contents, pa.binary()),
                    ],
                    ["node", "hash", "size", "digest", "ids", "text"],
                )

        for whole in parts:
            for batch in textscan.pieces(whole, "text"):
                for name, content in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    hash_ = xxhash.xxh3_64_intdigest(content)
                    entry, fresh = table.find(hash_, content) if held < HELD_ROWS else (-1, False)
                    if entry < 0:
                        yield from records(number)
                        number += len(ids)
                        table, ids, held = Table(table_bytes), [], 0
                        entry, fresh = table.find(hash_, content)
                    if fresh:
                        ids.append([])
                    ids[entry].append(name)
                    held += 1
        yield from records(number)

    return run


def _round(pending: DataFrame, table_bytes: int, nth: int) -> tuple[DataFrame, DataFrame]:
    """Deal records into buckets: ``(node, root)`` of those that their bucket's table held,
    and the records that it had no room for."""
    total = pending.agg(F.sum("size")).first()[0] or 0
    shuffles = int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(shuffles, math.ceil(2 * total / table_bytes)), max(FAN_OUT, shuffles))
    dealt = pending.repartition(buckets, F.xxhash64("hash", F.lit(nth)))
    return _compared(dealt, table_bytes)


def _compared(dealt: DataFrame, table_bytes: int) -> tuple[DataFrame, DataFrame]:
    out = _spilled(dealt.mapInArrow(_bucket(table_bytes), "node long, root long, hash long, size long, text binary"))
    return out.filter("root IS NOT NULL").select("node", "root"), out.filter("root IS NULL").drop("root")


def _thinned(pending: DataFrame, crowded: DataFrame, table_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Compare the copies of crowded contents in parts, so that few of them meet later on:
    the records that are left, and ``(node, root)`` of those that were compared."""
    marked = maybe_in(pending, F.col("hash"), crowded, "hash")
    most = crowded.agg(F.max("copies")).first()[0]
    parts = min(_SALTS, math.ceil(most / MANY_COPIES))
    hot = marked.filter("__maybe").drop("__maybe")
    found, left = _compared(hot.repartition(F.xxhash64("hash", F.pmod(F.xxhash64("node"), F.lit(parts)))), table_bytes)
    still = found.filter("node = root").select("root")
    again = hot.join(still, F.col("node") == F.col("root"), "left_semi").unionByName(left)
    several = found.unionByName(left.select("node", F.col("node").alias("root")))
    return marked.filter("NOT __maybe").drop("__maybe").unionByName(again), several


def _bucket(table_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, roots = Table(table_bytes), []
        for whole in parts:
            for batch in textscan.pieces(whole, "text"):
                own: list[int | None] = []
                hashes = batch.column("hash").to_numpy().view(np.uint64).tolist()
                for node, hash_, content in zip(batch.column("node").to_pylist(), hashes, batch.column("text").to_pylist()):
                    entry, fresh = table.find(hash_, content)
                    if fresh:
                        roots.append(node)
                    own.append(roots[entry] if entry >= 0 else None)
                root = pa.array(own, pa.int64())
                spilled = [None if r is not None else c for r, c in zip(own, batch.column("text").to_pylist())] if root.null_count else pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), root, batch.column("hash"), batch.column("size"), pa.array(spilled, pa.binary())],
                    ["node", "root", "hash", "size", "text"],
                )

    return run
