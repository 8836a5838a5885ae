"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, and
distributed connected components.

Equal vectors are one class. Each class is hashed into a bucket of every table by the sides
of random hyperplanes that it lies on. Vectors that meet in a bucket are compared by their
exact cosine, which gives links; connected links give candidate groups; and within a group
every pair is compared once, which gives each vector's number of links. Large buckets and
groups are cut into blocks that meet two by two, so nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches
from millrace.llm.groups import TASK, components, in_blocks, trees
from millrace.llm.store import written
from millrace.llm.textscan import mix

#: Vectors of a block; a task compares two blocks.
BLOCK = 512
#: Vectors that a bucket holds on average, if they were spread evenly.
BUCKET = 16


def table_shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hyperplanes of a table and the number of tables, for ``n`` vectors.

    Two vectors at the threshold lie on one side of a hyperplane with probability
    1 - angle / pi. There are as many tables as let them meet with probability ``recall``.
    """
    planes = min(max(round(math.log2(max(n, 1) / BUCKET)), 4), 40)
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    recall: float = 0.9999,
    seed: int = 1,
) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    * ``recall`` is the chance that a pair right at the threshold meets in a table; pairs
      above it meet more often, and members of a group are compared whether they met or not.
    * Null, empty and zero vectors and vectors with a null or non-finite part have no links.
      Vectors of different lengths are never linked.
    * Equal vectors are linked with each other like any others.
    * Each row is a vector of its own, also where ids repeat or are null; it is linked by
      what it holds. ``component_id`` is the smallest id of the component, null where none of
      its vectors has an id; those are all kept, other vectors without an id are not.
    * An empty table gives no rows. Other columns are not looked at.
    """
    # Floats travel as they are; cosines are taken in double precision.
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists("v", lambda x: x != 0)
    own = written(rows.withColumn("v", F.when(usable, F.col("v"))), "vectors")
    # Classes of equal vectors get numbers of their own, whatever ids their rows have.
    equal = own.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = written(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")

    planes, tables = table_shape(classes.count(), threshold, recall)
    links = components(_bucket_links(classes, planes, tables, threshold, seed))
    groups = links.withColumnRenamed("id", "rep").withColumnRenamed("component", "group")
    grouped = written(groups.join(classes, "rep"), "grouped")
    counts = _count_links(grouped, threshold)
    tops = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    placed = grouped.select("rep", "group").join(tops, "group").join(counts, "rep", "left").select("rep", "component_id", "others")

    found = own.join(classes.select("v", "rep", "n", "least"), "v", "left").select("id", "rep", "n", "least").join(placed, "rep", "left")
    unusable, alone = F.col("n").isNull(), F.col("others").isNull()
    component = F.when(unusable, F.col("id")).when(alone, F.col("least")).otherwise(F.col("component_id"))
    told = found.select(
        "id",
        (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
    )
    kept = F.col("component_id").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return told.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _bucket_links(classes: DataFrame, planes: int, tables: int, threshold: float, seed: int) -> DataFrame:
    """A forest of links for every bucket."""
    hashed = written(classes.mapInArrow(_hasher(planes, tables, seed), "group long, rep long"), "buckets")
    sizes = hashed.groupBy("group").agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("rep")).alias("xor"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("other"),
    )
    # The same vectors often meet in many tables; one of those buckets says it all.
    told = sizes.filter("size > 1").groupBy("size", "xor", "other").agg(F.min("group").alias("group")).select("group", "size")
    met = hashed.join(told, "group").join(classes.select("rep", F.col("v")), "rep")
    return _pairs(met, F.ceil(F.col("size") / BLOCK)).mapInArrow(_linker(threshold, counting=False), "a long, b long")


def _count_links(grouped: DataFrame, threshold: float) -> DataFrame:
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size"))
    dealt = _pairs(grouped.join(sizes, "group"), F.ceil(F.col("size") / BLOCK))
    parts = dealt.mapInArrow(_linker(threshold, counting=True), "rep long, others long")
    return parts.groupBy("rep").agg(F.sum("others").alias("others"))


def _pairs(rows: DataFrame, blocks) -> DataFrame:
    kept = ["group", "rep", "v", *(["n"] if "n" in rows.columns else [])]
    return in_blocks(rows.withColumn("blocks", blocks).select(*kept, "blocks"), "rep", F.col("blocks"))


def _hasher(planes: int, tables: int, seed: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(planes, dtype=np.uint64)
        for batch in parts:
            reps, vectors = batches.numbers(batch, "rep"), batch.column("v")
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                if width not in normals:
                    normals[width] = np.random.default_rng([seed, width]).standard_normal((width, planes * tables))
                values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                values = values.astype(np.float64).reshape(len(rows), width)
                scaled = values / np.abs(values).max(axis=1, keepdims=True)
                sides = (scaled @ normals[width] >= 0).reshape(len(rows), tables, planes)
                codes = (sides * weights).sum(axis=2, dtype=np.uint64)
                names = mix(np.uint64(width) * np.uint64(1_000_003) + np.arange(tables, dtype=np.uint64))
                group = mix(codes ^ names).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.ravel()), pa.array(np.repeat(reps[rows], tables))], ["group", "rep"]
                )

    return run


def _linker(threshold: float, counting: bool):
    """Compare the vectors that meet in a task: a forest of their links, or for each vector
    the number of vectors that it is linked with."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in batches.whole_groups(parts, TASK):
            reps, block = batches.numbers(batch, "rep"), batches.numbers(batch, "block")
            low, high = batches.numbers(batch, "low"), batches.numbers(batch, "high")
            vectors = batch.column("v")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(lengths)])
            weight = batches.numbers(batch, "n") if counting else None
            first, second = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                if len(set(lengths[s:e].tolist())) > 1:  # two lengths under one hash: no pair of them is compared
                    runs = [np.flatnonzero(lengths[s:e] == w) + s for w in set(lengths[s:e].tolist())]
                else:
                    runs = [np.arange(s, e)]
                for rows in runs:
                    width = int(lengths[rows[0]])
                    values = np.stack([flat[at[r] : at[r] + width] for r in rows]) if len(runs) > 1 else flat[at[s] : at[e]].reshape(e - s, width)
                    scaled = values / np.abs(values).max(axis=1, keepdims=True)
                    norms = np.sqrt((scaled * scaled).sum(axis=1))
                    linked = (scaled @ scaled.T) / np.outer(norms, norms) >= threshold
                    if low[s] != high[s]:  # pairs within a block meet in a task of their own
                        linked &= block[rows][:, None] != block[rows][None, :]
                    np.fill_diagonal(linked, False)
                    if counting:
                        first.append(reps[rows])
                        second.append(linked @ weight[rows])
                    else:
                        hung, tops = trees(linked | linked.T)
                        first.append(reps[rows[hung]])
                        second.append(reps[rows[tops]])
            if first:
                names = ["rep", "others"] if counting else ["a", "b"]
                columns = [np.concatenate(first).astype(np.int64), np.concatenate(second).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run
