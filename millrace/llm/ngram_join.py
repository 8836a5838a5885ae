"""Jaccard join of documents on word n-grams, by chosen paths.

Each document is a set of shingles: runs of ``width`` words. Equal sets are one class. Each
class is embedded into a fixed number of min-hash tokens, on which two sets agree as often
as their Jaccard similarity says. A run sends a class into one bucket for each of its tokens
that a hash of the run samples, on average 1 / threshold of them, so that two sets at the
threshold are expected to share a bucket at least. Buckets of one class end there, small
ones are compared by brute force, and large ones are split again by sampled tokens, with
the path so far in the hash. There are as many runs as the wanted recall asks for.

What a bucket compares are estimates, with a margin that makes a miss improbable. They
join classes into candidate groups, in which every pair is then compared by its whole sets:
texts are made into sets once, and what meets in blocks are sorted shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import batches, textscan
from millrace.llm.filters import maybe_in
from millrace.llm.groups import TASK, components, in_blocks, trees
from millrace.llm.store import written

#: Tokens of the embedding.
TOKENS = 128
#: A bucket with more classes than this is split again.
SMALL = 256
#: Levels of splitting. What is large even then is compared in blocks.
DEPTH = 3
#: Classes, and shingles, of a block of exact comparison.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Shared shingles that are laid out at a time.
COLUMNS = 2048
#: Estimates may fall short of the threshold by this many standard deviations.
MARGIN = 5.0


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs until two sets at the threshold met with probability ``recall``.

    Expected to share one sampled token on each level, they share none with probability
    1 / e; the chance to stay together through ``depth`` levels follows level by level.
    """
    together = 1.0
    for _ in range(depth):
        together = 1 - math.exp(-together)
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    recall: float = 0.999,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_links``, ``class_id``, ``kept``.

    ``n_links`` counts the other documents whose sets have a Jaccard similarity of
    ``threshold`` or more, ``class_id`` is the smallest id reachable by such links and
    ``kept`` marks the document that has it.

    * Words are the runs between ASCII white space, as they are written. A text with fewer
      words than ``width`` has one shingle, all of its words. A text without words, or
      null, has an empty set, which is linked with nothing.
    * Whole texts count, however long; a set is one value of 8 bytes for each of its shingles.
      Documents with equal sets are linked like others.
    * Each row is a document, also where ids repeat or are null: it comes back once, and
      is linked by its own text. A null id is in the class of its text; ``class_id`` is
      null, and ``kept`` true, where no document of the class has an id.
    * An empty table gives no rows. Other columns are not looked at.
    """
    sketched, found = _classified(docs, id_col, text_col, threshold, width, recall)
    whole = sketched.select("id", "key").join(found.select("key", "n_links", "class_id"), "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id"))
    told = whole.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), class_id.alias("class_id"))
    kept = F.col("class_id").isNull() | F.coalesce(F.col("id") == F.col("class_id"), F.lit(False))
    return told.select(F.col("id").alias(id_col), "n_links", "class_id", kept.alias("kept"))


def _classified(
    docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, recall: float
) -> tuple[DataFrame, DataFrame]:
    """Each row's id, hashes of its text and key of its set; and for each key ``n_links`` of
    its rows, ``component`` (a number of the connected classes), ``class_id`` and the number
    of ``rows`` of the component."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *_text_hashes(text_col))
    sketched = written(
        rows.mapInArrow(_sketcher(width), "id long, h long, h2 long, key binary, shingles long, sketch binary"), "sketches"
    )
    # Classes are told apart by their content, whatever ids their rows have.
    classes = written(
        sketched.filter("shingles > 0").groupBy("key").agg(
            F.min("id").alias("least"),
            F.count("*").alias("n"),
            F.min("shingles").alias("shingles"),
            F.min("sketch").alias("sketch"),
            F.min(F.struct("h", "h2")).alias("text"),
        ),
        "classes",
    ).withColumn("node", F.xxhash64("key"))

    buckets = _leaves(classes, runs_for(recall), threshold)
    met = _met(buckets, classes)
    near = written(met.mapInArrow(_estimated(threshold), "a long, b long"), "candidates")
    groups = components(near).select(F.col("id").alias("node"), F.col("component").alias("group"))
    grouped = written(groups.join(classes.select("node", "key", "n", "shingles", "text.*"), "node"), "groups")
    dealt = in_blocks(_with_sets(grouped, rows, width), "node", F.col("parts")).drop("parts")
    compared = written(dealt.mapInArrow(_exact(Fraction(str(threshold))), "a long, b long, others long"), "links")

    counts = compared.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    joined = components(compared.filter("b IS NOT NULL").select("a", "b")).toDF("node", "component")
    placed = classes.select("node", "key", "least", "n").join(counts, "node", "left").join(joined, "node", "left")
    placed = written(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    tops = placed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("rows"))
    links = F.col("n") - 1 + F.coalesce("others", F.lit(0))
    return sketched, written(placed.join(tops, "component").select("key", links.alias("n_links"), "component", "class_id", "rows"), "classified")


def _text_hashes(text_col: str) -> list[Column]:
    """128 bits by which texts are told apart; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2")]


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one text after the other, and their bounds."""
    data, bounds = textscan.utf8(batch.column("text"))
    starts, lengths, first = textscan.spans(data, bounds, textscan.SPACE)
    words = textscan.hashes(data, starts, lengths)
    runs, at = textscan.windows(words, first, width)
    texts = np.searchsorted(first, at, "right") - 1
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        alone = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            alone[has] = textscan.mix(alone[has]) ^ words[first[short[has]] + k]
        runs = np.concatenate([runs, textscan.mix(alone)])
        texts = np.concatenate([texts, short])
    order = np.lexsort((runs, texts))
    runs, texts = runs[order], texts[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (texts[1:] != texts[:-1])
    runs, texts = runs[fresh], texts[fresh]
    return runs, np.searchsorted(texts, np.arange(batch.num_rows + 1))


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(np.ascontiguousarray(shingles).tobytes())


def _sketcher(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        factors = rng.integers(1, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in parts:
            for batch in textscan.pieces(whole, "text"):
                sets, bounds = shingle_sets(batch, width)
                keys, sketches = [], []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    keys.append(_key(sets[s:e]) if e > s else None)
                    sketches.append(_min_hashes(sets[s:e], factors).tobytes() if e > s else None)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("id", "h", "h2")), pa.array(keys, pa.binary()), pa.array(np.diff(bounds)), pa.array(sketches, pa.binary())],
                    ["id", "h", "h2", "key", "shingles", "sketch"],
                )

    return run


def _min_hashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048]
        np.minimum(least, (factors[:, None] * part[None, :]).min(axis=1), out=least)
    return textscan.mix(least).astype(np.uint32)


def _leaves(classes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """``(bucket, size, node)`` of the buckets that are to be compared."""
    rows = classes.mapInArrow(_paths(threshold, runs), "bucket long, node long")
    found = None
    for level in range(DEPTH):
        rows = written(rows, "paths")
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        shared = written(rows.join(sizes, "bucket"), "shared")
        last = level == DEPTH - 1
        ends = shared if last else shared.filter(F.col("size") <= SMALL)
        # The same classes often meet in many runs; one of those buckets says it all.
        members = ends.groupBy("bucket").agg(
            F.count("*").alias("size"), F.bit_xor("node").alias("xor"), F.bit_xor(F.xxhash64("node")).alias("other")
        )
        told = members.groupBy("size", "xor", "other").agg(F.min("bucket").alias("bucket")).select("bucket")
        leaves = ends.join(told, "bucket")
        found = leaves if found is None else found.unionByName(leaves)
        large = shared.filter(F.col("size") > SMALL)
        if last or large.isEmpty():
            return found
        again = large.drop("size").join(classes.select("node", "sketch"), "node")
        rows = again.mapInArrow(_paths(threshold, 0), "bucket long, node long")


def _paths(threshold: float, runs: int):
    """The buckets that a class goes to next: for each sampled token one. ``runs`` is the
    number of runs that start here, or 0 where each row goes on from its own bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = np.uint64(min(1.0, 1 / (threshold * TOKENS)) * (1 << 63)) * np.uint64(2)
        place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
        for whole in parts:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                nodes = batches.numbers(batch, "node")
                tokens = textscan.mix(place + batches.matrix(batch.column("sketch"), np.uint32))
                paths = (
                    [textscan.mix(np.full(len(nodes), r + 1, np.uint64)) for r in range(runs)]
                    if runs
                    else [batches.numbers(batch, "bucket").view(np.uint64)]
                )
                for path in paths:
                    hashed = textscan.mix(tokens ^ textscan.mix(path)[:, None])
                    who, which = np.nonzero(hashed < chance)
                    buckets = textscan.mix(hashed[who, which]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(nodes[who])], ["bucket", "node"])

    return run


def _met(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with their sketches, by the task that compares them. Half of each token's
    bits is enough to tell tokens apart."""
    rows = buckets.join(classes.select("node", "sketch"), "node")
    rows = rows.select(F.col("bucket").alias("group"), "node", "sketch", "size")
    return in_blocks(rows, "node", F.ceil(F.col("size") / (2 * SMALL))).drop("size")


def _estimated(threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = math.ceil((threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / TOKENS)) * TOKENS)
        for batch, bounds in batches.whole_groups(parts, TASK):
            nodes = batches.numbers(batch, "node")
            sketches = batches.matrix(batch.column("sketch"), np.uint32).astype(np.uint16)
            first, second = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s == 2:
                    if (sketches[s] == sketches[s + 1]).sum() >= least:
                        first.append(nodes[s])
                        second.append(nodes[s + 1])
                    continue
                own = np.ascontiguousarray(sketches[s:e].T)
                equal = np.zeros((e - s, e - s), np.uint8)
                for token in own:
                    equal += token[:, None] == token[None, :]
                hung, tops = trees(equal >= least)
                first += nodes[s + hung].tolist()
                second += nodes[s + tops].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(first, np.int64)), pa.array(np.array(second, np.int64))], ["a", "b"])

    return run


def _with_sets(grouped: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The candidate classes with their sets, and the number of ``parts`` of their groups."""
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size"), F.sum("shingles").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_SHINGLES))
    named = grouped.join(sizes, "group").withColumn("parts", F.least(blocks, F.col("size")))
    # One text of each class, whichever of its copies a task meets first.
    wanted = maybe_in(rows, F.col("h"), grouped, "h").filter("__maybe").groupBy("h", "h2").agg(F.first("text").alias("text"))
    texts = wanted.join(named, ["h", "h2"]).select("group", "node", "key", "n", "text", "parts")
    return texts.mapInArrow(_hashed(width), "group long, node long, n long, parts long, set binary")


def _hashed(width: int):
    kept = ["group", "node", "n", "parts"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in textscan.pieces(whole, "text"):
                sets, cuts = shingle_sets(batch, width)
                own = [sets[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                fits = pa.array([_key(x) == key.as_py() for x, key in zip(own, batch.column("key"))], pa.bool_())
                column = pa.array([x.tobytes() for x in own], pa.binary())
                told = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, "set"])
                yield told.filter(fits)

    return run


def _exact(threshold: Fraction):
    """Compare whole sets: for each class, how many documents it is linked with, and a
    forest of the links. Two blocks of a group are compared with each other only; pairs
    within a block meet in a task of their own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in batches.whole_groups(parts, TASK):
            nodes, block, weight, low = (batches.numbers(batch, c) for c in ("node", "block", "n", "low"))
            data, cuts = textscan.utf8(batch.column("set"))
            hung, tops, counted, others = [], [], [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = [data[cuts[i] : cuts[i + 1]].view(np.uint64) for i in range(s, e)]
                left = np.flatnonzero(block[s:e] == low[s])
                right = np.flatnonzero(block[s:e] != low[s])
                linked = np.zeros((e - s, e - s), bool)
                if batch.column("high")[s].as_py() == low[s]:
                    linked[:] = _linked(own, own, threshold)
                    np.fill_diagonal(linked, False)
                elif len(left) and len(right):
                    across = _linked([own[i] for i in left], [own[i] for i in right], threshold)
                    linked[np.ix_(left, right)] = across
                    linked[np.ix_(right, left)] = across.T
                links = np.array([int(weight[s:e][row].sum()) for row in linked], np.int64)
                some = np.flatnonzero(links)
                counted += nodes[s + some].tolist()
                others += links[some].tolist()
                x, top = trees(linked)
                hung += nodes[s + x].tolist()
                tops += nodes[s + top].tolist()
            columns = [counted + hung, [None] * len(counted) + tops, others + [0] * len(hung)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "others"])

    return run


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which sets on the left have a Jaccard similarity of the threshold or more with which
    on the right, as whole numbers decide. Sets are laid out over the shingles that both
    sides hold, some columns at a time. Where both sides are one list, what is said of a set
    and itself means nothing."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    shared = np.zeros((len(left), len(right)), np.int32)
    if len(left) == len(right) == 1:
        shared[0, 0] = _shared(left[0], right[0])
    elif left is right and len(left) == 2:
        shared[0, 1] = shared[1, 0] = _shared(*left)
    else:
        columns, count = _columns(left, right)
        for start in range(0, count, COLUMNS):
            a, b = (_layout(*side, start, len(n)) for side, n in zip(columns, sizes))
            shared += np.rint(a @ b.T).astype(np.int32)
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return shared * np.int64(threshold.denominator) >= union * threshold.numerator


def _columns(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For either side the columns of the shingles that count, in order, with the set that
    holds each; and the number of columns. A shingle that just one set holds does not count."""
    sides = [np.unique(np.concatenate(side), return_inverse=True) for side in (left, right)]
    if left is right:
        common = sides[0][0][np.bincount(sides[0][1]) > 1]
    else:
        common = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True)
    out = []
    for sets, (tokens, at) in zip((left, right), sides):
        held = np.isin(tokens, common, assume_unique=True)[at]
        column = np.searchsorted(common, tokens)[at[held]]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[held]
        order = np.argsort(column, kind="stable")
        out.append((column[order], owner[order]))
    return out, len(common)


def _layout(column: np.ndarray, owner: np.ndarray, start: int, rows: int) -> np.ndarray:
    s, e = np.searchsorted(column, [start, start + COLUMNS])
    out = np.zeros((rows, COLUMNS), np.float32)
    out[owner[s:e], column[s:e] - start] = 1
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, recall: float = 0.999
) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of documents that are
    connected by links: the one with the least id, null ids last, then the least hash of its
    text. No row goes for its id alone. Texts without words are linked with nothing and stay.
    """
    sketched, found = _classified(docs, id_col, text_col, threshold, width, recall)
    several = found.filter(F.col("rows") > 1).select("key", "component")
    members = written(sketched.select("id", "h", "h2", "key").join(several, "key").drop("key"), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "h2"))
    best = members.groupBy("component").agg(first.alias("best")).select("component", "best.*")
    stays = best.select(F.col("id").alias("stay_id"), "h", "h2", F.lit(True).alias("stays"))
    flags = written(members.select("h", "h2").distinct().join(stays, ["h", "h2"], "left").withColumn("told", F.lit(True)), "flags")

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), *_text_hashes(text_col))
    sorted_out = maybe_in(rows, F.col("h"), flags, "h")
    untouched = sorted_out.filter("NOT __maybe").select("row")
    looked_up = sorted_out.filter("__maybe").drop("__maybe").join(flags, ["h", "h2"], "left")
    left = written(looked_up.filter("told IS NULL OR (stays AND id <=> stay_id)").select("row", "h", "h2", "told"), "left")
    alone, candidates = left.filter("told IS NULL").select("row"), left.filter("told")
    # Rows alike in id and text may differ elsewhere; the least of them in JSON stays.
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c != text_col]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    least = candidates.groupBy("h", "h2").agg(F.min_by("row", order).alias("row")).select("row")
    whole = untouched.unionByName(alone).unionByName(least)
    return whole.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
