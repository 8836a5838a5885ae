"""Ranked lexical search by term-at-a-time scoring with limited accumulators.

Documents stay where they are: one pass over the texts keeps, of each document, the query
terms that it holds and how often. What depends on the whole corpus (the number of
documents, their length, the document frequency of each query term) is summed from there.
Then each task turns its documents, a block at a time, into posting lists, and scores every
query on the block. A query's terms are taken from the rarest on. A document gets an
accumulator when a term of it is met first; once the terms that are left could not lift a
document without one to the score of the best ``k`` so far, no more are made, and the
longer lists only add to those that exist. So the scores of all that may be returned are
exact. The best of each block are ranked once more over all blocks.

Queries are taken in blocks too, each of a bounded number of terms, so what the tasks are
sent does not grow with the table of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import batches, textscan
from millrace.llm.store import written

#: Terms, repeats included, of a block of queries on average; queries are dealt by a hash.
QUERY_TERMS = 500_000
#: Postings, and documents, of a block of documents.
BLOCK_POSTINGS, BLOCK_DOCS = 2_000_000, 65_536

#: Fixed values of the score.
UNIT = 1_000_000_000
#: Bytes between terms: all of ASCII but digits and letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
for _first, _last in ("09", "AZ", "az"):
    _BETWEEN[ord(_first) : ord(_last) + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: ``item_col``, ``rank`` from 1 on,
    ``id_col``, ``score``.

    Terms are the longest runs of ASCII digits and letters and of letters beyond ASCII; only
    A to Z are lower-cased. With N documents that have a term, L terms in them, n of them in
    a document, and df documents that hold a term, the term weighs
    ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``, a document has
    ``m = 75 + (25 n N) div L``, and each occurrence of a term in the query adds
    ``w * ((10**9 * tf) div (1000 * tf + 12 * m))`` to the score of a document that holds
    it tf times.

    * Documents without a score above 0 are not returned, so a query has fewer rows than
      ``k``, or none, where no more match. Equal scores go by ascending id, null ids last.
    * A null or empty text, of either table, has no terms. Rows that repeat an id are
      documents of their own. Rows that repeat an item are ranked alone, each by its text.
    * Texts are read whole, however long. An empty table gives no rows. Other columns are
      not looked at.
    """
    spark = docs.sparkSession
    wanted = items.select(
        F.col(item_col).alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("nth")
    )
    queries = written(wanted.mapInArrow(_query_terms, _schema(wanted, "item", "nth long, terms array<string>")), "queries")
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / QUERY_TERMS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    best = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("nth"), F.lit(blocks)) == block)
        found = _best_of_blocks(spark, texts, own, k)
        best = found if best is None else best.unionByName(found)
    first = Window.partitionBy("nth").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    named = ranked.join(queries.select("nth", "item"), "nth")
    return named.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _schema(rows: DataFrame, column: str, rest: str) -> str:
    return f"{column} {dict(rows.dtypes)[column]}, {rest}"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, lengths and first terms of texts as ``textscan.spans``."""
    data, bounds = textscan.utf8(column)
    return _LOWER[data], *textscan.spans(data, bounds, _BETWEEN)


def _query_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in parts:
        for batch in textscan.pieces(whole, "text"):
            data, starts, lengths, first = _terms(batch.column("text"))
            raw = data.tobytes()
            words = [raw[s : s + n].decode() for s, n in zip(starts.tolist(), lengths.tolist())]
            own = [words[s:e] for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("nth"), pa.array(own, pa.list_(pa.string()))], ["item", "nth", "terms"])


class _Dictionary:
    """The distinct terms of a block of queries, found by hash and then compared whole."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data, bounds = textscan.utf8(pa.array(raw, pa.large_binary()))
        lengths = np.diff(bounds)
        hashes = textscan.hashes(data, bounds[:-1], lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.starts, self.lengths = hashes[self.order], data, bounds[:-1], lengths
        #: Terms that share their hash with another one are few or none; they are looked up by themselves.
        self.twins = {raw[i]: i for i in self.order[np.isin(self.hashes, self.hashes[1:][self.hashes[1:] == self.hashes[:-1]])].tolist()}

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these words are terms, and the numbers of those terms."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = textscan.hashes(data, starts, lengths)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        words = np.flatnonzero(self.hashes[at] == hashes)
        terms = self.order[at[words]]
        same = (self.lengths[terms] == lengths[words]) if len(words) else np.zeros(0, bool)
        live, step = np.flatnonzero(same), 0
        while len(live):  # one byte of all words at a time
            live = live[self.lengths[terms[live]] > step]
            differs = data[starts[words[live]] + step] != self.data[self.starts[terms[live]] + step]
            same[live[differs]] = False
            live, step = live[~differs], step + 1
        if self.twins:
            for i in np.flatnonzero(np.isin(terms, list(self.twins.values()))).tolist():
                word = data[starts[words[i]] : starts[words[i]] + lengths[words[i]]].tobytes()
                same[i], terms[i] = word in self.twins, self.twins.get(word, terms[i])
        return words[same], terms[same]


def _best_of_blocks(spark, texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(nth, id, score)``: the best of every block of documents for these queries, whose
    terms fit the driver and the tasks by their number."""
    terms = [r[0] for r in queries.select(F.explode("terms").alias("term")).distinct().orderBy("term").collect()]
    number = {t: i for i, t in enumerate(terms)}
    lists = {r["nth"]: sorted(number[t] for t in r["terms"]) for r in queries.select("nth", "terms").collect()}
    vocabulary = spark.sparkContext.broadcast(terms)
    postings = written(texts.mapInArrow(_counter(vocabulary), "id long, n long, terms binary, tfs binary"), "postings", compression="zstd")
    sums = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    documents, words = sums[0], sums[1] or 0
    held = postings.select("terms").mapInArrow(_frequencies(len(terms)), "term int, df long")
    df = np.zeros(len(terms), np.int64)
    for term, count in held.groupBy("term").agg(F.sum("df")).collect():
        df[term] = count
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()]
    plan = {}
    for nth, own in lists.items():
        ids, repeats = np.unique(np.array(own, np.int64), return_counts=True)
        rarest = np.lexsort((ids, df[ids]))
        plan[nth] = ids[rarest], repeats[rarest]
    shipped = spark.sparkContext.broadcast((np.array(weights, np.int64), plan, documents, words))
    return written(postings.filter("octet_length(terms) > 0").mapInArrow(_scorer(shipped, k), "nth long, id long, score long"), "best")


def _counter(vocabulary):
    """Each document's number of terms, the query terms in it and how often each is in it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Dictionary(vocabulary.value)
        width = len(vocabulary.value) + 1
        for whole in parts:
            for batch in textscan.pieces(whole, "text"):
                data, starts, lengths, first = _terms(batch.column("text"))
                words, terms = known.find(data, starts, lengths)
                texts = np.searchsorted(first, words, "right") - 1
                codes, tfs = np.unique(texts * width + terms, return_counts=True)
                owner, own = codes // width, (codes % width).astype("<u4")
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
                tfs = tfs.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(np.diff(first)),
                        *(pa.array([x[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary()) for x in (own, tfs)),
                    ],
                    ["id", "n", "terms", "tfs"],
                )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers out of a binary column, and where each row's begin and end."""
    data, bounds = textscan.utf8(column)
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), bounds // 4


def _frequencies(count: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(count, np.int64)
        for batch in parts:
            df += np.bincount(_flat(batch.column("terms"))[0], minlength=count)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return run


def _scorer(shipped, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, plan, documents, words = shipped.value
        for block in _blocks(parts):
            lists = Postings(block, weights, documents, words)
            found = [(nth, *lists.best(terms, repeats, k)) for nth, (terms, repeats) in plan.items() if len(terms)]
            rows = [len(at) for _, at, _ in found]
            if sum(rows):
                nth = np.repeat(np.array([n for n, _, _ in found], np.int64), rows)
                at = np.concatenate([a for _, a, _ in found])
                score = np.concatenate([s for _, _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(nth), block.column("id").take(pa.array(at)), pa.array(score)], ["nth", "id", "score"])

    return run


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents put together up to the size of a block."""
    held, postings, docs = [], 0, 0
    for whole in parts:
        for batch in textscan.pieces(whole, "terms", 4 * BLOCK_POSTINGS):
            size = batch.column("terms").nbytes // 4
            if held and (postings + size > BLOCK_POSTINGS or docs + batch.num_rows > BLOCK_DOCS):
                yield _together(held)
                held, postings, docs = [], 0, 0
            held.append(batch)
            postings, docs = postings + size, docs + batch.num_rows
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Postings:
    """The posting lists of a block of documents, with what each posting adds to a score."""

    def __init__(self, block: pa.RecordBatch, weights: np.ndarray, documents: int, words: int):
        terms, cuts = _flat(block.column("terms"))
        tfs, _ = _flat(block.column("tfs"))
        owner = np.repeat(np.arange(block.num_rows), np.diff(cuts))
        n = batches.numbers(block, "n")
        m = 75 + (25 * n * documents) // max(words, 1)
        order = np.argsort(terms, kind="stable")
        terms, self.docs, tfs = terms[order], owner[order], tfs[order]
        self.adds = weights[terms] * ((UNIT * tfs) // (1000 * tfs + 12 * m[self.docs]))
        self.cuts = np.searchsorted(terms, np.arange(len(weights) + 1))
        some = np.flatnonzero(np.diff(self.cuts))
        self.most = np.zeros(len(weights), np.int64)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.adds, self.cuts[some])
        names = block.column("id")
        self.names = names.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.unnamed = names.is_null().to_numpy(zero_copy_only=False)
        self.scores = np.zeros(block.num_rows, np.int64)
        self.held = np.zeros(block.num_rows, bool)

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of the ``k`` best documents; terms come rarest first."""
        scores, held = self.scores, self.held
        bounds = self.most[terms] * repeats
        left = np.cumsum(bounds[::-1])[::-1]  # what this and the later terms add at most
        made: list[np.ndarray] = []
        count, limited = 0, False
        for term, times, rest in zip(terms.tolist(), repeats.tolist(), left.tolist()):
            if not rest:
                break
            s, e = self.cuts[term], self.cuts[term + 1]
            if s == e:
                continue
            if not limited and count >= k and rest < left[0] - rest:  # no score is above what came before
                # Strictly: a document that could only draw level may still come first by its id.
                limited = rest < self._kth(np.concatenate(made), k)
            docs, adds = self.docs[s:e], self.adds[s:e]
            there = held[docs]
            if limited:
                docs, adds = docs[there], adds[there]
            elif not there.all():
                fresh = docs[~there]
                held[fresh] = True
                made.append(fresh)
                count += len(fresh)
            scores[docs] += adds * times
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(made)
        total = scores[at]
        scores[at], held[at] = 0, False
        some = total > 0
        at, total = at[some], total[some]
        if len(at) > k:
            some = total >= np.partition(total, len(total) - k)[len(total) - k]
            at, total = at[some], total[some]
        order = np.lexsort((self.names[at], self.unnamed[at], -total))[:k]
        return at[order], total[order]

    def _kth(self, at: np.ndarray, k: int) -> int:
        scores = self.scores[at]
        return int(np.partition(scores, len(scores) - k)[len(scores) - k])
