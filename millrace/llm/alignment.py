"""Alignment of two tokenizers on exact-text deduplicated documents.

Texts are shuffled whole, so that each distinct text is tokenised and aligned once, however
often it occurs. Byte offsets at which tokens of both tokenizers end cut a text into groups,
and tokens of a group are linked. The linked pairs of ids of each text are kept in a compact
form; counted by the number of documents that hold them, where a text counts as often as it
occurs, they give the corpus-wide counts. A second pass takes each text's pairs up again and
measures its links against the counts. The most frequent pairs, up to a fixed number, go to
the tasks as a table; the others are joined as rows. At last the measures are joined to the
documents by the text's SHA-256.

Both tokenizers are the libraries' own. A text is handed to them in units: neither merges
across a single space between a non-space and a printable ASCII character, which is checked
on the vocabularies, so a unit's tokens do not depend on its surroundings, and units that
were met lately are remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan
from millrace.llm.store import written

#: Units that a Python worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000
#: Pairs in the table that is sent to the tasks, at most.
TABLE_PAIRS = 1_000_000
#: Different pairs that a task counts before it sends the counts on.
COUNTED_PAIRS = 4_000_000
#: Texts are taken together up to this many bytes.
_PIECE = 4 << 20
#: Units that the libraries encode in one call.
_TOGETHER = 2_000
#: Links of a group from which on its tokens are first reduced to different ids.
_WIDE = 1 << 14
#: Steps of the histogram of counts to a power of two.
_STEPS = 8

MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align(docs: DataFrame, tokenizer_text: str, piece_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum``, ``groups_sha256``.

    A is a byte-level BPE file of the ``tokenizers`` library, which encodes a space and the
    text; B a ``sentencepiece`` model, which adds the space itself. Special tokens are not
    added, and their names in a text are plain text.

    ``n_links`` counts the pairs of an A and a B token within a group. The count of a pair
    of ids is the number of documents that hold it linked; ``count_sum`` adds up the counts
    of all links, and ``n_best`` is the number of links whose count is the highest of their
    A id.

    * A text that is null, empty, or that one of the two does not give back byte by byte
      has no tokens: zeros and an empty ``groups_sha256``.
    * Whole texts are aligned, however long. Rows that repeat an id or a text each come back.
    * Ids may be null. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select(_key(F.col("text")).alias("key"), "copies", F.col("text").cast("binary").alias("text"))
    name = hashlib.sha256(tokenizer_text.encode() + piece_model).hexdigest()
    shipped = spark.sparkContext.broadcast((name, tokenizer_text, piece_model))
    schema = f"key binary, copies long, {MEASURES}, pairs binary, times binary"
    aligned = written(keyed.mapInArrow(_aligner(shipped), schema), "aligned", compression="zstd")

    partial = aligned.select("copies", "pairs").mapInArrow(_count_pairs, "pair long, docs long")
    counts = partial.groupBy("pair").agg(F.sum("docs").alias("docs"))
    a_id = F.shiftright("pair", 32)
    pairs = written(counts.withColumn("a", a_id), "pairs")
    highest = pairs.groupBy("a").agg(F.max("docs").alias("highest"))
    ranked = written(pairs.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best")), "ranked")
    table = spark.sparkContext.broadcast(_most_frequent(ranked))

    found = written(
        aligned.select("key", "pairs", "times").mapInArrow(_measure(table), "key binary, pair long, times long, n_best long, count_sum long"),
        "measured",
    )
    inside = found.filter("pair IS NULL").select("key", "n_best", "count_sum")
    beyond = found.filter("pair IS NOT NULL").select("key", "pair", "times").join(ranked, "pair")
    looked_up = beyond.select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    sums = inside.unionByName(looked_up).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = written(aligned.drop("copies", "pairs", "times").join(sums, "key"), "measures")
    ids = written(docs.select(F.col(id_col).cast("long").alias(id_col), _key(text).alias("key")), "keys")
    return ids.join(measures, "key").select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Aligner:
    """Tokenises and aligns units, with a memory of those met lately."""

    def __init__(self, tokenizer_text: str, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer_text)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.a_bytes, plain = _a_entries(self.a, json.loads(tokenizer_text))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = pa.array(
            [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary()
        )
        #: Whether units may be cut at single spaces.
        self.cuts = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        decimal = [[str(i).encode() for i in range(n)] for n in (len(self.a_bytes), len(self.b_bytes))]
        #: Ids as text: of A before a comma, of A at a group's end, of B likewise.
        self.written = pa.array(
            [x + end for own, ends in zip(decimal, (b",|", b",;")) for end in (ends[:1], ends[1:]) for x in own], pa.large_binary()
        )
        self.a_sizes, self.b_sizes = (np.diff(textscan.utf8(x)[1]) for x in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.good = np.zeros(0, bool)
        self.text = pa.array([], pa.large_binary())  # the groups, each with a semicolon
        self.sizes = np.zeros(0, np.int64)  # the number of each unit's pairs
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self._fresh: list[tuple] = []
        self._put_together()

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of texts begin, and each text's first one. Texts begin with the
        space that stands before them, and none of them is empty."""
        begins = np.zeros(len(data), bool)
        if self.cuts and len(data) > 2:
            before, after = data[:-2], data[2:]
            begins[1:-1] = (data[1:-1] == 32) & (before != 32) & (before != 0x81) & (after > 32) & (after < 127)
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(starts, bounds)

    def learn(self, units: list[bytes]) -> None:
        """Make these different units known, none of which is yet."""
        regular = [u for u in units if len(u) > 1 and u[0] == 32 and 32 < u[1] < 127 and u[-1] != 32 and u[-1] != 0x81] if self.cuts else []
        for s in range(0, len(regular), _TOGETHER):
            self._encode(regular[s : s + _TOGETHER])
        for unit in units:
            if unit not in self.known:
                self._encode([unit])
        self._put_together()

    def _put_together(self) -> None:
        """Add what was encoded to the arrays."""
        if self._fresh:
            sums, good, text, sizes, pairs, times = zip(*self._fresh)
            self.sums, self.good = np.concatenate([self.sums, *sums]), np.concatenate([self.good, *good])
            self.text, self.sizes = pa.concat_arrays([self.text, *text]), np.concatenate([self.sizes, *sizes])
            self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
            self._fresh = []
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def _encode(self, units: list[bytes]) -> None:
        raw = b"".join(units)
        ends = np.cumsum([len(u) for u in units])
        text = raw.decode()
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        if not (self._gives_back(self.a_bytes, a, raw) and self._gives_back(self.b_bytes, b, raw)):
            if len(units) > 1:  # one of them is at fault
                for unit in units:
                    self._encode([unit])
                return
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self._keep(units, a, b, a, b, ends, good=False)
            return
        self._keep(units, a, b, np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), ends, good=True)

    def _gives_back(self, entries: pa.Array, ids: np.ndarray, raw: bytes) -> bool:
        return textscan.utf8(entries.take(pa.array(ids)))[0].tobytes() == raw

    def _keep(self, units: list[bytes], a, b, a_ends, b_ends, ends, good: bool) -> None:
        """Groups, links and pairs of tokens that end at these bytes."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_count, b_count = (np.bincount(x, minlength=len(common)) for x in (a_group, b_group))
        unit = np.searchsorted(ends, common)
        n = len(units)
        sums = np.zeros((n, 4), np.int64)
        for k, x in enumerate((a_count, b_count, np.ones(len(common), np.int64), a_count * b_count)):
            np.add.at(sums[:, k], unit, x)
        # Every token at its place in the order of the groups, A's before B's.
        places = np.empty(len(a) + len(b), np.int64)
        a_at = np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group] if len(a) else a
        b_at = np.arange(len(b)) + np.cumsum(a_count)[b_group] if len(b) else b
        places[a_at] = a + len(self.a_bytes) * (common[a_group] == a_ends)
        places[b_at] = b + len(self.b_bytes) * (common[b_group] == b_ends) + 2 * len(self.a_bytes)
        letters, bounds = textscan.utf8(self.written.take(pa.array(places)))
        cuts = bounds[np.concatenate([[0], np.cumsum(sums[:, 0] + sums[:, 1])])]
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])

        owner, code, times = _links(a, b, a_count, b_count, unit)
        order = np.lexsort((code, owner))
        owner, code, times = owner[order], code[order], times[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        self.known.update(zip(units, range(len(self.known), len(self.known) + n)))
        times = np.add.reduceat(times, at) if len(at) else times
        self._fresh.append((sums, np.full(n, good), text, np.bincount(owner[at], minlength=n), code[at], times))


def _a_entries(library, rules: dict) -> tuple[pa.Array, bool]:
    """The bytes of each token of A, and whether its rules are the ones that allow cuts."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    back = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}
    names = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
    special = {t["id"] for t in rules["added_tokens"]}
    entries = [
        names[i].encode() if i in special else bytes(back[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)
    ]
    split = rules["pre_tokenizer"] or {}
    return pa.array(entries, pa.large_binary()), rules["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", False)


def _links(a, b, a_count, b_count, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all groups: the unit, the pair of ids as one number, and how often."""
    links = a_count * b_count
    a_first, b_first = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
    small = np.flatnonzero(links < _WIDE)
    own = links[small]
    group = np.repeat(small, own)
    place = np.arange(len(group)) - np.repeat(np.cumsum(own) - own, own)
    code = (a[a_first[group] + place // b_count[group]] << 32) | b[b_first[group] + place % b_count[group]]
    parts = [(unit[group], code, np.ones(len(code), np.int64))]
    for g in np.flatnonzero(links >= _WIDE).tolist():
        x, x_times = np.unique(a[a_first[g] : a_first[g] + a_count[g]], return_counts=True)
        y, y_times = np.unique(b[b_first[g] : b_first[g] + b_count[g]], return_counts=True)
        parts.append((np.full(len(x) * len(y), unit[g]), ((x << 32)[:, None] | y).ravel(), np.outer(x_times, y_times).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


_aligners: dict[str, Aligner] = {}


def _aligner(shipped):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *files = shipped.value
        if name not in _aligners:  # what the worker has met serves its next task too
            _aligners.clear()
            _aligners[name] = Aligner(*files)
        own = _aligners[name]
        for whole in parts:
            for batch in textscan.pieces(whole, "text", _PIECE):
                yield _aligned(own, batch)

    return run


def _aligned(own: Aligner, batch: pa.RecordBatch) -> pa.RecordBatch:
    column = batch.column("text")
    lengths = np.diff(textscan.utf8(column)[1])
    some = np.flatnonzero(lengths)
    raw = b"".join([b" " + x for x in column.take(pa.array(some)).to_pylist()])
    data = np.frombuffer(raw, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths[some] + 1)])
    starts, first = own.units(data, bounds)
    cuts = np.concatenate([starts, [len(data)]]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
    units = coded.dictionary.to_pylist()
    if len(own.known) > REMEMBERED:
        own.forget()
    own.learn([u for u in units if u not in own.known])
    number = np.array([own.known[u] for u in units], np.int64)
    at = number[coded.indices.to_numpy()]
    texts = np.repeat(np.arange(len(some)), np.diff(first))

    n = len(some)
    good = np.ones(n, bool)
    good[texts[~own.good[at]]] = False
    sums = np.add.reduceat(own.sums[at], first[:-1], axis=0) if n else np.zeros((0, 4), np.int64)
    letters, ends = textscan.utf8(own.text.take(pa.array(at)))
    view = memoryview(np.ascontiguousarray(letters))
    spans = ends[first].tolist()
    digests = [hashlib.sha256(view[s : e - 1]).hexdigest() if ok else "" for s, e, ok in zip(spans, spans[1:], good.tolist())]

    # The pairs of a text's different units, each as often as its unit occurs.
    codes, often = np.unique(texts * len(own.good) + at, return_counts=True)
    owner, unit = codes // max(len(own.good), 1), codes % max(len(own.good), 1)
    sizes = own.first[unit + 1] - own.first[unit]
    place = np.arange(int(sizes.sum())) + np.repeat(own.first[unit] - (np.cumsum(sizes) - sizes), sizes)
    owner, pair, times = np.repeat(owner, sizes), own.pairs[place], own.times[place] * np.repeat(often, sizes)
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    owner, pair, times = owner[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times
    keep = good[owner]
    owner, pair, times = owner[keep], pair[keep], times[keep]
    cut = np.searchsorted(owner, np.arange(n + 1)).tolist()

    rows = batch.num_rows
    out = np.zeros((rows, 4), np.int64)
    out[some[good]] = sums[good]
    names, pairs, counts = [""] * rows, [b""] * rows, [b""] * rows
    for k, row in enumerate(some.tolist()):
        names[row] = digests[k]
        pairs[row], counts[row] = _packed(pair[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]])
    return pa.RecordBatch.from_arrays(
        [batch.column("key"), batch.column("copies"), *(pa.array(out[:, k]) for k in range(4)), pa.array(names, pa.string()), pa.array(pairs, pa.binary()), pa.array(counts, pa.binary())],
        ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def _packed(pairs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted pairs: ids of A as steps from the one before, and ids of B, 32 bits each;
    and how often each is linked."""
    halves = np.empty((2, len(pairs)), "<u4")
    halves[0] = np.diff(pairs >> 32, prepend=0)
    halves[1] = pairs & 0xFFFFFFFF
    return halves.tobytes(), times.astype("<u4" if not len(times) or times.max() < 1 << 32 else "<u8").tobytes()


def _unpacked(pairs: list[bytes], times: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all rows, the bounds of each row's, and how often each is linked."""
    sizes = np.array([len(x) // 8 for x in pairs], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), np.int64)
    often = np.zeros(len(out), np.int64)
    for k, raw in enumerate(pairs):
        if raw:
            halves = np.frombuffer(raw, "<u4").reshape(2, -1).astype(np.int64)
            out[bounds[k] : bounds[k + 1]] = (np.cumsum(halves[0]) << 32) | halves[1]
            if times is not None:
                often[bounds[k] : bounds[k + 1]] = np.frombuffer(times[k], "<u4" if len(times[k]) == 4 * sizes[k] else "<u8")
    return out, bounds, often


def _count_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a task's texts, and the number of documents that hold each."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, docs = (np.concatenate(x) for x in zip(held, *waiting))
        order = np.argsort(pairs, kind="stable")
        pairs, docs = pairs[order], docs[order]
        heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        return pairs[heads], np.add.reduceat(docs, heads) if len(heads) else docs

    def sent(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in found], ["pair", "docs"])

    for whole in parts:
        for batch in textscan.pieces(whole, "pairs", 8 * _PIECE):
            pairs, bounds, _ = _unpacked(batch.column("pairs").to_pylist(), None)
            waiting.append((pairs, np.repeat(batch.column("copies").to_numpy(), np.diff(bounds))))
            count += len(pairs)
            if count > COUNTED_PAIRS:
                held, waiting, count = merged(), [], 0
                if len(held[0]) > COUNTED_PAIRS:
                    yield from sent(held)
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield from sent(merged())


def _most_frequent(ranked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with the highest counts, ``TABLE_PAIRS`` at most: all whose count reaches a
    step of a histogram. Sorted by pair, with counts and whether they are their A id's best."""
    step = F.floor(F.log2(F.col("docs").cast("double")) * _STEPS).cast("int")
    steps = sorted(((r[0], r[1]) for r in ranked.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in steps:
        if total + n > TABLE_PAIRS:
            break
        total, least = total + n, at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    table = ranked.filter(step >= least).toArrow()
    pairs = table["pair"].to_numpy()
    order = np.argsort(pairs)
    return pairs[order], table["docs"].to_numpy()[order], table["best"].to_numpy()[order]


def _measure(table):
    """Each text's sums over the pairs of the table, and a row for each of its other pairs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = table.value
        for whole in parts:
            for batch in textscan.pieces(whole, "pairs", 8 * _PIECE):
                pairs, bounds, times = _unpacked(batch.column("pairs").to_pylist(), batch.column("times").to_pylist())
                n = batch.num_rows
                owner = np.repeat(np.arange(n), np.diff(bounds))
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                inside = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                sums = []
                for values in (best, docs):
                    adds = np.zeros(len(pairs) + 1, np.int64)
                    adds[1:][inside] = times[inside] * values[at[inside]]
                    sums.append(np.diff(np.cumsum(adds)[bounds]))
                rest = ~inside
                more = int(rest.sum())
                keys = pa.concat_arrays([batch.column("key"), batch.column("key").take(pa.array(owner[rest]))])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(np.concatenate([np.zeros(n, np.int64), pairs[rest]]), mask=np.arange(n + more) < n),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times[rest]])),
                        *(pa.array(np.concatenate([x, np.zeros(more, np.int64)])) for x in sums),
                    ],
                    ["key", "pair", "times", "n_best", "count_sum"],
                )

    return run
