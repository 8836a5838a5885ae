"""Toxicity of documents: a convolutional text classifier trained in numpy.

A word is looked up by hash in several embedding tables at once, so two words are taken
for each other only if they collide in all of them. Filters of several widths run over the
words, each filter keeps its largest value over the whole text, and a linear layer makes
these into a logit. Scores are shifted by a threshold per language, so that 0.5 is where
labelled texts of that language are told apart best. The language is inferred from the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import filters, language_id, textscan
from millrace.llm.sampling import first_by_hash

#: Labelled documents of either label to learn from, and which part of them (every so many)
#: is kept from training. Thresholds are set with all labelled documents not trained with.
SAMPLE, HELD = 5000, 5
#: Words of one text that are learned from at most. A longer text gives runs of so many words.
TEXT_WORDS, RUN = 2_000, 100
#: A language with fewer calibration texts of either label takes the common threshold.
FEWEST = 20
#: Logits of calibration texts are counted in so many cells.
CELLS = 4096

_TABLES, _BUCKETS, _DIMS = 3, 1 << 14, 6
_WIDTHS, _FILTERS = (1, 2, 3), 8
_EPOCHS, _STEPS, _BATCH, _RATE = 5, 300, 64, 0.05

#: Words are runs of ASCII letters, digits and bytes of other scripts' letters.
_SEPARATORS = np.array([not (i >= 128 or chr(i).isalnum()) for i in range(256)])
_WIDE = _DIMS * _TABLES
_PIECE = 1 << 20


@dataclass
class Network:
    tables: np.ndarray  # table, bucket, dimension
    filters: dict[int, np.ndarray]  # by width: place in the window, dimension, filter
    bias: np.ndarray
    out: np.ndarray
    base: float = 0.0


@dataclass
class ToxicityModel:
    network: Network | None
    languages: language_id.LanguageModel
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.0


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str = "lang",
) -> ToxicityModel:
    """Learn from the labelled documents whose id satisfies ``usable``, an expression over
    ``id_col`` alone.

    At most ``SAMPLE`` documents of either label are used, those that come first by a hash
    of their id, and of each at most ``TEXT_WORDS`` words, in runs from all over the text; of
    documents that share an id, the network is fitted to one. Thresholds are set with all
    labelled documents that the network was not fitted to. Null labels and ids are left out; an id that is labelled
    several times counts as toxic if any label says so. If either label is missing, the
    model scores every text 0.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = known.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    # Bounded by the parameters above, whatever the number of labels.
    sample = first_by_hash(marked, "label", F.col("__id"), SAMPLE, 6).withColumnRenamed("__at", "at")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id")

    tongues = language_id.learn(docs, usable, text_col, lang_col, id_col)
    texts = rows.filter(F.col("at") % HELD != 0).mapInArrow(_hashed_words, "label int, at int, words binary")
    # Bounded by SAMPLE and TEXT_WORDS, whatever the number of rows with one id.
    chosen = texts.groupBy("label", "at").agg(F.min("words").alias("words")).toArrow().sort_by([("at", "ascending"), ("label", "ascending")])
    truth = chosen["label"].to_numpy()
    if len(np.unique(truth)) < 2:
        return ToxicityModel(None, tongues)
    network = _fit([np.frombuffer(w.as_buffer(), np.uint64) for w in chosen["words"]], truth.astype(np.float32))
    raw = ToxicityModel(network, tongues)
    shares = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    trained = F.broadcast(sample.filter(F.col("at") % HELD != 0).select("__id"))
    held = _by_cell(raw, docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), marked.join(trained, "__id", "left_anti"))
    seen = held.groupby("label")["n"].sum()
    if len(seen) < 2:
        return raw
    n, logits, truth = held["n"].to_numpy(), held["logit"].to_numpy(), held["label"].to_numpy() == 1
    weights = n * held["label"].map(lambda x: shares[x] / seen[x]).to_numpy()
    raw.common = _threshold(logits, truth, weights)
    for name in held["lang"].unique():
        own = (held["lang"] == name).to_numpy()
        if min(n[truth & own].sum(), n[~truth & own].sum()) >= FEWEST:
            raw.thresholds[name] = _threshold(logits[own], truth[own], weights[own])
    return raw


def score(model: ToxicityModel, rows: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on) to rows, which
    keep all columns, or those of ``keep``; a column of one of these names is replaced.

    Only the text is looked at, and all of it. A null text counts as empty, and an empty
    text has the score of a text in which no filter found anything.
    """
    kept = [c for c in (rows.columns if keep is None else keep) if c not in ("score", "predicted")]
    added = filters.free_names(rows.columns, "__lang", "__logit", "__threshold")
    logit = F.col(added[1]) - F.col(added[2])
    found = _scored(model, rows, text_col, kept, added).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    if model.network is None:
        found = found.withColumn("score", F.lit(0.0))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*added)


def drop_toxic(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic."""
    model = train(docs, labels, **columns)
    whole = docs.select(F.struct(*docs.columns).alias("__kept"))
    scored = score(model, whole, f"__kept.{columns.get('text_col', 'text')}")
    return scored.filter("predicted = 0").select("__kept.*")


def _scored(
    model: ToxicityModel, rows: DataFrame, text_col: str, columns: list[str], added: Sequence[str] = ("__lang", "__logit", "__threshold")
) -> DataFrame:
    """Add the inferred language, the logit and the language's threshold under these names."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*columns).withColumns(dict(zip(added, (F.lit(""), F.lit(0.0), F.lit(0.0))))).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for whole in parts:
            for batch in textscan.pieces(whole, text_col, _PIECE):
                texts = textscan.texts_of(batch, text_col)
                if known.network is None:
                    tongues, logits = [language_id.UNDETERMINED] * len(texts), np.zeros(len(texts))
                else:
                    words, first = _words(texts)
                    logits = _logits(known.network, words, first)
                    tongues = [x[0] for x in language_id.languages(known.languages, texts)]
                limits = [known.thresholds.get(x, known.common) for x in tongues]
                found = [pa.array(tongues, pa.string()), pa.array(logits.astype(np.float64)), pa.array(limits, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, *added])

    return rows.mapInArrow(run, schema)


def _by_cell(model: ToxicityModel, texts: DataFrame, marked: DataFrame) -> pd.DataFrame:
    """How many texts of the marked ids there are (``n``), by label, inferred language and
    cell of the logit, which is given by its middle.

    Cells are ``CELLS`` equal parts of what the network can give at all. Texts are scored
    where they are read, and only ids, languages and cells are joined with the labels.
    """
    def digest(column: str) -> Column:
        return F.xxhash64(F.col(column).cast("string"))

    reach = float(np.abs(model.network.out).sum()) or 1.0
    least, step = float(model.network.base) - reach, 2 * reach / CELLS
    near = filters.maybe_in(texts, digest("__id"), marked.select(digest("__id").alias("__digest")), "__digest").filter("__maybe")
    cell = F.least(F.greatest(F.floor((F.col("__logit") - least) / step), F.lit(0)), F.lit(CELLS - 1))
    placed = _scored(model, near, "text", ["__id"]).select("__id", F.col("__lang").alias("lang"), cell.alias("cell"))
    # Bounded by labels, languages and cells.
    counts = placed.join(marked, "__id").groupBy("label", "lang", "cell").agg(F.count("*").alias("n")).orderBy("lang", "cell", "label").toPandas()
    return counts.assign(logit=least + (counts["cell"].astype("float64") + 0.5) * step)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = textscan.utf8(pc.utf8_lower(texts))
    starts, lengths, first = textscan.spans(data, bounds, _SEPARATORS)
    return textscan.hashes(data, starts, lengths), first


def _hashed_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in parts:
        for batch in textscan.pieces(whole, "text"):
            words, first = _words(batch.column("text"))
            lines = [_spread(words[s:e]).tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(lines, pa.binary())], ["label", "at", "words"])


def _spread(words: np.ndarray) -> np.ndarray:
    """All words of a text, or of a long one a run from each of as many equal stretches as
    there may be runs. Where in its stretch a run begins is drawn by a hash of the text."""
    if len(words) <= TEXT_WORDS:
        return words
    runs = TEXT_WORDS // RUN
    cuts = np.arange(runs + 1) * len(words) // runs
    drawn = textscan.mix(np.bitwise_xor.reduce(words) + np.arange(runs, dtype=np.uint64))
    starts = cuts[:-1] + (drawn % (np.diff(cuts) - RUN + 1).astype(np.uint64)).astype(np.int64)
    return words[(starts[:, None] + np.arange(RUN)).ravel()]


def _buckets(words: np.ndarray) -> np.ndarray:
    """The bucket of each word in each table: separate bits of its hash."""
    shifts = np.arange(_TABLES, dtype=np.uint64) * np.uint64(20)
    return ((words[None, :] >> shifts[:, None]) & np.uint64(_BUCKETS - 1)).astype(np.int32)


def _embedded(network: Network, buckets: np.ndarray) -> np.ndarray:
    return np.concatenate([network.tables[t].take(buckets[t], axis=0) for t in range(_TABLES)], axis=1)


def _convolved(network: Network, embedded: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each width, what its filters give at each word. Beyond a text's end there is nothing."""
    ends = first[1:]
    for width in _WIDTHS:
        total = embedded @ network.filters[width][0]
        for place in range(1, width):
            more = embedded @ network.filters[width][place]
            total[:-place] += more[place:]
            for back in range(1, place + 1):  # words of the next text
                at = ends - back
                at = at[(at >= 0) & (at + place < len(embedded))]
                total[at] -= more[at + place]
        yield width, total


def _logits(network: Network, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    pooled = np.zeros((len(first) - 1, len(_WIDTHS) * _FILTERS), np.float32)
    filled = np.flatnonzero(np.diff(first))
    step = 200_000  # words at a time; a text longer than that is read in overlapping parts
    for s, e, texts, cuts in _stretches(first, filled, step):
        embedded = _embedded(network, _buckets(words[s:e]))
        for k, (_, total) in enumerate(_convolved(network, embedded, cuts)):
            most = np.maximum.reduceat(total, cuts[:-1], axis=0)
            own = slice(k * _FILTERS, (k + 1) * _FILTERS)
            fresh = pooled[texts, own] == 0
            pooled[texts, own] = np.where(fresh, most, np.maximum(pooled[texts, own], most))
    pooled[filled] = np.tanh(pooled[filled] + network.bias)
    return pooled @ network.out + network.base


def _stretches(first: np.ndarray, filled: np.ndarray, step: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts with about ``step`` words. A longer text comes in parts that
    overlap by the widest window, which leaves its largest values as they are."""
    at = 0
    over = max(_WIDTHS) - 1
    while at < len(filled):
        s = int(first[filled[at]])
        end = at + 1
        while end < len(filled) and first[filled[end] + 1] - s <= step:
            end += 1
        e = int(first[filled[end - 1] + 1])
        if e - s <= step:
            texts = filled[at:end]
            yield s, e, texts, np.append(first[texts], e) - s
        else:
            for part in range(s, e, step):
                stop = min(part + step + over, e)
                if part == s or stop - part > over:
                    yield part, stop, filled[at : at + 1], np.array([0, stop - part])
        at = end


def _fit(texts: list[np.ndarray], labels: np.ndarray) -> Network:
    rng = np.random.default_rng(6)
    network = _started(texts, labels, rng)
    rates = {"tables": np.full(network.tables.shape, 1e-3, np.float32)} | {w: np.full(f.shape, 1e-2, np.float32) for w, f in network.filters.items()}
    rates |= {"bias": np.full(network.bias.shape, 1e-2, np.float32), "out": np.full(network.out.shape, 1e-2, np.float32)}
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
    # Texts of like length go together, so that no batch is much larger than the others.
    order = np.argsort([len(x) for x in texts], kind="stable")
    # A small sample is gone through more often.
    for _ in range(max(_EPOCHS, -(-_STEPS * _BATCH // len(order)))):
        for at in rng.permutation(np.arange(0, len(order), _BATCH)).tolist():
            chosen = [i for i in order[at : at + _BATCH].tolist() if len(texts[i])]
            if chosen:
                _step(network, rates, [_buckets(texts[i]) for i in chosen], labels[chosen], weight[chosen])
    return network


def _started(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Network:
    """Small random numbers, but the first dimension of a bucket says how surely toxic texts
    have it more often than others (log-odds over their error); training starts there."""
    seen = np.ones((2, _TABLES, _BUCKETS))
    for words, label in zip(texts, labels):
        for t, own in enumerate(_buckets(words)):
            seen[int(label > 0), t, np.unique(own)] += 1
    odds = np.log(seen[1] / (labels > 0).sum()) - np.log(seen[0] / (labels <= 0).sum())
    tables = rng.normal(0, 0.1, (_TABLES, _BUCKETS, _DIMS)).astype(np.float32)
    tables[:, :, 0] = np.clip(odds / np.sqrt(1 / seen[0] + 1 / seen[1]) / 5, -1, 1)
    filters = {w: rng.normal(0, 0.1, (w, _WIDE, _FILTERS)).astype(np.float32) for w in _WIDTHS}
    for f in filters.values():
        f[:, ::_DIMS, :] += rng.uniform(0, 1.0 / _TABLES, (f.shape[0], _TABLES, _FILTERS)).astype(np.float32)
    n = len(_WIDTHS) * _FILTERS
    return Network(tables, filters, np.full(n, -0.5, np.float32), rng.uniform(0, 0.5, n).astype(np.float32))


def _step(network: Network, rates: dict, buckets: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
    """One step of adaptive gradient descent on the logistic loss."""
    joined = np.concatenate(buckets, axis=1)
    first = np.concatenate([[0], np.cumsum([b.shape[1] for b in buckets])])
    embedded = _embedded(network, joined)
    pooled, peaks = [], []
    for _, total in _convolved(network, embedded, first):
        peak = np.stack([s + total[s:e].argmax(axis=0) for s, e in zip(first[:-1].tolist(), first[1:].tolist())])
        peaks.append(peak)
        pooled.append(np.take_along_axis(total, peak, axis=0))
    hidden = np.tanh(np.concatenate(pooled, axis=1) + network.bias)
    logits = hidden @ network.out + network.base
    slope = (weight * (1 / (1 + np.exp(-logits)) - labels) / len(labels)).astype(np.float32)
    back = slope[:, None] * network.out[None, :] * (1 - hidden * hidden)
    network.base -= _RATE * float(slope.sum())
    _descend(network.out, rates["out"], hidden.T @ slope)
    _descend(network.bias, rates["bias"], back.sum(axis=0))
    places, grads = [], []
    ends = np.repeat(first[1:], _FILTERS)
    for k, width in enumerate(_WIDTHS):
        own = back[:, k * _FILTERS : (k + 1) * _FILTERS]
        by_filter = np.zeros_like(network.filters[width])
        for place in range(width):
            at = (peaks[k] + place).ravel()
            inside = at < ends
            at = np.where(inside, at, 0)
            pull = (own.ravel() * inside)[:, None]
            which = np.tile(np.arange(_FILTERS), len(first) - 1)
            np.add.at(by_filter[place].T, which, embedded[at] * pull)
            places.append(at)
            grads.append(network.filters[width][place].T[which] * pull)
        _descend(network.filters[width], rates[width], by_filter)
    places, grads = np.concatenate(places), np.concatenate(grads)
    for t in range(_TABLES):
        rows, back_to = np.unique(joined[t][places], return_inverse=True)
        total = np.zeros((len(rows), _DIMS), np.float32)
        np.add.at(total, back_to, grads[:, t * _DIMS : (t + 1) * _DIMS])
        rates["tables"][t][rows] += total * total
        network.tables[t][rows] -= _RATE * total / np.sqrt(rates["tables"][t][rows])


def _descend(values: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
    squares += gradient * gradient
    values -= _RATE * gradient / np.sqrt(squares)


def _threshold(logits: np.ndarray, truth: np.ndarray, weights: np.ndarray) -> float:
    """Where the fewest labelled documents are on the wrong side, each counted for as many
    as it stands for; of a stretch that is as good, the middle."""
    order = np.argsort(logits, kind="stable")
    logits, truth, weights = logits[order], truth[order], weights[order]
    missed = np.concatenate([[0], np.cumsum(np.where(truth, weights, 0))])
    blamed = np.concatenate([np.cumsum(np.where(truth, 0, weights)[::-1])[::-1], [0]])
    wrong = missed + blamed
    wrong[1:-1][logits[1:] == logits[:-1]] = np.inf
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    cut = int(best[len(best) // 2])
    below = logits[cut - 1] if cut else logits[0] - 1
    above = logits[cut] if cut < len(logits) else logits[-1] + 1
    return float((below + above) / 2)
