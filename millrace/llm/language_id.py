"""Languages of documents that may mix several.

A language is a distribution over letter trigrams, learned from labelled texts. A document's
trigrams are taken as drawn from a mixture of languages, whose proportions are estimated by
expectation-maximisation. The set of languages starts with the likeliest one and grows while
another language raises the log-likelihood by more than a penalty per language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan
from millrace.llm.sampling import first_by_hash

#: Trigrams are hashed to this many counters.
GRAMS = 1 << 15
#: Languages that a model may have: its tables go to every task.
LANGUAGES = 500
#: Labelled texts that a language is learned from, at most.
SAMPLE = 2000
#: A further language must raise the log-likelihood by this times the log of the number of
#: trigrams. Trigrams overlap, so one letter speaks three times.
PENALTY = 3.0
UNDETERMINED = "und"

_STEPS = 30
_CLOSE = 1e-4


@dataclass(frozen=True)
class LanguageModel:
    """``shares[g, k]`` is the probability of trigram ``g`` in language ``names[k]``."""

    names: tuple[str, ...]
    shares: np.ndarray


def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Learn from the rows where ``usable`` holds and text and language are not null.

    A language is learned from the ``SAMPLE`` rows that come first by a hash of their id, or
    from all if it has fewer; rows without an id are not learned from. Trigram counts are
    added up by Spark; what reaches the driver is the model itself. Without usable rows the
    model knows no language. More than ``LANGUAGES`` of them are refused.
    """
    lang = F.col(lang_col).cast("string")
    known = docs.filter(usable & F.col(text_col).isNotNull() & lang.isNotNull())
    known = known.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    names = sorted(r[0] for r in known.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"column {lang_col!r} has more than {LANGUAGES} values; the model holds a table for each")
    if not names:
        return LanguageModel((), np.zeros((GRAMS, 0)))
    chosen = first_by_hash(known.select("lang", "id"), "lang", F.col("id"), SAMPLE, 3)
    # Bounded by SAMPLE rows for each language.
    ids = F.broadcast(chosen.select("id").distinct())
    texts = known.join(ids, "id").select("lang", "text")
    counted = texts.mapInArrow(_counter(names), "lang int, gram int, n long")
    counts = np.full((GRAMS, len(names)), 0.5)
    for row in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.gram, row.lang] += row.n
    return LanguageModel(tuple(names), counts / counts.sum(axis=0))


def predict(model: LanguageModel, rows: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``proportions`` to rows, which keep all columns, or
    those of ``keep``; a column of one of these names is replaced.

    ``proportions`` maps the languages of the chosen set to their shares, which sum to 1.
    ``lang_pred`` has the largest share (ties: first by name), and ``score`` is that share;
    where one language is enough, it is its posterior probability among all. A null text or
    one without a letter is ``und`` with score 0 and no proportions, and so is every text
    if the model knows no language. Whole texts are used.
    """
    added = ["lang_pred", "score", "proportions"]
    columns = [c for c in (rows.columns if keep is None else keep) if c not in added]
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*columns).withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "proportions": F.lit(None).cast("map<string,double>")}
    ).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in textscan.pieces(whole, text_col):
                names, scores, shares = [], [], []
                for name, score, mixture in languages(shipped.value, textscan.texts_of(batch, text_col)):
                    names.append(name)
                    scores.append(score)
                    shares.append(mixture)
                found = [
                    pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))
                ]
                own = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, *found], [*columns, *added])

    return rows.mapInArrow(run, schema)


def languages(model: LanguageModel, texts: pa.Array) -> Iterator[tuple[str, float, list[tuple[str, float]] | None]]:
    """For each text its language, score and proportions."""
    logs = np.log(model.shares)
    for grams, counts in _profiles(texts):
        if not len(grams) or not model.names:
            yield UNDETERMINED, 0.0, None
            continue
        shares = model.shares[grams]
        single = counts @ logs[grams]
        chosen, weights = _choose(shares, counts, single)
        best = max(range(len(chosen)), key=lambda i: (weights[i], -chosen[i]))
        score = float(weights[best])
        if len(chosen) == 1:
            score = float(1 / np.exp(np.minimum(single - single[chosen[0]], 0)).sum())
        yield model.names[chosen[best]], score, sorted((model.names[k], float(w)) for k, w in zip(chosen, weights))


def _choose(shares: np.ndarray, counts: np.ndarray, single: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The set of languages and their proportions."""
    total = counts.sum()
    penalty = PENALTY * np.log(total + 1)
    chosen, weights = [int(np.argmax(single))], np.ones(1)
    likelihood = single[chosen[0]]
    while len(chosen) < shares.shape[1]:
        mixed = shares[:, chosen] @ weights
        pull = (counts / mixed) @ shares  # per language; above the total, more of it helps
        # The log-likelihood is concave: it can rise by no more than this.
        most = pull.max() - total
        following = int(np.argmax(pull))
        if most <= penalty or following in chosen:
            break
        wider = [*chosen, following]
        tried, reached = _proportions(shares[:, wider], counts, np.append(weights * 0.7, 0.3))
        if reached - likelihood <= penalty:
            break
        chosen, weights, likelihood = wider, tried, reached
    return chosen, weights


def _proportions(shares: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: each trigram is split among the languages as likely as they
    made it, and the proportions become what each language got."""
    weights, total = start, counts.sum()
    for _ in range(_STEPS):
        mixed = shares @ weights
        fresh = weights * ((counts / mixed) @ shares) / total
        moved = np.abs(fresh - weights).max()
        weights = fresh
        if moved < _CLOSE:
            break
    return weights, float(counts @ np.log(shares @ weights))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _profiles(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The trigrams of each text and their counts. Letters are taken in lower case, a run of
    anything else counts as one space, and a text begins and ends with a space."""
    lowered = pc.utf8_lower(texts)
    data, bounds = textscan.utf8(lowered)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        points = np.frombuffer(data[s:e].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        is_letter = _letters()[points]
        if not is_letter.any():
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        line = np.zeros(len(points) + 2, np.uint32)
        line[1:-1] = np.where(is_letter, points, 0)
        blank = line == 0
        keep = np.ones(len(line), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        line = line[keep]
        grams = ((line[:-2] * np.uint32(0x9E3779B1) + line[1:-1]) * np.uint32(0x85EBCA6B) + line[2:]) * np.uint32(0xC2B2AE35)
        counts = np.bincount(grams >> np.uint32(17), minlength=GRAMS)
        present = np.flatnonzero(counts)
        yield present, counts[present].astype(np.float64)


def _counter(names: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(names)}
        counts = np.zeros((len(names), GRAMS), np.int64)
        for whole in parts:
            for batch in textscan.pieces(whole, "text"):
                for lang, (grams, n) in zip(batch.column("lang").to_pylist(), _profiles(batch.column("text"))):
                    counts[place[lang], grams] += n.astype(np.int64)
        k, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(counts[k, g])], ["lang", "gram", "n"]
        )

    return run
