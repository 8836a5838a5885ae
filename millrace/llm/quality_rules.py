"""Quality rules: decision lists learned from labelled statistics.

Sequential covering on two label values. A rule is a conjunction of thresholds. It is grown
on one part of the labelled documents, one threshold at a time by information gain, pruned
on the other part, and kept if it is precise there; what it covers is taken away and the
next rule is learned. The result is an ordered list that reads, and runs, as one Spark
conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textscan
from millrace.llm.sampling import first_by_hash

#: Labelled documents of either label to learn from, at most.
SAMPLE = 8000
#: Thresholds tried for a feature: so many quantiles of its values.
CUTS = 48
#: Thresholds of a rule, and rules of a list, at most.
CONDITIONS, RULES = 4, 24
#: A rule must be right for this share of the pruning documents that it covers, and of the
#: growing ones, and must cover so many documents of the label.
PRECISION, SUPPORT = 0.95, 5

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Base rules: fewer words than this, or more than this percentage of repeated ones.
FEWEST_WORDS, MOST_REPEATED = 50, 50

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"
)

#: What conditions may be about. Ratios are per word or per character.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "mark_ratio": ("n_marks", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "distinct_ratio": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut!r}"

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, list(FEATURES).index(self.feature)]
        return column >= self.cut if self.above else column < self.cut


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Documents that one of the ordered ``rules`` covers are rejected, all others kept."""

    rules: tuple[Rule, ...]

    def rejected_by(self) -> Column:
        """The number of the first rule that covers a row, from 1 on, or 0."""
        chain = None
        for number, rule in enumerate(self.rules, 1):
            met = F.expr(" AND ".join(_sql(c) for c in rule))
            chain = F.when(met, number) if chain is None else chain.when(met, number)
        return F.lit(0) if chain is None else chain.otherwise(0)


def _ratio(feature: str) -> str:
    over, under = FEATURES[feature]
    return f"coalesce(`__{over}` / nullif(cast(`__{under}` as double), 0), 0D)" if under else f"cast(`__{over}` as double)"


def _sql(condition: Condition) -> str:
    return f"{_ratio(condition.feature)} {'>=' if condition.above else '<'} {condition.cut!r}D"


def with_statistics(rows: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add a long column ``__<name>`` for each of ``STATISTICS`` to rows, which keep all
    columns, or those of ``keep``; columns of these names are replaced.

    Words are the runs between ASCII white space. ``word_chars`` counts the code points in
    words, ``n_symbols`` the characters of ``SYMBOLS``. Lines end with a line feed;
    ``n_lines`` counts those that hold a word and ``n_dup_lines`` those of them that equal
    an earlier one. ``n_repeat_words`` counts the words within runs of three words that the
    text holds twice or more. ``n_upper`` counts capital ASCII letters, ``n_digits`` ASCII
    digits, ``n_marks`` words whose last two bytes are no letters or digits, ``n_distinct``
    different words. A null text counts as empty: all zero.
    """
    names = [f"__{n}" for n in STATISTICS]
    columns = [c for c in (rows.columns if keep is None else keep) if c not in names]
    schema = rows.select(*columns).withColumns({n: F.lit(0).cast("long") for n in names}).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in textscan.pieces(whole, text_col):
                found = measure(textscan.texts_of(batch, text_col))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), *(pa.array(found[n]) for n in STATISTICS)], [*columns, *names]
                )

    return rows.mapInArrow(run, schema)


_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_IS_SYMBOL, _IS_UPPER, _IS_DIGIT = (np.isin(np.arange(256), [ord(c) for c in s]) for s in (SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_IS_MARK = np.array([i < 128 and not chr(i).isalnum() and i > 32 for i in range(256)])


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    data, bounds = textscan.utf8(texts)
    starts, lengths, first = textscan.spans(data, bounds, textscan.SPACE)
    words = textscan.hashes(data, starts, lengths)
    last = data[starts + lengths - 1] if len(starts) else np.zeros(0, np.uint8)
    before = data[starts + np.maximum(lengths - 2, 0)] if len(starts) else last
    found = {
        "n_words": np.diff(first),
        "word_chars": _per_text(~textscan.SPACE[data] & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _per_text(_IS_SYMBOL[data], bounds),
        "n_upper": _per_text(_IS_UPPER[data], bounds),
        "n_digits": _per_text(_IS_DIGIT[data], bounds),
        "n_marks": _per_text(_IS_MARK[last] & _IS_MARK[before] & (lengths > 1), first),
        "n_distinct": _distinct(words, first),
        "n_repeat_words": _repeated(words, first),
    }
    found["n_lines"], found["n_dup_lines"] = _lines(data, bounds, starts)
    return {name: found[name].astype(np.int64) for name in STATISTICS}


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    so_far = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return so_far[bounds[1:]] - so_far[bounds[:-1]]


def _ranked(values: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal values of one text next to each other, and which places in
    that order start a new value."""
    mixed = textscan.mix(values ^ textscan.mix(texts.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    fresh = np.ones(len(values), bool)
    fresh[1:] = (mixed[order][1:] != mixed[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    return order, fresh


def _distinct(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order, fresh = _ranked(words, texts)
    return np.bincount(texts[order][fresh], minlength=len(first) - 1)


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    runs, at = textscan.windows(words, first, 3)
    texts = np.searchsorted(first, at, "right") - 1
    order, fresh = _ranked(runs, texts)
    again = np.zeros(len(runs), bool)
    again[1:] = ~fresh[1:]
    again[:-1] |= ~fresh[1:]
    places = at[order[again]]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[places + k] = True
    return _per_text(covered, first)


def _lines(data: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line of their text."""
    starts, lengths, first = textscan.spans(data, bounds, _LINE_END)
    held = np.searchsorted(words, starts + lengths) > np.searchsorted(words, starts)
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(first))[held]
    hashed = _line_hashes(data, starts[held], lengths[held])
    order, fresh = _ranked(hashed, texts)
    return np.bincount(texts, minlength=len(bounds) - 1), np.bincount(texts[order][~fresh], minlength=len(bounds) - 1)


def _line_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each line: the sum of its bytes, each mixed with its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for s in range(0, len(starts), 2000):
        own, size = starts[s : s + 2000], lengths[s : s + 2000]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        values = textscan.mix((place.astype(np.uint64) << np.uint64(8)) + data[np.repeat(own, size) + place])
        out[s : s + 2000] = np.add.reduceat(values, np.cumsum(size) - size)
    return textscan.mix(out ^ lengths.astype(np.uint64))


def base_failed() -> Column:
    """The rules that hold whatever the labels say."""
    return F.expr(f"__n_words < {FEWEST_WORDS} OR 100 * __n_repeat_words > {MOST_REPEATED} * __n_words")


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(__id, good)`` for at most ``SAMPLE`` ids of either label, the first by a hash of
    the id. Null ids and labels are left out; an id with several labels has the lowest."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = known.groupBy(F.col(id_col).alias("__id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("good"))
    return first_by_hash(marked, "good", F.col("__id"), SAMPLE, 9).drop("__at")


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """Learn which documents to reject: those labelled 0 among the ones that the base rules
    let through. ``measured`` has the statistics of all documents, or of the labelled ones
    at least; of rows that share an id, those with the least features are learned from.
    Without documents of both labels the list is empty, and keeps everything."""
    # Bounded by SAMPLE, whatever the number of labels.
    sample = F.broadcast(labelled_sample(labels, id_col, label_col))
    features = [F.expr(_ratio(f)).alias(f) for f in FEATURES]
    passed = measured.filter(~base_failed()).select(F.col(id_col).alias("__own"), F.struct(*features).alias("__features"))
    rows = passed.join(sample, F.col("__own") == F.col("__id")).groupBy("__id", "good").agg(F.min("__features").alias("__features"))
    # One row for each id of the sample, however many rows share it.
    table = rows.select("good", F.xxhash64(F.col("__id").cast("string"), F.lit(10)).alias("part"), "__features.*").toPandas()
    table = table.sort_values(["part", *FEATURES], kind="stable")
    values, bad = table[list(FEATURES)].to_numpy(np.float64), table["good"].to_numpy() == 0
    growing = (table["part"].to_numpy() % 3) != 0
    return DecisionList(tuple(cover(values[growing], bad[growing], values[~growing], bad[~growing])))


def cover(grow: np.ndarray, grow_bad: np.ndarray, prune: np.ndarray, prune_bad: np.ndarray) -> list[Rule]:
    """Rules for the bad rows, learned one after the other from what earlier rules left."""
    rules: list[Rule] = []
    while grow_bad.any() and prune_bad.any() and len(rules) < RULES:
        rule = _prune(_grow(grow, grow_bad), prune, prune_bad)
        if not rule:
            break
        by_grow, by_prune = _covers(rule, grow), _covers(rule, prune)
        right = (prune_bad & by_prune).sum()
        if (
            right < SUPPORT
            or right < PRECISION * by_prune.sum()
            or (grow_bad & by_grow).sum() < PRECISION * by_grow.sum()
        ):
            break
        rules.append(rule)
        grow, grow_bad, prune, prune_bad = grow[~by_grow], grow_bad[~by_grow], prune[~by_prune], prune_bad[~by_prune]
    return rules


def _covers(rule: Sequence[Condition], values: np.ndarray) -> np.ndarray:
    held = np.ones(len(values), bool)
    for condition in rule:
        held &= condition.holds(values)
    return held


def _grow(values: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the threshold with the largest gain until only bad rows are covered. The gain is
    the covered bad rows times what the share of bad ones rises by, in bits."""
    rule: list[Condition] = []
    while len(rule) < CONDITIONS and bad.any() and not bad.all():
        share = math.log2(bad.mean())
        best, gain = None, 1e-9
        for k, feature in enumerate(FEATURES):
            column = values[:, k]
            for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS), method="higher")).tolist() + _between(column, bad):
                for above in (True, False):
                    held = column >= cut if above else column < cut
                    right = int((held & bad).sum())
                    if right and (more := right * (math.log2(right / held.sum()) - share)) > gain:
                        best, gain = Condition(feature, above, float(cut)), more
        if best is None:
            break
        held = best.holds(values)
        rule.append(best)
        values, bad = values[held], bad[held]
    return tuple(rule)


def _between(column: np.ndarray, bad: np.ndarray) -> list[float]:
    """Cuts halfway between the good rows and the quantiles of the bad ones beyond them."""
    good = column[~bad]
    marks = np.quantile(column[bad], [0.05, 0.25, 0.5, 0.75, 0.95])
    return [float((edge + m) / 2) for edge in (good.min(), good.max(), *np.quantile(good, [0.001, 0.999])) for m in marks]


def _prune(rule: Rule, values: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that does best on other rows: (right - wrong) / covered."""
    best, worth = (), -1.0
    for length in range(1, len(rule) + 1):
        held = _covers(rule[:length], values)
        if held.any() and (now := 2 * (bad & held).sum() / held.sum() - 1) > worth:
            best, worth = rule[:length], now
    return best


def judge(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """Add ``__base_failed``, ``__rule`` (the rejecting rule, or 0) and ``__kept``."""
    return measured.withColumns({"__base_failed": base_failed(), "__rule": rules.rejected_by()}).withColumn(
        "__kept", F.expr("NOT __base_failed AND __rule = 0")
    )


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that the base rules and the learned list keep."""
    sample = F.broadcast(labelled_sample(labels, id_col, label_col).select("__id"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, F.col("doc_id") == F.col("__id"))
    rules = learn(with_statistics(slim, keep=["doc_id"]), labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality")))
    whole = docs.select(F.struct(*docs.columns).alias("__row"))
    return judge(with_statistics(whole, f"__row.{text_col}"), rules).filter("__kept").select("__row.*")
