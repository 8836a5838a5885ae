"""Words of a batch of texts, found in the Arrow buffer itself.

A text column is one run of UTF-8 bytes and an array of offsets. Words are found and hashed
there for all texts of a batch at once, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Texts are taken together up to this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Words of more bytes than this are hashed in runs of so many bytes, and so many at a time.
_STEPS, _RUN, _TOGETHER_BYTES = 64, 4096, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values, so that near values end up far apart."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the len + 1 offsets of its values; a
    null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column of a batch, or a field of a struct column as ``column.field``."""
    outer, _, inner = column.partition(".") if column not in batch.schema.names else (column, "", "")
    found = batch.column(outer)
    return found.field(inner) if inner else found


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes."""
    _, bounds = utf8(texts_of(batch, column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the first word of each text (len + 1 numbers).

    A word is a longest run of bytes of one text that are not separators.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    word = ~separators[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True  # words do not run from one text into the next
    begins = word.copy()
    begins[1:] &= ~word[:-1] | fresh[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return starts, lengths, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as digits of a number, scattered.

    Takes a step per byte of the longest word of up to ``_STEPS`` bytes, over the words that
    are still that long; longer words are summed in runs of bytes, whatever their length.
    """
    out = lengths.astype(np.uint64)
    long = np.flatnonzero(lengths > _STEPS)
    open_words = np.flatnonzero(lengths <= _STEPS) if len(long) else np.arange(len(starts))
    step = 0
    while len(open_words):
        if step:
            open_words = open_words[lengths[open_words] > step]
        at = starts[open_words] + step
        out[open_words] = out[open_words] * _MULTIPLIER + data[at] + np.uint64(1)
        step += 1
    if len(long):
        out[long] = _long_words(data, starts[long], lengths[long])
    return mix(out)


def _powers(factor: np.uint64, count: int) -> np.ndarray:
    """The powers 0 to ``count`` - 1 of a factor, as 64-bit numbers that wrap around."""
    out = np.full(count, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _long_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the steps of ``hashes`` come to, out of sums over runs of ``_RUN`` bytes that are
    counted from the end of each word."""
    small = _powers(_MULTIPLIER, _RUN)
    large = _powers(small[-1] * _MULTIPLIER, int(lengths.max()) // _RUN + 1)
    runs = -(-lengths // _RUN)
    first = np.cumsum(runs) - runs
    nth = np.arange(int(runs.sum())) - np.repeat(first, runs)
    ends = np.repeat(starts + lengths, runs) - nth * _RUN
    begins = np.maximum(np.repeat(starts, runs), ends - _RUN)
    sizes = ends - begins
    sums = np.empty(len(sizes), np.uint64)
    together = max(1, _TOGETHER_BYTES // _RUN)
    for s in range(0, len(sizes), together):
        own = sizes[s : s + together]
        before = np.cumsum(own) - own
        at = np.arange(int(own.sum())) + np.repeat(begins[s : s + together] - before, own)
        power = np.repeat(ends[s : s + together] - 1, own) - at
        sums[s : s + together] = np.add.reduceat((data[at] + np.uint64(1)) * small[power], before)
    whole = np.add.reduceat(sums * large[nth], first)
    return lengths.astype(np.uint64) * large[lengths // _RUN] * small[lengths % _RUN] + whole


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay within a text, and the place of
    each run's first word."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - width + 1
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        joined = joined * _MULTIPLIER + words[k : k + n]
    inside = np.ones(n, bool)
    for k in range(1, width):  # a run is cut where a text begins after its first word
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return mix(joined[inside]), np.flatnonzero(inside)
