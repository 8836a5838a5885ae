"""Groups of rows out of sorted Arrow batches, without an object per row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column whose values all have one length, as a row of numbers per value."""
    if not len(column):
        return np.zeros((0, 0), kind)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return values.reshape(len(column), -1).view(kind)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows come sorted by ``keys``. Yields a batch of whole groups and the bounds of each.

    Only the last, still open group is held back, so memory is bounded by a batch and the
    largest group; callers keep groups small by splitting them into blocks.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = _changes(batch, keys)
        if held and _same(held[-1], batch, keys):
            if not len(changes):
                held.append(batch)
                continue
            yield from _cut([*held, batch.slice(0, changes[0])], keys)
            batch, changes = batch.slice(changes[0]), changes[1:] - changes[0]
        elif held:
            yield from _cut(held, keys)
        last = int(changes[-1]) if len(changes) else 0
        if last:
            yield from _cut([batch.slice(0, last)], keys)
        held = [batch.slice(last)]
    if held:
        yield from _cut(held, keys)


def _cut(parts: list[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    whole = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    yield whole, np.concatenate([[0], _changes(whole, keys), [whole.num_rows]]).astype(np.int64)


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    differs = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        values = numbers(batch, key)
        differs |= values[1:] != values[:-1]
    return np.flatnonzero(differs) + 1


def _same(before: pa.RecordBatch, after: pa.RecordBatch, keys: Sequence[str]) -> bool:
    return all(numbers(before, k)[-1] == numbers(after, k)[0] for k in keys)
