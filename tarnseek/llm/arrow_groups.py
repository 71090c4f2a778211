"""Rows of sorted partitions as Arrow slices of one group each, whole numbers kept as they are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows, but the first, whose keys (whole numbers without nulls) differ from those of the row before."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def slices(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, slice) in the order of the rows. A group comes in several slices where it is cut by a batch or longer than ``rows``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, *changes(batch, keys).tolist(), batch.num_rows]
        for first, end in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[first].as_py() for k in keys)
            for at in range(first, end, rows):
                yield key, batch.slice(at, min(rows, end - at))


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most about ``most`` bytes of a text or binary column; a longer one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
