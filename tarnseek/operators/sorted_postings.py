"""Postings of all terms of a view, made in sorted stretches to be written.

They are those of ``build_postings``. The tokens of many rows are sorted at once by term, row and place and cut into runs,
as Arrow columns; a writer that sorts by term then merges stretches that are in order already. Still row-local, no shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

from tarnseek.operators.view import TableView

# Executors get the functions by value and don't need the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that are sorted together; a longer text alone.
TOKENS_AT_ONCE = 1 << 20


def _sizes(slots: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted_runs(batch: pa.RecordBatch, positions: bool) -> pa.RecordBatch:
    """Rows whose last column holds token slots → their postings, by term and row."""
    slots = batch.column(batch.num_columns - 1)
    words, sizes = pc.list_flatten(slots), _sizes(slots)
    row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)
    place = (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    if words.null_count:
        held = pc.is_valid(words)
        words, held = words.filter(held), held.to_numpy(zero_copy_only=False)
        row, place = row[held], place[held]
    coded = words.dictionary_encode()
    in_order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(in_order), np.int32)
    rank[in_order.to_numpy()] = np.arange(len(in_order), dtype=np.int32)
    rank = rank[coded.indices.to_numpy()]
    length = np.bincount(row, minlength=batch.num_rows)
    # Tokens come by row and place already, and stay so within a term.
    by_term = np.argsort(rank, kind="stable")
    rank, row, place = rank[by_term], row[by_term], place[by_term]
    new = np.ones(len(rank), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    ends, of = np.append(starts, len(rank)), row[starts]
    found = {name: batch.column(name).take(pa.array(of)) for name in batch.schema.names[:-1]}
    found["length"] = pa.array(length[of], pa.int32())
    found["term"] = coded.dictionary.take(in_order).take(pa.array(rank[starts]))
    found["tf"] = pa.array(np.diff(ends), pa.int32())
    if positions:
        found["positions"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
    return pa.RecordBatch.from_pydict(found)


def _cut_runs(positions: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(_sizes(batch.column(batch.num_columns - 1))), 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + TOKENS_AT_ONCE, "right")))
                yield _sorted_runs(batch.slice(at, stop - at), positions)
                at = stop

    return run


def sorted_postings(view: TableView, field: str, positions: bool = True) -> DataFrame:
    """One row per table row and distinct term: tie columns, length, term, tf[, positions]."""
    held = view.with_tokens(field)
    rows = held.df.select(*view.tie, held.token_slots(field))
    found = "length int, term string, tf int" + (", positions array<int>" if positions else "")
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(found).fields])
    return rows.mapInArrow(_cut_runs(positions), schema)
