"""Fingerprints dealt out by hash in packed cells.

A task packs the entries of one text chunk by bucket: one row per chunk and bucket, whose cells hold
raw NumPy values. Spark shuffles and groups the rows by bucket. Entries that repeat inside a chunk
are settled there, so a fingerprint that a third of all rows share arrives once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A

#: Entries one bucket should hold on average.
BUCKET_ENTRIES = 1_000_000


def bucket_count(entries: int, floor: int) -> int:
    return max(1, floor, -(-entries // BUCKET_ENTRIES))


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def pack(bucket: np.ndarray, *cells: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """(buckets that occur, one binary column per cell array). Work follows the entries, not the number of buckets."""
    order = np.argsort(bucket, kind="stable")
    dealt = bucket[order]
    first = runs(dealt)
    edges = np.append(first, len(bucket))
    return dealt[first], [A.ragged(c[order], edges) if len(c) else A.ragged(c, np.zeros(len(first) + 1, dtype=np.int64)) for c in cells]


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """From the high bits; the low 32 bits stay free for what is compared inside the bucket."""
    return ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)


def unpack(column: pa.Array, dtype: str) -> np.ndarray:
    """The values of all cells, one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].copy().view(dtype) if data is not None and len(column) else np.zeros(0, dtype=dtype)


def lengths(column: pa.Array, itemsize: int) -> np.ndarray:
    """Values in each cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(off) // itemsize


def per_bucket(rows: DataFrame, settle: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """settle() sees all rows of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield from settle(pa.Table.from_batches(got))

    # the annotations select the iterator form
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("bucket").applyInArrow(run, schema)
