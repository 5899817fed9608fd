"""Texts of an Arrow batch as flat NumPy arrays: words, lines and their fingerprints.

A chunk of documents is one byte buffer plus offsets. Words are runs of bytes of a class, so
every class used here must be decidable byte by byte (UTF-8 bytes of 0x80 and above belong to
one side as a whole). Fingerprints are 64-bit polynomial sums over random byte values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Word bytes of the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    name, base = ("inv", _INVERSE) if inverse else ("pow", _BASE)
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits are both usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """Documents of one chunk: buf holds their bytes, document d is buf[off[d]:off[d + 1]]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Null texts count as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        return cls(raw[off[0] : off[-1]], off - off[0])

    def bytes_of(self, d: int) -> bytes:
        return self.buf[self.off[d] : self.off[d + 1]].tobytes()

    def sums(self, seed: int = 7) -> np.ndarray:
        """Prefix sums of value * base**position; segment() turns them into fingerprints."""
        out = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum(_byte_values(seed)[self.buf] * powers(len(self.buf)), out=out[1:])
        return out


def segment(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of each byte segment [start, end); equal bytes give equal values anywhere."""
    h = (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]
    return mix(h + (end - start).astype(np.uint64))


#: Longer strings are fingerprinted by a keyless hash function: sums modulo 2**64 have built collisions among them.
SUM_BYTES = 128


def prints(texts: Texts, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of strings of any length in a chunk."""
    out = segment(texts.sums() if sums is None else sums, start, end)
    for i in np.flatnonzero(end - start > SUM_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(texts.buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a chunk, in order: byte range [start, end), document doc; first[d] is the first word of document d."""

    def __init__(self, texts: Texts, is_word: np.ndarray):
        inside = np.zeros(len(texts.buf) + 2, dtype=bool)
        inside[1:-1] = is_word[texts.buf]
        edge = inside[1:] != inside[:-1]
        # a document's end also ends its last word, and its start begins a new one
        cuts = texts.off[1:-1]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        if len(cuts):
            self.start = np.sort(np.concatenate([self.start, cuts]))
            self.end = np.sort(np.concatenate([self.end, cuts]))
        self.first = np.searchsorted(self.start, texts.off)
        self.doc = np.repeat(np.arange(texts.n), np.diff(self.first))
        self.n = len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all runs of k words inside one document, and their fingerprints."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(out[at])


def covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n items lie in any of the ranges [start, start + length)."""
    diff = np.zeros(n + 1, dtype=np.int32)
    np.add.at(diff, start, 1)
    np.add.at(diff, start + length, -1)
    return np.cumsum(diff[:-1]) > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags over each document's items."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about limit bytes of text; one document is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def compact(column: pa.Array) -> pa.Array:
    """A copy that starts at the start of its buffers, for kernels that misread others: ascii_lower of pyarrow 23 does so with large strings cast from a slice."""
    return column.take(pa.array(np.arange(len(column))))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary cells: cell i holds the raw bytes of values[bounds[i]:bounds[i + 1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, dtype=np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


import pyarrow.compute  # noqa: E402,F401  pa.compute above


def covered_runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + length), one range after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(length)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(start, dtype=np.int64) - (ends - length), length)
