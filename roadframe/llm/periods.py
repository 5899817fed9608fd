"""Periodic runs of words, by internal pattern matching.

A run of period q, b <= q < 2b for a power of two b, that holds at least four periods contains one of the text's
dyadic blocks of b words so early that the block occurs again q words later, still inside the run. So each
block asks for its occurrences that start b to 2b - 1 words after it. Suffixes are sorted by prefix doubling, whose ranks
tell the range of suffixes that begin with a block; a wavelet tree over the suffix array answers which place of that
range comes next after a given one. Up to two occurrences are candidates by their distances. Three or more form a
progression, whose difference d is the block's own period: then both ends of the stretch of period d around the
block, moved to the ends of the stretch around the occurrences, give the candidates. A candidate is extended to both sides
with the ranks, and of equal stretches the one with the smallest period is a run.

All texts of a chunk are searched together in NumPy arrays; suffixes end with their text. Work and memory are about n log n for
the words of a chunk, and a text is never cut, so the longest text must fit a task.

Defined results: null and empty texts have no words and no run; repeated rows give one row each; a row without a doc_id is taken
as it stands; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .licenses import word_array
from .session import text_rows

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
CHUNK_BYTES = 1 << 18

RUNS_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
SPANS_DDL = "doc_id long, start long, length long, period long"
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Suffixes:
    """Suffixes of the texts of a chunk, each ending with its text, and the ranks of all their heads of 2^k words.

    ranks[k][i] is the place in the suffix array where the suffixes with the 2^k words at i begin; equal ranks mean equal
    words of one text. A head that is cut by the end of its text equals no other.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = self.n = len(ids)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = first[1:][doc]
        key = doc * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        self.order = order
        rank = self._ranked(key[order], np.arange(n), order, np.full(n + 1, -1, dtype=np.int64))
        self.ranks = [rank]
        while True:
            b = 1 << (len(self.ranks) - 1)
            slots = np.flatnonzero(self._shared(rank[order]))
            if not len(slots):
                break
            at = order[slots]
            follow = np.where(at + b < end[at], rank[np.minimum(at + b, n)], -1)
            key = rank[at] * (n + 1) + follow + 1
            by = np.argsort(key, kind="stable")
            order[slots] = at[by]
            rank = self._ranked(key[by], slots, at[by], rank.copy())
            self.ranks.append(rank)

    @staticmethod
    def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
        same = np.append(sorted_ranks[1:] == sorted_ranks[:-1], False)
        return same | np.append(False, same[:-1])

    @staticmethod
    def _ranked(sorted_keys: np.ndarray, slots: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        new = np.ones(len(sorted_keys), dtype=bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        return rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, i < j."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            out += np.where(rank[i + out] == rank[j + out], 1 << k, 0)
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree up to and with i and j, i < j."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, b = self.ranks[k], 1 << k
            x = i - out - b + 1
            fits = x >= 0
            x = np.where(fits, x, 0)
            out += np.where(fits & (rank[x] == rank[x + j - i]), b, 0)
        return out


class WaveletTree:
    """For ranges of an array of distinct numbers: the smallest number of a range that is not below a bound."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.append(0, np.cumsum(zero)))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of each range lie below its bound."""
        out = np.zeros(len(low), dtype=np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[low], zeros[high]
            one = (bound >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return out

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest number of each range, from 0."""
        out = np.zeros(len(low), dtype=np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            out += np.where(one, 1 << bit, 0)
            n = np.where(one, n - (b - a), n)
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return out

    def successors(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, many: int) -> list[np.ndarray]:
        """The first numbers of each range that are not below its bound, ascending; -1 where there are no more."""
        n = self.below(low, high, bound)
        out = []
        for k in range(many):
            there = n + k < high - low
            found = np.full(len(low), -1, dtype=np.int64)
            found[there] = self.nth(low[there], high[there], n[there] + k)
            out.append(found)
        return out


def _candidates(suffixes: Suffixes, tree: WaveletTree, k: int, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, periods between 2^k and 2^(k+1) - 1 that runs around them may have)."""
    b = 1 << k
    found = tree.successors(low, high, x + b, 1 if k == 0 else 3)
    near = [(o >= 0) & (o < x + 2 * b) for o in found]
    many = near[2] if k else np.zeros(len(x), dtype=bool)
    blocks = [x[near[0] & ~many]]
    periods = [(found[0] - x)[near[0] & ~many]]
    if k:
        two = near[1] & ~many
        blocks.append(x[two])
        periods.append((found[1] - x)[two])
        if many.any():
            y, o, d = x[many], found[0][many], (found[1] - found[0])[many]
            ahead = o + d + suffixes.ahead(o, o + d) - (y + d + suffixes.ahead(y, y + d))
            behind = _back(suffixes, y, d) - _back(suffixes, o, d) + o - y
            for q in (ahead, behind):
                fits = (q >= b) & (q < 2 * b)
                blocks.append(y[fits])
                periods.append(q[fits])
    return np.concatenate(blocks), np.concatenate(periods)


def _back(suffixes: Suffixes, x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Words before x that go on with its period d."""
    out = np.zeros(len(x), dtype=np.int64)
    inner = x > 0
    out[inner] = suffixes.behind(x[inner] - 1, x[inner] - 1 + d[inner])
    return out


def runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts ids[first[d]:first[d + 1]], by start, then period."""
    none = np.zeros(0, dtype=np.int64)
    suffixes = Suffixes(ids, first)
    tree, found = None, []
    sizes = np.diff(first)
    for k, rank in enumerate(suffixes.ranks):
        b = 1 << k
        fit = np.where(sizes >= max(LEAST_WORDS, LEAST_PERIODS * b), sizes // b, 0)
        if not fit.any():
            break
        m = np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit)
        x = np.repeat(first[:-1], fit) + m * b
        # a run's first block occurs at three places in it, a single word at six
        size = np.bincount(rank[:-1], minlength=suffixes.n)
        x = x[size[rank[x]] >= (LEAST_WORDS if k == 0 else LEAST_PERIODS - 1)]
        if not len(x):
            continue
        tree = tree or WaveletTree(suffixes.order)
        x, q = _candidates(suffixes, tree, k, x, rank[x], rank[x] + size[rank[x]])
        start = x - _back(suffixes, x, q)
        end = x + q + suffixes.ahead(x, x + q)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.stack([start[long], end[long], q[long]]))
    start, end, q = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def planted(doc_ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """Which original word stands at each place: one document in ten repeats a stretch of its own words to its end."""
    src = np.arange(first[-1])
    for d, doc_id in enumerate(doc_ids):
        n = int(first[d + 1] - first[d])
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            src[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return src


def _found(b: pa.RecordBatch, plant: bool) -> tuple:
    texts = A.Texts.of(b.column("text"))
    words = A.Words(texts, A.NOT_SPACE)
    ids = np.asarray(word_array(texts, words).dictionary_encode().indices, dtype=np.int64)
    src = planted(b.column("doc_id").to_pylist(), words.first) if plant else np.arange(words.n)
    start, length, q = runs(ids[src], words.first)
    return texts, words, src, start, length, q


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in A.chunks(batches, limit=CHUNK_BYTES):
        _, words, _, start, length, q = _found(b, plant=False)
        doc = words.doc[start]
        yield A.batch(_SPANS, b.column("doc_id").take(pa.array(doc)), start - words.first[doc], length, q)


def _digests(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for b in A.chunks(batches, limit=CHUNK_BYTES):
        texts, words, src, start, length, q = _found(b, plant)
        gone = A.covered(start + q, length - q, words.n)
        raw = texts.buf.tobytes()
        ranges = np.searchsorted(start, words.first)
        cells: dict[str, list] = {f.name: [] for f in _RUNS}
        for d, doc_id in enumerate(b.column("doc_id").to_pylist()):
            low, high, base = ranges[d], ranges[d + 1], int(words.first[d])
            own = slice(base, int(words.first[d + 1]))
            listed = [(s - base, n, p) for s, n, p in zip(start[low:high].tolist(), length[low:high].tolist(), q[low:high].tolist(), strict=True)]
            best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else (None, None, None)
            kept = src[own][~gone[own]]
            text = b" ".join(raw[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True))
            row = (doc_id, len(listed), *best, 1000 * best[1] // best[2] if listed else None, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in listed).encode()).hexdigest() if listed else nothing, hashlib.sha256(text).hexdigest())
            for name, value in zip(cells, row, strict=True):
                cells[name].append(value)
        yield A.batch(_RUNS, *cells.values())


def _rows(docs: DataFrame) -> DataFrame:
    return text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start (word number), length, period of every run of every row."""
    return _rows(docs).mapInArrow(_spans, SPANS_DDL)


def run_digests(docs: DataFrame, plant: bool = False) -> DataFrame:
    """For every row the number of runs, the greatest one (by length, then smallest start and period) and digests of all runs and of the text without repeats.

    With plant, one document in ten is changed first so that it ends in a repeated stretch (see planted).
    """
    return _rows(docs).mapInArrow(lambda batches: _digests(batches, plant), RUNS_DDL)
