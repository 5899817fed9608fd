"""Repeated byte strings by prefix doubling over sampled suffixes.

A suffix array of every byte position would sort hundreds of times the input, so ranks are kept only
where they can still decide something:

1. Positions are sampled by their content: of each run of window - HEAD + 1 positions the one whose
   HEAD bytes have the least fingerprint. Every window of WINDOW bytes holds such a position, and equal
   windows hold it at the same place. Ranks of HEAD bytes that are unique drop out.
2. The windows that start with their own sample are ranked by prefix doubling: each round Spark sorts the
   distinct pairs (rank so far, rank of the piece that follows) at growing offsets, HEAD, 2 * HEAD and on to
   WINDOW bytes, numbers them anew and drops the unique ones. Where two of the windows left, up to WINDOW bytes
   apart, repeat one earlier text at the same distance, all windows between repeat it too.
3. What stays open, mainly the edges of repeats and their first occurrences, is compared position by
   position. Windows with one sample travel as one stretch of text, which is far smaller than their ranks.

The piece that follows a window is rarely at a sample, so its rank is a 64-bit fingerprint made from the text at
hand; step 3 compares such fingerprints of whole windows (step 1 32 bits of them, as a filter). Fingerprints of
up to WINDOW bytes are equal for unequal strings only by chance. A string that repeats inside one
chunk is settled there, and documents whose whole text equals an earlier one are settled before. Texts are
shuffled twice, by key: for the rounds of step 2 and for all that follows, which both take the samples of step 1.

Defined results: null and empty texts have no bytes; of rows that share a doc_id, equal ones share their result
and others count as documents in a fixed order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import exchange as X
from . import spans as S
from ..operators.components import numbered
from .session import cut, shuffle_partitions, written

WINDOW, HEAD = 100, 40
CHUNK = 1 << 19
PARTNER = np.dtype([("at", "<u4"), ("key", "<i8"), ("from", "<u4")])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Ranked:
    """HEAD-byte ranks of a chunk and the sample of each window."""

    def __init__(self, texts: A.Texts, window: int, head: int):
        n = len(texts.buf)
        sums = texts.sums()
        self.texts, self.window, self.head, self.sums = texts, window, head, sums
        left = np.repeat(texts.off[1:], np.diff(texts.off)) - np.arange(n)
        at = np.flatnonzero(left >= head)
        self.rank = np.full(n, _NONE, dtype=np.uint64)
        self.rank[at] = A.segment(sums, at, at + head)
        #: Whether a whole window starts at each position.
        self.valid = left >= window
        bits = np.uint64(max(n, 1).bit_length())
        low = ((self.rank >> bits) << bits) | np.arange(n, dtype=np.uint64)
        span, reach = window - head + 1, 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:]) if len(low) > reach else low[:0]
            reach *= 2
        rest = span - reach
        if rest:
            low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
        self.sample = np.zeros(n, dtype=np.int64)
        self.sample[: len(low)] = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def samples(self) -> np.ndarray:
        return np.unique(self.sample[self.valid])

    def starters(self) -> np.ndarray:
        """Windows that start with their own sample."""
        return self.valid & (self.sample == np.arange(len(self.sample)))

    def doubled(self, at: np.ndarray, length: int | None = None) -> np.ndarray:
        """Ranks of length bytes, from pairs of ranks of half as many or the longest doubling below."""
        length = self.window if length is None else length
        if length == self.head:
            return self.rank[at]
        shorter = self.head
        while 2 * shorter < length:
            shorter *= 2
        return A.mix(self.doubled(at, shorter) * np.uint64(0x9E3779B97F4A7C15) + A.mix(self.doubled(at + length - shorter, shorter)))

    def piece(self, at: np.ndarray, length: int) -> np.ndarray:
        """Ranks of length bytes, computed from the text."""
        return A.segment(self.sums, at, at + length)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.texts.off, at, side="right") - 1


def _ranked(batches: Iterator[pa.RecordBatch], window: int, head: int) -> Iterator[tuple[pa.RecordBatch, Ranked]]:
    for b in A.chunks(batches, limit=CHUNK):
        texts = A.Texts.of(b.column("text"))
        if len(texts.buf) >= window:
            yield b, Ranked(texts, window, head)


def _sample_entries(batches: Iterator[pa.RecordBatch], window: int, head: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for b, r in _ranked(batches, window, head):
        at = r.samples()
        doc = r.doc(at)
        yield from S.anchor_rows(r.rank[at], np.asarray(b.column("key"))[doc], at - r.texts.off[doc], np.ones(len(at), dtype=bool), n_buckets)


def _first_of(value: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by value, key and place; for each entry in that order the index of its value's first)."""
    order = np.lexsort((at, key, value))
    new = np.ones(len(order), dtype=bool)
    new[1:] = value[order[1:]] != value[order[:-1]]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _hit_samples(b: pa.RecordBatch, r: Ranked) -> np.ndarray:
    place, row = S.places(b.column("hits"))
    hit = np.zeros(len(r.texts.buf), dtype=bool)
    hit[r.texts.off[row] + place] = True
    return hit


#: One row for each chunk: the windows that are still open, or those that the chunk itself has settled.
OPEN = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("at", pa.binary()), ("ranks", pa.binary())])
OPEN_DDL = "kind int, key binary, at binary, ranks binary"


def lengths_of(window: int, head: int) -> list[int]:
    """Lengths that the ranks cover round by round: doubling from head, and window last."""
    out = [head]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _starter_entries(batches: Iterator[pa.RecordBatch], window: int, head: int) -> Iterator[pa.RecordBatch]:
    """Windows at hit samples: the rank of their first HEAD bytes and, for each round, that of the piece which follows."""
    steps = lengths_of(window, head)
    for b, r in _ranked(batches, window, head):
        at = np.flatnonzero(r.starters() & _hit_samples(b, r))
        if not len(at):
            continue
        doc = r.doc(at)
        key, place, value = np.asarray(b.column("key"))[doc], (at - r.texts.off[doc]).astype("<u4"), r.doubled(at)
        order, first = _first_of(value, key, place)
        key, place, at = key[order], place[order], at[order]
        lead = first == np.arange(len(order))
        # the first of each string in this chunk stands for the others
        pieces = [r.rank[at[lead]], *(r.piece(at[lead] + a, z - a) for a, z in zip(steps, steps[1:], strict=False))]
        ranks = np.stack(pieces, axis=1).reshape(-1)
        known = _partners(place[~lead], key[first[~lead]], place[first[~lead]])
        cells = [(key[lead], place[lead], ranks), (key[~lead], known, ranks[:0])]
        yield A.batch(OPEN, [1, 2], *([c[i].tobytes() for c in cells] for i in range(3)))


def _ranked_rows(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("rank", pa.int64()), *((f"next{i}", pa.int64()) for i in range(rounds))])
    for b in batches:
        ranks = X.unpack(b.column("ranks"), "<i8").reshape(-1, rounds + 1)
        yield A.batch(schema, X.unpack(b.column("key"), "<i8"), X.unpack(b.column("at"), "<u4").astype(np.int64), *ranks.T)


def reranked(rows: DataFrame, following: str) -> DataFrame:
    """rows whose pair (rank, following) is not unique, with the pair's number in sorted order as their new rank, and the pair's first (key, at).

    Pairs are counted before they are dealt, and each distinct one is sorted once, so a string that a third of all
    documents hold is one row of the sort; only the join back has a hot side.
    """
    pairs = rows.groupBy("rank", following).agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("first")).filter("n > 1").drop("n")
    ranks = numbered(pairs, ["rank", following], "new").select(F.col("rank").alias("r"), F.col(following).alias("f"), "first", "new")
    again = rows.join(ranks, (F.col("rank") == F.col("r")) & (F.col(following) == F.col("f")))
    return again.withColumn("rank", F.col("new")).select(*rows.columns, "first")


def prefix_doubling(opened: DataFrame, rounds: int) -> DataFrame:
    """(key, at, first): the open windows of WINDOW bytes that occur again, with the first place of each string.

    Round by round Spark sorts the pairs of a window's rank and the rank of what follows it at growing offsets, numbers
    them anew and drops the unique ones, until the ranks cover the window.
    """
    rows = opened.mapInArrow(lambda batches: _ranked_rows(batches, rounds), "key long, at long, rank long" + "".join(f", next{i} long" for i in range(rounds)))
    for i in range(rounds):
        rows = cut(reranked(rows.drop("first"), f"next{i}").drop(f"next{i}"))
    return rows.select("key", "at", "first")


def _partners(at: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=PARTNER)
    out["at"], out["key"], out["from"] = at, key, start
    return out


def _open_and_done(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    kind = np.asarray(rows.column("kind"))
    return rows.filter(pa.array(kind == 1)), rows.filter(pa.array(kind == 2))


def _partner_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows after the first of their string, with that first, from (key, at, key0, at0)."""
    for b in batches:
        key, at, key0, at0 = (np.asarray(b.column(c)) for c in ("key", "at", "key0", "at0"))
        yield from S.hit_rows(key, _partners(at, key0, at0), n_buckets)


def _known_partners(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from S.hit_rows(X.unpack(b.column("key"), "<i8"), X.unpack(b.column("at"), PARTNER), n_buckets)


def _known_repeats(b: pa.RecordBatch, r_off: np.ndarray, n: int, window: int) -> np.ndarray:
    """Windows of a chunk that step 2 has shown to repeat an earlier text."""
    found, row = S.places(b.column("partners"), PARTNER)
    at = found["at"].astype(np.int64) + r_off[row]
    order = np.argsort(at, kind="stable")
    at, row, key, start = at[order], row[order], found["key"][order], found["from"][order].astype(np.int64)
    step = np.diff(at)
    chained = (np.diff(row) == 0) & (step <= window) & (np.diff(key) == 0) & (np.diff(start) == step)
    length = np.ones(len(at), dtype=np.int64)
    length[:-1][chained] = step[chained]
    return A.covered(at, length, n) if len(at) else np.zeros(n, dtype=bool)


STRETCH = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("text", pa.binary())])
STRETCH_DDL = "bucket int, kind int, key binary, at binary, n binary, text binary"


def _window_entries(batches: Iterator[pa.RecordBatch], window: int, head: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Open windows as stretches of text: those that share a sample go to its bucket together, since equal windows have equal samples."""
    for b, r in _ranked(batches, window, head):
        hit = _hit_samples(b, r)
        still = r.valid & hit[r.sample] & ~(r.starters()) & ~_known_repeats(b, r.texts.off, len(r.valid), window)
        at = np.flatnonzero(still)
        doc = r.doc(at)
        keys = np.asarray(b.column("key"))
        key, place, value = keys[doc], (at - r.texts.off[doc]).astype("<u4"), r.doubled(at)
        order, first = _first_of(value, key, place)
        late = np.zeros(len(order), dtype=bool)
        late[order] = first != np.arange(len(order))
        mine, runs = S.in_runs(key[late], place[late])
        used, cells = X.pack((mine % n_buckets).astype(np.int32), mine, runs)
        none = pa.array([b""] * len(used), type=pa.binary())
        yield A.batch(STRETCH, used, np.full(len(used), 2, dtype=np.int32), *cells, none, none)
        at = at[~late]
        if not len(at):
            continue
        sample = r.sample[at]
        new = np.concatenate([[True], sample[1:] != sample[:-1]])
        low, high = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
        doc = r.doc(low)
        bucket = X.bucket_of(r.rank[sample[new]], n_buckets)
        order = np.argsort(bucket, kind="stable")
        low, n, doc, bucket = low[order], (high - low + 1)[order], doc[order], bucket[order]
        first_of = X.runs(bucket)
        used, edges = bucket[first_of], np.append(first_of, len(low))
        size = n + window - 1
        ends = np.concatenate([[0], np.cumsum(size)])
        text = A.ragged(r.texts.buf[A.covered_runs(low, size)], ends[edges])
        yield A.batch(STRETCH, used, np.ones(len(used), dtype=np.int32), A.ragged(keys[doc], edges), A.ragged((low - r.texts.off[doc]).astype("<u4"), edges), A.ragged(n.astype("<u4"), edges), text)


def _windows(rows: pa.Table, window: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Every window of the stretches of one bucket that also starts earlier."""
    todo, done = _open_and_done(rows)
    key, at, n = (X.unpack(todo.column(c), t) for c, t in (("key", "<i8"), ("at", "<u4"), ("n", "<u4")))
    n, text = n.astype(np.int64), X.unpack(todo.column("text"), "u1")
    ends = np.concatenate([[0], np.cumsum(n + window - 1)])
    values, i = [np.zeros(0, dtype=np.uint64)], 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
        part = A.Texts(text[ends[i] : ends[j]], np.array([0, ends[j] - ends[i]]))
        start = A.covered_runs(ends[i:j] - ends[i], n[i:j])
        values.append(A.segment(part.sums(), start, start + window))
        i = j
    key, at = np.repeat(key, n), A.covered_runs(at.astype(np.int64), n).astype("<u4")
    order, first = _first_of(np.concatenate(values), key, at)
    late = order[first != np.arange(len(order))]
    yield from S.hit_rows(*S.with_done(done, key[late], at[late]), n_buckets)


OUT = "key long, n_bytes long, n_removed long, n_spans long, kept_text string"
DIGEST = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _results(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256" if digest else "kept_text", pa.string())])
    for b in A.chunks(batches, limit=CHUNK):
        texts = A.Texts.of(b.column("text"))
        n, size = len(texts.buf), np.diff(texts.off)
        start = _known_repeats(b, texts.off, n, window)
        place, row = S.places(b.column("hits"), S.RUN)
        start[texts.off[row] + place] = True
        gone = A.covered(np.flatnonzero(start), window, n)
        gone |= np.repeat(np.asarray(b.column("copy")) & (size >= window), size)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        # a run that goes on into the next document starts anew there
        begins[texts.off[:-1][size > 0]] = gone[texts.off[:-1][size > 0]]
        kept = []
        for d in range(texts.n):
            own = texts.buf[texts.off[d] : texts.off[d + 1]]
            raw = own[~gone[texts.off[d] : texts.off[d + 1]]].tobytes()
            kept.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8", "replace"))
        yield A.batch(schema, b.column("key"), size, A.per_doc(gone, texts.off), A.per_doc(begins, texts.off), kept)


def remove_repeats(docs: DataFrame, window: int = WINDOW, head: int = HEAD, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept text (or its SHA-256) of every row of docs.

    A cut inside a character leaves bytes that kept_text shows as U+FFFD; kept_sha256 is of the bytes.
    """
    rows, ids, _ = S.keyed(docs)
    if ids is not None:
        # equal rows of one id have one key: one of them is looked at, and its result counts for all
        repeated = cut(rows.groupBy("key").agg(F.count("*").alias("rows")))
        rows = rows.dropDuplicates(["key"])
    n_buckets = X.bucket_count(S.entries(rows) // 12, shuffle_partitions(docs.sparkSession))
    copies = S.copies(rows)
    texts = S.by_key(rows)
    known = copies.withColumn("copy", F.lit(True))
    # a left join leaves the shuffle of texts as it is; an anti join would be pushed below it
    fresh = texts.join(known, "key", "left").filter("copy IS NULL").select("key", "text")
    sampled = fresh.mapInArrow(lambda batches: _sample_entries(batches, window, head, n_buckets), S.EXCHANGE_DDL)
    samples = S.gathered(X.per_bucket(sampled, partial(S.anchors, n_buckets=n_buckets), S.HITS_DDL))
    around = texts.join(samples, "key").select("key", "text", "hits")
    opened = written(around.mapInArrow(lambda batches: _starter_entries(batches, window, head), OPEN_DDL))
    again = prefix_doubling(opened.filter("kind = 1"), len(lengths_of(window, head)) - 1)
    later = again.select("key", "at", F.col("first.key").alias("key0"), F.col("first.at").alias("at0")).filter("key <> key0 OR at <> at0")
    found = later.mapInArrow(lambda batches: _partner_rows(batches, n_buckets), S.HITS_DDL)
    known_here = opened.filter("kind = 2").mapInArrow(lambda batches: _known_partners(batches, n_buckets), S.HITS_DDL)
    partners = S.gathered(found.unionByName(known_here), PARTNER).withColumnRenamed("hits", "partners")
    still = texts.join(samples, "key").join(partners, "key", "left").select("key", "text", "hits", "partners")
    compared = still.mapInArrow(lambda batches: _window_entries(batches, window, head, n_buckets), STRETCH_DDL)
    repeats = S.gathered(X.per_bucket(compared, partial(_windows, window=window, n_buckets=n_buckets), S.HITS_DDL), S.RUN)
    marked = texts.join(repeats, "key", "left").join(partners, "key", "left").join(known, "key", "left").select("key", "text", "hits", "partners", F.coalesce("copy", F.lit(False)).alias("copy"))
    found = marked.mapInArrow(lambda batches: _results(batches, window, digest), DIGEST if digest else OUT)
    if ids is not None:
        found = found.join(repeated, "key").withColumn("rows", F.explode(F.sequence(F.lit(1), "rows"))).drop("rows")
    return S.with_ids(found, ids)
