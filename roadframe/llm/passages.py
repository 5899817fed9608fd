"""Repeated passages by fixed-block anchors.

Non-overlapping blocks of each document are the index: with blocks of (window + 1) // 2 words, every
window holds one of its document's blocks whole. Every rolling block-sized run of words probes the
index. A block that is met elsewhere is an anchor; the windows around anchors are compared by their
64-bit fingerprints, and chained windows give the maximal repeats. Documents whose whole
text equals an earlier one are settled before.

Probing compares 32 bits inside a bucket, a filter whose chance hits the second comparison removes.
Fingerprints and hits travel packed (see exchange); texts are shuffled once, by key.

Defined results: null and empty texts have no words; rows that share a doc_id are one document, whose rows take
nothing from each other; rows without an id are together a document before all others; extra columns are
ignored; an empty table gives no rows.
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
from .session import shuffle_partitions

WINDOW = 13


def _words(b: pa.RecordBatch) -> tuple[A.Texts, A.Words, np.ndarray]:
    texts = A.Texts.of(b.column("text"))
    words = A.Words(texts, A.NOT_SPACE)
    return texts, words, A.prints(texts, words.start, words.end)


def _anchor_entries(batches: Iterator[pa.RecordBatch], block: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for b in A.chunks(batches):
        _, words, h = _words(b)
        at, runs = A.windows(h, words.doc, block)
        if not len(at):
            continue
        key = np.asarray(b.column("key"))
        place = at - words.first[words.doc[at]]
        yield from S.anchor_rows(runs, key[words.doc[at]], place, place % block == 0, n_buckets)


def _window_entries(batches: Iterator[pa.RecordBatch], window: int, block: int, n_buckets: int, shift: int) -> Iterator[pa.RecordBatch]:
    for b in A.chunks(batches):
        _, words, h = _words(b)
        place, row = S.places(b.column("hits"))
        key = np.asarray(b.column("key"))
        # windows that hold the anchor block whole
        start = (place[:, None] - np.arange(window - block + 1)).reshape(-1)
        row = np.repeat(row, window - block + 1)
        inside = (start >= 0) & (start + window <= words.counts[row])
        start, row = start[inside], row[inside]
        at, runs = A.windows(h, words.doc, window)
        where = np.full(words.n, -1, dtype=np.int64)
        where[at] = np.arange(len(at))
        value = runs[where[words.first[row] + start]]
        order = np.lexsort((key[row], value))
        value, start, owner = value[order], start[order].astype("<u4"), key[row][order]
        new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, dtype=bool)
        least = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(value) else owner
        late = owner >> shift > least >> shift
        yield from S.sent(1, X.bucket_of(value[~late], n_buckets), value[~late], owner[~late], start[~late])
        mine, runs = S.in_runs(owner[late], start[late])
        yield from S.sent(2, (mine % n_buckets).astype(np.int32), np.zeros(0, dtype="<u8"), mine, runs)


def _repeats(rows: pa.Table, n_buckets: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Windows that also start in a document before their own."""
    kind = np.asarray(rows.column("kind"))
    open_rows, done = rows.filter(pa.array(kind == 1)), rows.filter(pa.array(kind == 2))
    value, key, at = X.unpack(open_rows.column("h"), "<u8"), X.unpack(open_rows.column("key"), "<i8"), X.unpack(open_rows.column("at"), "<u4")
    order = np.lexsort((key, value))
    value, key, at = value[order], key[order], at[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, dtype=bool)
    least = key[np.flatnonzero(new)][np.cumsum(new) - 1] if len(value) else key
    late = key >> shift > least >> shift
    yield from S.hit_rows(*S.with_done(done, key[late], at[late]), n_buckets)


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, A.Texts, A.Words, np.ndarray]]:
    """Each chunk with its words and which of them are removed."""
    for b in A.chunks(batches):
        texts = A.Texts.of(b.column("text"))
        words = A.Words(texts, A.NOT_SPACE)
        place, row = S.places(b.column("hits"), S.RUN)
        gone = A.covered(words.first[row] + place, window, words.n)
        copy = np.asarray(b.column("copy")) & (words.counts >= window)
        gone |= copy[words.doc]
        yield b, texts, words, gone


def _kept_texts(texts: A.Texts, words: A.Words, gone: np.ndarray) -> Iterator[bytes]:
    raw = texts.buf.tobytes()
    for d in range(texts.n):
        first, last = words.first[d], words.first[d + 1]
        if not gone[first:last].any():
            yield b" ".join(raw[texts.off[d] : texts.off[d + 1]].split())
        else:
            keep = first + np.flatnonzero(~gone[first:last])
            yield b" ".join(raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True))


OUT = "key long, n_words long, n_removed long, kept_text string"
DIGEST = "key long, n_words long, n_removed long, kept_sha256 string"


def _results(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest else "kept_text", pa.string())])
    for b, texts, words, gone in _removed(batches, window):
        kept = _kept_texts(texts, words, gone)
        yield A.batch(schema, b.column("key"), words.counts, A.per_doc(gone, words.first), [hashlib.sha256(t).hexdigest() if digest else t.decode("utf-8", "replace") for t in kept])


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (or its SHA-256) of every row of docs."""
    block = (window + 1) // 2
    rows, ids, shift = S.keyed(docs)
    n_buckets = X.bucket_count(S.entries(rows) // 6, shuffle_partitions(docs.sparkSession))
    copies = S.copies(rows, shift)
    texts = S.by_key(rows)
    known = copies.withColumn("copy", F.lit(True))
    # a left join leaves the shuffle of texts as it is; an anti join would be pushed below it
    fresh = texts.join(known, "key", "left").filter("copy IS NULL").select("key", "text")
    probed = fresh.mapInArrow(lambda batches: _anchor_entries(batches, block, n_buckets), S.EXCHANGE_DDL)
    anchors = S.gathered(X.per_bucket(probed, partial(S.anchors, n_buckets=n_buckets), S.HITS_DDL))
    around = texts.join(anchors, "key").select("key", "text", "hits")
    compared = around.mapInArrow(lambda batches: _window_entries(batches, window, block, n_buckets, shift), S.EXCHANGE_DDL)
    repeats = S.gathered(X.per_bucket(compared, partial(_repeats, n_buckets=n_buckets, shift=shift), S.HITS_DDL), S.RUN)
    marked = texts.join(repeats, "key", "left").join(known, "key", "left").select("key", "text", "hits", F.coalesce("copy", F.lit(False)).alias("copy"))
    return S.with_ids(marked.mapInArrow(lambda batches: _results(batches, window, digest), DIGEST if digest else OUT), ids)
