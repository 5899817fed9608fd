"""What both substring operators share: document keys, exact copies, and hit lists per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import numbered
from . import arrays as A
from . import exchange as X
from .session import cut, shuffle_partitions, text_rows

EXCHANGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("key", pa.binary()), ("at", pa.binary())])
EXCHANGE_DDL = "bucket int, kind int, h binary, key binary, at binary"
HITS = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("at", pa.binary())])
HITS_DDL = "bucket int, key binary, at binary"
#: Consecutive places of one document.
RUN = np.dtype([("at", "<u4"), ("n", "<u4")])


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(key and text of every row; doc_id of every key, or None where the key is the doc_id; bits of a key below its document).

    Keys ascend with doc_id. Where ids are not unique, null ids come first and are one document, rows that share an
    id have keys that agree above the given number of bits, and equal rows share a key.
    """
    rows = text_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    if (counted["most"] or 0) <= 1 and not counted["nulls"]:
        return rows.select(F.coalesce("doc_id", F.lit(0)).alias("key"), "text"), None, 0
    rows = rows.withColumn("own", F.xxhash64("text"))
    # numbers of one id follow each other
    counted_rows = cut(numbered(rows.select("doc_id", "own").distinct(), ["doc_id", "own"], "number"))
    first = counted_rows.groupBy(F.col("doc_id").alias("id1")).agg(F.min("number").alias("first"))
    shift = int(counted["most"]).bit_length()
    key = F.shiftleft(F.col("first"), shift) + F.col("number") - F.col("first")
    ids = cut(counted_rows.join(first, counted_rows["doc_id"].eqNullSafe(first["id1"])).select("doc_id", "own", key.alias("key")))
    other = ids.select(F.col("doc_id").alias("id2"), F.col("own").alias("own2"), "key")
    joined = rows.join(other, rows["doc_id"].eqNullSafe(other["id2"]) & (rows["own"] == other["own2"]))
    return joined.select(F.coalesce("key", F.lit(0)).alias("key"), "text"), ids.select("key", "doc_id"), shift


def with_ids(results: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Results by key with their doc_id instead."""
    if ids is None:
        return results.withColumnRenamed("key", "doc_id")
    return results.join(ids, "key").select("doc_id", *results.columns[1:])


def by_key(rows: DataFrame) -> DataFrame:
    """Texts dealt by key in a fixed order. Every later pass reads this one shuffle again."""
    return rows.select("key", "text").repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key")


def copies(rows: DataFrame, shift: int = 0) -> DataFrame:
    """key of every text that equals one of a document before its own, or with shift 0 one of a key before it."""
    digest = cut(rows.select("key", F.unhex(F.sha2("text", 256)).alias("digest")).distinct())
    first = cut(digest.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("digest", "first"))
    return cut(digest.join(first, "digest").filter(F.shiftright("key", shift) > F.shiftright("first", shift)).select("key").distinct())


def entries(rows: DataFrame) -> int:
    """Bytes of all texts."""
    return int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def sent(kind: int, bucket: np.ndarray, h: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries packed by bucket; probes carry no key and no place."""
    if not len(bucket):
        return
    used, cells = X.pack(bucket, h, key, at)
    yield A.batch(EXCHANGE, used, np.full(len(used), kind, dtype=np.int32), *cells)


def anchor_rows(h: np.ndarray, key: np.ndarray, at: np.ndarray, indexed: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """One chunk's fingerprints: indexed ones ask whether they occur a second time, the others only answer."""
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    first = np.flatnonzero(new)
    single = np.diff(np.append(first, len(h))) == 1
    alone = np.zeros(len(h), dtype=bool)
    alone[order[first[single]]] = True
    # a fingerprint met twice in this chunk needs no answer from elsewhere
    local, index = indexed & ~alone, indexed & alone
    probe = np.concatenate([h[alone & ~indexed], h[order[first[~single]]]])
    none = np.zeros(0, dtype="<u4")
    yield from sent(0, X.bucket_of(probe, n_buckets), probe.astype("<u4"), none, none)
    yield from sent(1, X.bucket_of(h[index], n_buckets), h[index].astype("<u4"), key[index], at[index].astype("<u4"))
    yield from sent(2, (key[local] % n_buckets).astype(np.int32), none, key[local], at[local].astype("<u4"))


def anchors(rows: pa.Table, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket: indexed entries that occur a second time, and those that were settled before."""
    kind = np.asarray(rows.column("kind"))
    index, done = rows.filter(pa.array(kind == 1)), rows.filter(pa.array(kind == 2))
    mine = X.unpack(index.column("h"), "<u4")
    key, at = X.unpack(index.column("key"), "<i8"), X.unpack(index.column("at"), "<u4")
    everything = np.sort(np.concatenate([mine, X.unpack(rows.filter(pa.array(kind == 0)).column("h"), "<u4")]))
    again = np.unique(everything[1:][everything[1:] == everything[:-1]])
    hit = np.isin(mine, again)
    yield from hit_rows(np.concatenate([key[hit], X.unpack(done.column("key"), "<i8")]), np.concatenate([at[hit], X.unpack(done.column("at"), "<u4")]), n_buckets)


def in_runs(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each run, RUN): places of a document that follow each other travel as one."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order].astype(np.int64)
    if not len(key):
        return key, np.zeros(0, dtype=RUN)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]))
    out = np.zeros(len(first), dtype=RUN)
    out["at"], out["n"] = at[first], np.diff(np.append(first, len(at)))
    return key[first], out


def with_done(done: pa.Table, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the places found, together with the runs that were settled before."""
    key, runs = in_runs(key, at)
    return np.concatenate([key, X.unpack(done.column("key"), "<i8")]), np.concatenate([runs, X.unpack(done.column("at"), RUN)])


def hit_rows(key: np.ndarray, at: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Hits (places, runs or records) packed by their documents' buckets, for gathered()."""
    if len(key):
        used, cells = X.pack((A.mix(key.view("<u8")) % np.uint64(n_buckets)).astype(np.int32), key, at)
        yield A.batch(HITS, used, *cells)


def gathered(hits: DataFrame, dtype: str | np.dtype = "<u4") -> DataFrame:
    """key, hits: all places of a document in one row. A document's places bound its size."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("hits", pa.binary())])
        key, at = X.unpack(rows.column("key"), "<i8"), X.unpack(rows.column("at"), dtype)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        edges = np.append(new, len(key))
        for a in range(0, len(new), 4096):
            yield A.batch(schema, key[new[a : a + 4096]], A.ragged(at[edges[a] : edges[min(a + 4096, len(new))]], edges[a : a + 4097] - edges[a]))

    return X.per_bucket(hits, settle, "key long, hits binary")


def places(column: pa.Array, dtype: str | np.dtype = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """(places, row of each) of a batch's gathered hits; null rows have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    found = X.unpack(column, dtype)
    rows = np.repeat(np.arange(len(column)), X.lengths(column, found.dtype.itemsize))
    if found.dtype == RUN:
        n = found["n"].astype(np.int64)
        return A.covered_runs(found["at"], n), np.repeat(rows, n)
    return found.astype(np.int64) if found.dtype.names is None else found, rows
