"""Benchmark decontamination by Wu-Manber search for item windows.

Items and documents are reduced to lower-cased words joined by one space. Patterns are the distinct
windows of WINDOW item words (an item with fewer words is one pattern). A table of block shifts tells
how far a scan may jump at each text block, blocks that end a pattern's head select a bucket of
patterns, and those are compared byte by byte. Scans of many text stretches advance in lockstep
as NumPy lanes, each by its own shift. Patterns are split into length classes, since the shortest
pattern bounds every jump.

Defined results: null or empty texts have no words; items without words are never found; repeated
items count once per item_id; repeated document rows give one row each; extra columns are ignored.
The pattern table travels to the tasks in blocks of at most BLOCK_BYTES of item text; a larger
benchmark is searched block by block and the findings are merged per document row. Each block reads the
documents once more and each task builds its tables anew, which suits benchmarks of up to about 1 GB.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .session import filtered, text_rows, written

WINDOW = 10
#: Largest item text that one search block holds.
BLOCK_BYTES = 16_000_000
LANE = 1024
#: Bytes of a pattern that the shift table looks at, at most.
HEAD_MOST = 128
_CLASSES = ((48, 10), (20, 8), (8, 4), (3, 2), (1, 1))


def normalised(texts: A.Texts) -> tuple[np.ndarray, np.ndarray, A.Words]:
    """(bytes, first byte of each word in them, words): '\\n' around documents, one space between words."""
    low = A.LOWER[texts.buf]
    words = A.Words(A.Texts(low, texts.off), A.ALNUM)
    length = words.end - words.start
    # one separator before every word, one more byte at the end
    place = np.arange(1, words.n + 1) + np.concatenate([[0], np.cumsum(length)[:-1]]) if words.n else np.zeros(0, dtype=np.int64)
    out = np.full(int(length.sum()) + words.n + 1, 0x20, dtype=np.uint8)
    src = A.covered_runs(words.start, length)
    out[A.covered_runs(place, length)] = low[src]
    opening = place[words.first[:-1][words.counts > 0]] - 1
    out[opening] = 0x0A
    out[-1] = 0x0A
    return out, place, words


def item_windows(text: str | None) -> list[bytes]:
    buf, place, words = normalised(A.Texts.of(pa.array([text], type=pa.large_string())))
    if not words.n:
        return []
    ends = place + (words.end - words.start)
    raw = buf.tobytes()
    k = min(WINDOW, words.n)
    return list(dict.fromkeys(raw[place[i] : ends[i + k - 1]] for i in range(words.n - k + 1)))


class Patterns:
    """The tables of one length class: shift by block hash, buckets of patterns by the hash of the block that ends the head."""

    BITS = 18

    def __init__(self, patterns: list[tuple[bytes, int]], block: int):
        """patterns: (bytes, pattern id). They lie one after another, each filled up to whole 64-bit words."""
        self.ids = np.array([i for _, i in patterns], dtype=np.int64)
        self.length = np.array([len(p) for p, _ in patterns], dtype=np.int64)
        self.block, self.head = block, min(int(self.length.min()), HEAD_MOST)
        self.first = np.concatenate([[0], np.cumsum((self.length + 7) // 8)])
        raw = np.zeros(8 * int(self.first[-1]) + 8, dtype=np.uint8)
        raw[A.covered_runs(8 * self.first[:-1], self.length)] = np.frombuffer(b"".join(p for p, _ in patterns), dtype=np.uint8)
        self.words = raw.view("<u8")
        slots = 1 << self.BITS
        self.shift = np.full(slots, self.head - block + 1, dtype=np.int32)
        for at in range(self.head - block + 1):
            h = self.hashes(raw, 8 * self.first[:-1] + at + block - 1)
            np.minimum.at(self.shift, h, self.head - block - at)
        order = np.argsort(h, kind="stable")
        self.bucket, self.by_slot = order, np.searchsorted(h[order], np.arange(slots + 1))

    def hashes(self, buf: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slot of the block of self.block bytes that ends at each position."""
        h = np.zeros(len(end), dtype=np.uint64)
        at, left = end - self.block + 1, self.block
        if left >= 8:
            view = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
            h += view[at] * np.uint64(0x9E3779B97F4A7C15)
            h ^= view[end - 7] * np.uint64(0xC2B2AE3D27D4EB4F)
        else:
            for j in range(left):
                h = h * np.uint64(257) + buf[at + j]
            h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def scan(self, buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, pattern numbers): exact occurrences that start and end at separators."""
        n = len(buf)
        # no pattern holds a zero byte, so none goes on beyond the text
        padded = np.concatenate([buf, np.zeros(16, dtype=np.uint8)])
        view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        pos = np.arange(self.head, max(n - 1, self.head), LANE, dtype=np.int64)
        stop = np.minimum(pos + LANE, n - 1)
        while len(pos):
            slot = self.hashes(padded, pos)
            step = self.shift[slot]
            hit = step == 0
            if hit.any():
                # a bucket is selected: all its patterns against the text that ends their head here
                s, at = slot[hit], pos[hit] - self.head + 1
                at = np.where((padded[at - 1] == 0x20) | (padded[at - 1] == 0x0A), at, -1)
                s, at = s[at >= 0], at[at >= 0]
                count = self.by_slot[s + 1] - self.by_slot[s]
                start = np.repeat(at, count)
                number = self.bucket[A.covered_runs(self.by_slot[s], count)]
                w = 0
                while len(start):
                    left = np.clip(self.length[number] - 8 * w, 0, 8)
                    mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * 8).astype(np.uint64) % np.uint64(64)) - np.uint64(1))
                    same = (view[start + 8 * w] & mask) == self.words[self.first[number] + w]
                    w += 1
                    start, number = start[same], number[same]
                    whole = self.length[number] <= 8 * w
                    if whole.any():
                        done, which = start[whole], number[whole]
                        after = padded[done + self.length[which]]
                        closed = (after == 0x20) | (after == 0x0A)
                        yield done[closed], which[closed]
                    start, number = start[~whole], number[~whole]
            pos = pos + np.maximum(step, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]


class Search:
    """All patterns of one block of items."""

    def __init__(self, items: list[tuple[str, str | None]]):
        owners: dict[bytes, list[str]] = {}
        for item, text in items:
            for p in item_windows(text):
                owners.setdefault(p, []).append(item)
        found = list(owners)
        self.items = sorted({i for own in owners.values() for i in own})
        number = {item: i for i, item in enumerate(self.items)}
        self.owner_of = [np.array(sorted({number[i] for i in owners[p]}), dtype=np.int64) for p in found]
        self.n_words = np.array([p.count(b" ") + 1 for p in found], dtype=np.int64)
        self.classes = []
        for k, (least, block) in enumerate(_CLASSES):
            most = _CLASSES[k - 1][0] if k else 1 << 60
            if own := [(p, i) for i, p in enumerate(found) if least <= len(p) < most]:
                self.classes.append(Patterns(own, block))

    def find(self, texts: A.Texts) -> tuple[A.Words, np.ndarray, np.ndarray]:
        """(words, first hit word and pattern id of every occurrence)."""
        buf, place, words = normalised(texts)
        at, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if words.n:
            for c in self.classes:
                for start, number in c.scan(buf):
                    at.append(start)
                    ids.append(c.ids[number])
        return words, np.searchsorted(place, np.concatenate(at)), np.concatenate(ids)


SCHEMA = "n_words long, n_hit long, spans array<struct<start:long,length:long>>, item_ids array<string>"


def _searched(batches: Iterator[pa.RecordBatch], items: list[tuple[str, str | None]], key: pa.Field) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([key, ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(span)), ("item_ids", pa.list_(pa.string()))])
    search = Search(items)
    for b in A.chunks(batches):
        words, at, ids = search.find(A.Texts.of(b.column("text")))
        hit = A.covered(at, search.n_words[ids], words.n)
        spans: list[list] = [[] for _ in range(b.num_rows)]
        names: list[list] = [[] for _ in range(b.num_rows)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        doc = words.doc[at]
        for start, end in zip(edge[0::2], edge[1::2], strict=True):
            # a run of hit words may touch the next document's
            while start < end:
                d = int(words.doc[start])
                to = min(int(end), int(words.first[d + 1]))
                spans[d].append({"start": int(start - words.first[d]), "length": to - int(start)})
                start = to
        for d, i in np.unique(np.stack([doc, ids]), axis=1).T if len(at) else ():
            names[d].extend(search.items[o] for o in search.owner_of[i])
        yield A.batch(schema, b.column(key.name), words.counts, A.per_doc(hit, words.first), spans, [sorted(set(x)) for x in names])


def _merged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            runs = sorted((s["start"], s["start"] + s["length"]) for s in r["spans"])
            joined: list[list[int]] = []
            for s, e in runs:
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            r["spans"] = [{"start": s, "length": e - s} for s, e in joined]
            r["n_hit"] = sum(e - s for s, e in joined)
            r["item_ids"] = sorted(set(r["item_ids"]))
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items dealt by hash into as many blocks as keep each under block_bytes of text on average."""
    rows = text_rows(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = -(-total // block_bytes) or 1
    if n == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def find_items(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans of hit words and the item_ids found, for every row of docs."""
    blocks = item_blocks(items, block_bytes)
    rows = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    if len(blocks) == 1:
        found = [(r[0], r[1]) for r in blocks[0].collect()]
        key = pa.field("doc_id", pa.int64())
        return rows.mapInArrow(lambda batches: _searched(batches, found, key), f"doc_id long, {SCHEMA}")
    keyed = written(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = None
    for block in blocks:
        found = [(r[0], r[1]) for r in block.collect()]
        key = pa.field("row", pa.int64())
        part = keyed.select("row", "text").mapInArrow(lambda batches, found=found, key=key: _searched(batches, found, key), f"row long, {SCHEMA}")
        parts = part if parts is None else parts.unionByName(part)
    together = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.sum("n_hit").alias("n_hit"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(span)), ("item_ids", pa.list_(pa.string()))])
    merged = together.mapInArrow(lambda batches: _merged(batches, schema), f"row long, {SCHEMA}")
    return keyed.select("doc_id", "row").join(merged, "row").drop("row")


def clean(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, whole and unchanged, in which no item window occurs."""
    for block in item_blocks(items, block_bytes):
        found = [(r[0], r[1]) for r in block.collect()]

        def keep(batches: Iterator[pa.RecordBatch], found: list = found) -> Iterator[pa.RecordBatch]:
            search = Search(found)
            for b in A.chunks(batches):
                words, at, _ = search.find(A.Texts.of(b.column("text")))
                free = np.ones(b.num_rows, dtype=bool)
                free[words.doc[at]] = False
                yield b.filter(pa.array(free))

        docs = filtered(docs, keep)
    return docs


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
