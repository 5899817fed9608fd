"""Packing by cutting-stock column generation.

Documents are tokenized once into pieces: full sequences, and a remainder each. The remainders'
length histogram, in classes of UNIT tokens, is the demand of a cutting-stock problem. A revised
simplex solves its linear program; a knapsack dynamic program prices new columns until the bound on
the optimum is within TOLERANCE. Patterns are rounded down, and what they leave over, at most a few
thousand pieces however large the input, is packed best-fit decreasing into further patterns.
Remainders are ranked within their class by a distributed count and take the slots of their rank.

Defined results: null text counts as empty and gives the end id alone; an empty table gives no
rows; repeated rows are packed each; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import numbered
from . import arrays as A
from .session import cut, shuffle_partitions, text_rows, tidy, written

CAPACITY, END_ID, PAD_ID = 4096, 2, 0
#: Width of a length class in tokens, and the accepted distance of the linear program from its optimum.
UNIT, TOLERANCE = 16, 1e-3
#: Pieces and tokens after which a block of best-fit packing is closed; both bound what a task holds.
BLOCK_PIECES, BLOCK_TOKENS = 50_000, 4_000_000
#: Matrix rows handed on at once.
MATRIX_ROWS = 256
#: Words of one generation whose ids a task remembers; two generations are kept.
REMEMBERED = 400_000
#: ASCII characters that are neither letters, digits nor blanks.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters end here; words that end in other characters are learned with their punctuation.
LATIN_END = 0x250
#: First bytes of the combining marks U+0300 to U+036F in UTF-8.
MARKS = b"\xcc", b"\xcd"
#: A control character that is one token of its own.
MARK = "\x01"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    # words come once each, so the model's own memory of words would only cost time
    found.model._resize_cache(0)
    return found


def _ends_plainly(core: bytes) -> bool:
    """Whether the last character is a letter or digit that lower-casing leaves one: ASCII, or a Latin letter without a special case."""
    if core[-1] < 0x80:
        return core[-1:].isalnum()
    last = core.decode("utf-8", "replace")[-1]
    return ord(last) < LATIN_END and last.isalpha() and len(last.lower()) == 1


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit values.

    This vocabulary's pieces never cross white space and ignore the case of ASCII letters, so the ids of a text are
    those of its blank-separated words. Texts that may hold a special token's string are encoded whole, and so are
    texts with combining marks, since composing a letter with a mark depends on the letter's case.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self.tokenizer, self.known, self.older = _tokenizer(path), {}, {}
        self.remembered = REMEMBERED if remembered is None else remembered
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: list[bytes]) -> None:
        """Ids of new words, from short texts in which a control character parts the words.

        Punctuation after a letter or digit is a token run of its own, so a word is learned without it.
        """
        if len(self.known) + len(words) > self.remembered:
            self.known, self.older = {}, self.known
        split = {w: w.rstrip(PUNCTUATION) for w in words}
        for w, core in split.items():
            if len(core) == len(w) or not core or not _ends_plainly(core):
                split[w] = w
        parts = {core for w, core in split.items()} | {w[len(core) :] for w, core in split.items() if core is not w}
        self._learn([p for p in parts if p not in self.known])
        known = self.known
        known.update({w: known[core] + known[w[len(core) :]] for w, core in split.items() if core is not w})

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if b"\x01" not in w]
        groups = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        texts = [b" \x01 ".join(g).decode("utf-8", "replace") for g in groups]
        for at in range(0, len(texts), 16):
            for group, e in zip(groups[at : at + 16], self.tokenizer.encode_batch_fast(texts[at : at + 16], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark[0]).tolist()
                raw = ids.tobytes()
                self.known.update({w: raw[4 * a : 4 * b] for w, a, b in zip(group, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)})
        for w in words:
            if b"\x01" in w:
                self.known[w] = self.encode(w.decode("utf-8", "replace")).tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        get, older, out, waiting, new = self.known.get, self.older, [], [], {}
        for n, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "replace")
            if b"<|" in raw or MARKS[0] in raw or MARKS[1] in raw:
                out.append(self.encode(t).tobytes())
                continue
            words = raw.lower().split()
            parts = [get(w) for w in words]
            out.append(parts)
            if None in parts:
                waiting.append((n, words))
                for w, p in zip(words, parts, strict=True):
                    if p is None and w not in new:
                        new[w] = older.get(w)
        self.learn([w for w, p in new.items() if p is None])
        self.known.update((w, p) for w, p in new.items() if p is not None)
        get, older = self.known.get, self.older
        for n, words in waiting:
            out[n] = [p if p is not None else get(w) or older.get(w, b"") for w, p in zip(words, out[n], strict=True)]
        return [p if isinstance(p, bytes) else b"".join(p) for p in out]


@lru_cache(maxsize=1)
def _ids(path: str, remembered: int | None = None) -> Ids:
    """One memory of words for each Python worker; remembered, by default REMEMBERED, bounds it."""
    return Ids(path, remembered)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool, remembered: int | None = None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())] * with_ids)
    ids, end = _ids(path, remembered), END_ID.to_bytes(4, "little")
    for b in A.chunks(batches):
        out: list[tuple] = []
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), ids.of(b.column("text").to_pylist()), strict=True):
            raw += end
            for at in range(0, len(raw), 4 * CAPACITY):
                part = raw[at : at + 4 * CAPACITY]
                out.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, part))
        yield A.batch(schema, *list(zip(*out, strict=True))[: len(schema)])
    if remembered is not None:
        ids.known, ids.older = {}, {}


def pieces(docs: DataFrame, path: str, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """Each document's ids cut at multiples of CAPACITY: doc_id, start, length, ids_crc32, doc_tokens, and the raw ids if wanted.

    A task remembers so many words of one generation and forgets them at its end; by default a worker keeps REMEMBERED from
    task to task.
    """
    rows = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidy(lambda batches: _pieces(batches, path, with_ids, remembered)), PIECE + ", ids binary" * with_ids)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence, by dynamic programming over capacities."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        value[room] = value[room - 1]
        if n:
            got = value[room - sizes[:n]] + duals[:n]
            best = int(np.argmax(got))
            if got[best] > value[room] + 1e-12:
                value[room], last[room] = got[best], best
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            column[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(value[capacity]), column


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """matrix @ vector by plain sums: threads of a linear algebra library can hang in a driver that has forked."""
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, again without such a library."""
    m = len(matrix)
    both = np.concatenate([matrix, np.eye(m)], axis=1)
    for i in range(m):
        at = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0.0
        both -= rest[:, None] * both[i]
    return both[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used) of the relaxed cutting-stock problem. sizes ascend."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used = _times(inverse, demand)
    for step in range(1, 20 * m + 200):
        duals = inverse.sum(axis=0)
        worth, column = price(np.maximum(duals, 0.0), sizes, capacity)
        # used.sum() / worth bounds the optimum from below
        if worth <= 1.0 + tolerance:
            break
        way = _times(inverse, column)
        ahead = way > 1e-9
        ratio = np.where(ahead, used / np.where(ahead, way, 1.0), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        used = np.maximum(used - ratio[out] * way, 0.0)
        used[out] = ratio[out]
        if step % 200 == 0:
            inverse = _inverse(basis)
            used = np.maximum(_times(inverse, demand), 0.0)
    return basis, used


def best_fit(sizes: list[int], left: list[int], capacity: int) -> Counter:
    """Patterns of a best-fit-decreasing packing: sorted (class index, count) pairs -> sequences."""
    open_by_room: list[list[Counter]] = [[] for _ in range(capacity + 1)]
    for c in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for _ in range(left[c]):
            room = next((r for r in range(sizes[c], capacity) if open_by_room[r]), capacity)
            into = open_by_room[room].pop() if open_by_room[room] else Counter()
            into[c] += 1
            open_by_room[room - sizes[c]].append(into)
    return Counter(tuple(sorted(p.items())) for row in open_by_room for p in row if p)


def plan(histogram: dict[int, int], capacity: int = CAPACITY // UNIT) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each class in a sequence, number of such sequences)] for a histogram class -> count."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes])
    basis, used = column_generation(sizes, demand.astype(float), capacity)
    left, found = demand.copy(), Counter()
    for j in np.argsort(-used):
        times = int(used[j] + 1e-9)
        column = basis[:, j].astype(int)
        if times and column.any():
            # never more slots than pieces
            times = min(times, *(int(left[i] // column[i]) for i in np.flatnonzero(column)))
            if times:
                left -= times * column
                found[tuple((int(i), int(column[i])) for i in np.flatnonzero(column))] += times
    found.update(best_fit(sizes.tolist(), left.tolist(), capacity))
    return [({int(sizes[i]): k for i, k in pattern}, times) for pattern, times in sorted(found.items())]


def _placed(batches: Iterator[pa.RecordBatch], slots: tuple[np.ndarray, ...], classes: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    start, base, per = slots
    for b in batches:
        slot = classes[np.asarray(b.column("class"))] + np.asarray(b.column("rank"))
        at = np.searchsorted(start, slot, side="right") - 1
        yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in list(schema)[:-1]), pa.array(base[at] + (slot - start[at]) // per[at])], schema=schema)


def pack(cut_pieces: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset. cut_pieces is read more than once: hand in a written table."""
    spark = cut_pieces.sparkSession
    names = cut_pieces.columns
    rest = cut_pieces.filter(F.col("length") < CAPACITY).withColumn("class", F.ceil(F.col("length") / UNIT).cast("int"))
    counts = {r["class"]: r["n"] for r in rest.groupBy("class").agg(F.count("*").alias("n")).collect()}
    patterns = plan(counts)
    # slots: ranks of a class from start on lie in the sequences from base on, per at a time
    by_class: dict[int, list[tuple[int, int, int]]] = {c: [] for c in counts}
    filled, sequences = Counter(), 0
    for pattern, times in patterns:
        for c, per in pattern.items():
            by_class[c].append((filled[c], sequences, per))
            filled[c] += per * times
        sequences += times
    classes, total = np.zeros(CAPACITY // UNIT + 1, dtype=np.int64), 0
    starts, bases, pers = [], [], []
    for c in sorted(counts):
        classes[c] = total
        for s, base, per in by_class[c]:
            starts.append(total + s)
            bases.append(base)
            pers.append(per)
        total += counts[c]
    slots = tuple(np.array(x, dtype=np.int64) for x in (starts, bases, pers))
    n_sub = max(shuffle_partitions(spark), total // 1_000_000)
    rest = rest.withColumn("sub", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_sub)).cast("int"))
    sizes = rest.groupBy("class", "sub").agg(F.count("*").alias("n"))
    skip = sizes.withColumn("skip", F.sum("n").over(Window.partitionBy("class").orderBy("sub")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("class", "sub").orderBy(F.desc("length"), "doc_id", "start")) - 1
    ranked = rest.withColumn("inside", inside).join(skip, ["class", "sub"]).withColumn("rank", F.col("skip") + F.col("inside"))
    schema = pa.schema([("class", pa.int32()), ("rank", pa.int64())])
    fields = [*names, "class", "rank"]
    out = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names] + list(schema) + [("sequence_id", pa.int64())])
    ddl = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names) + ", class int, rank long, sequence_id long"
    placed = ranked.select(*fields).mapInArrow(tidy(lambda batches: _placed(batches, slots, classes, out)), ddl)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*names, "sequence_id", "offset")
    full = numbered(cut_pieces.filter(F.col("length") == CAPACITY), "doc_id", "number")
    return placed.unionByName(full.select(*names, (F.col("number") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def packed(docs: DataFrame, path: str, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """Tokenize and pack every document: one row per piece with its place, and its raw ids if wanted.

    Ids are written once and join the places at the end, so packing itself moves only numbers.
    """
    cut_pieces = pieces(docs, path, with_ids, remembered)
    if not with_ids:
        return pack(cut(cut_pieces))
    stored = written(cut_pieces.withColumn("piece", F.monotonically_increasing_id()))
    placed = pack(stored.drop("ids"))
    return placed.join(stored.select("piece", "ids"), "piece").drop("piece")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the packed ids, padded with 0 to CAPACITY unless their number is a power of two.

    placed must carry the raw ids; a sequence holds at most CAPACITY ids.
    """
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for b in batches:
            ids = []
            for parts in b.column("parts").to_pylist():
                row = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4")
                ids.append(row if len(row) & (len(row) - 1) == 0 else np.pad(row, (0, CAPACITY - len(row))))
            yield A.batch(schema, b.column("sequence_id"), b.column("n_tokens"), pa.array(ids, type=pa.list_(pa.int64())))

    return joined.mapInArrow(joined_ids, "sequence_id long, n_tokens long, ids array<long>")


class Rooms:
    """Open sequences by the room they have left: a segment tree of maxima over the rooms 0 to capacity.

    A leaf holds its room while some open sequence has just that much left, else 0. Going down to the leftmost leaf
    that reaches a length finds the tightest fit in log2(capacity) steps.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.most = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, value: int) -> None:
        most, at = self.most, self.leaves + room
        most[at] = value
        while at > 1:
            at >>= 1
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            if len(self.open[room]) == 1:
                self._set(room, room)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the open sequence with the least room of at least length, no longer open; None without one."""
        most, at = self.most, 1
        if most[1] < length:
            return None
        while at < self.leaves:
            at *= 2
            if most[at] < length:
                at += 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            self._set(room, 0)
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Pieces of each sequence, longest piece first; each goes where it leaves the least room."""
    rooms, filled = Rooms(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room, sequence = rooms.take(length) or (capacity, len(filled))
        if sequence == len(filled):
            filled.append([])
        filled[sequence].append(i)
        rooms.put(room - length, sequence)
    return filled


MATRIX = "sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


def _matrix_rows(block: list[tuple[int | None, int, bytes]], first: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    filled = best_fit_decreasing(np.array([len(raw) // 4 for _, _, raw in block], dtype=np.int64))
    for at in range(0, len(filled), MATRIX_ROWS):
        part = filled[at : at + MATRIX_ROWS]
        ids, positions = np.full((len(part), CAPACITY), PAD_ID, dtype="<u4"), np.zeros((len(part), CAPACITY), dtype="<u2")
        bounds = []
        for row, members in enumerate(part):
            ends = [0]
            for i in members:
                raw = block[i][2]
                a, n = ends[-1], len(raw) // 4
                ids[row, a : a + n] = np.frombuffer(raw, dtype="<u4")
                positions[row, a : a + n] = np.arange(n, dtype="<u2")
                ends.append(a + n)
            bounds.append(ends)
        edges = np.arange(len(part) + 1) * CAPACITY
        yield A.batch(schema, np.arange(first + at, first + at + len(part)), [e[-1] for e in bounds], A.ragged(ids.reshape(-1), edges), bounds, A.ragged(positions.reshape(-1), edges), [[block[i][0] for i in m] for m in part], [[block[i][1] for i in m] for m in part])


def _matrices(batches: Iterator[pa.RecordBatch], path: str, block_pieces: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
    ids, end = _ids(path), END_ID.to_bytes(4, "little")
    block, tokens, done = [], 0, TaskContext.get().partitionId() << 40
    for b in A.chunks(batches):
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), ids.of(b.column("text").to_pylist()), strict=True):
            raw += end
            for at in range(0, len(raw), 4 * CAPACITY):
                part = raw[at : at + 4 * CAPACITY]
                block.append((doc_id, at // 4, part))
                tokens += len(part) // 4
                if len(block) >= block_pieces or tokens >= block_tokens:
                    for out in _matrix_rows(block, done, schema):
                        done += out.num_rows
                        yield out
                    block, tokens = [], 0
    yield from _matrix_rows(block, done, schema)


def matrices(docs: DataFrame, path: str, block_pieces: int = BLOCK_PIECES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of the packed id matrix, written as Parquet under the shared folder.

    Every document's ids, with the end id, are cut at multiples of CAPACITY and nothing else; each task packs bounded
    blocks of its pieces best-fit decreasing. ids holds CAPACITY unsigned 32-bit values, padded with PAD_ID from n_tokens
    on; cu_seqlens are the bounds of the pieces, from 0 to n_tokens; position_ids are CAPACITY unsigned 16-bit values that
    start again from 0 at every piece, 0 in the padding; doc_ids and starts say which ids of which document a piece holds.
    Which pieces share a sequence depends on how the rows are dealt to tasks; the pieces do not.
    """
    rows = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return written(rows.mapInArrow(lambda batches: _matrices(batches, path, block_pieces, block_tokens), MATRIX))
