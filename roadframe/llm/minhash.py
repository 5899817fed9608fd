"""Near duplicates by MinHash with tensored banding.

Each set of word shingles gets two small collections of minhash tuples, A_1..A_m and B_1..B_m. The
m * m tables are keyed by the pairs (A_i, B_j), so m * m bands of 2 * TUPLE minhashes cost only
2 * m * TUPLE minhashes. Two sets at similarity s meet in some table with probability
(1 - (1 - s**TUPLE)**m)**2, which is 0.9999 at s = 0.8 for the values below, and rises with s.

Equal sets are one class from the start. Tables run over class representatives, and every pair that meets
under some key is settled, however many share the key:

1. A key that few share gives all their pairs. Under one that many share, the members of each part of
   GROUP_PART first meet the part's most central member (each in its CENTRAL_KEYS largest groups), then each its nearest
   one in another component, and last, under every key, all that are still in other components, so work follows the
   members that stay apart.
2. A pair is dropped before its sets are fetched only where it cannot reach the similarity: a parity bitmap of
   each set bounds the number of differing shingles from below.
3. What is left is confirmed on the full sets, nearest pairs first; pairs inside one component need no look.

Joins on a central member have one hot side; they read Spark's splitting of skewed joins. Components come
from operators.components.

Defined results: texts without words have an empty set and stay alone; rows that share a doc_id are
one document; a null doc_id stays alone; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import star_forest
from . import arrays as A
from . import exchange as X
from .session import cut, shuffle_partitions, text_rows, tidy, written

SHINGLE, PERCENT = 5, 80
#: Hash collections: TABLES tuples of TUPLE minhashes in each of the two.
TABLES, TUPLE = 10, 2
#: Bits of the parity bitmap of a set.
BITS = 1024
#: Table keys with up to this many members pair them all at once; those of larger ones meet part by part.
SMALL_GROUP = 8
#: Members of a large group that a task holds against as many others.
GROUP_PART = 4096
#: Of a row's large groups, the largest ones in which it meets the central member; later rounds take all of its groups.
CENTRAL_KEYS = 4
#: Parts in which the rows of one table key meet what is known of the key.
SALTS = 32
#: Representatives for each task that holds a table of the confirming rounds.
ROUND_ROWS = 5_000


def shingle_sets(texts: A.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, document) of the distinct shingles, by document."""
    low = A.Texts(A.LOWER[texts.buf], texts.off)
    words = A.Words(low, A.NOT_SPACE)
    h = A.prints(low, words.start, words.end)
    at, keys = A.windows(h, words.doc, k)
    doc = words.doc[at]
    counts = words.counts
    for d in np.flatnonzero((counts > 0) & (counts < k)) if k > 1 else ():
        whole = np.uint64(int(counts[d]))
        for x in h[words.first[d] : words.first[d + 1]]:
            whole = A.mix(np.array([whole * np.uint64(31) + x]))[0]
        keys, doc = np.append(keys, whole), np.append(doc, d)
    # the two orders differ only where short documents were appended
    order = np.argsort(keys ^ A.mix(doc.astype(np.uint64)), kind="stable")
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    order = np.argsort(doc, kind="stable")
    return keys[order], doc[order]


_SALTS = np.random.default_rng(11).integers(1, 2**63, 2 * TABLES * TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[documents with shingles, 2 * TABLES] minhash tuples."""
    out = np.zeros((len(first), 2 * TABLES), dtype=np.uint64)
    for i, salt in enumerate(_SALTS):
        x = keys * salt
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        out[:, i // TUPLE] = out[:, i // TUPLE] * np.uint64(0x5851F42D4C957F2D) + np.minimum.reduceat(x, first)
    return A.mix(out.reshape(-1)).reshape(out.shape)


def parities(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """[n, BITS / 8] bitmaps: bit i says whether an odd number of the set's shingles hash to i.

    Two bitmaps differ in at most as many bits as the sets differ in shingles.
    """
    out = np.zeros((n, BITS // 8), dtype=np.uint8)
    slot = (A.mix(keys ^ np.uint64(0x5DEECE66D)) % np.uint64(BITS)).astype(np.int64)
    for at in range(0, n, 1024):
        own = slice(*np.searchsorted(doc, [at, at + 1024]))
        size = min(1024, n - at)
        odd = np.bincount((doc[own] - at) * BITS + slot[own], minlength=size * BITS) & 1
        out[at : at + size] = np.packbits(odd.astype(bool).reshape(size, BITS), axis=1)
    return out


def _signed(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in A.chunks(batches):
        keys, doc = shingle_sets(A.Texts.of(b.column("text")), k)
        size = np.bincount(doc, minlength=b.num_rows)
        has = np.flatnonzero(size)
        first = np.concatenate([[0], np.cumsum(size)])[has]
        one = np.zeros(b.num_rows, dtype=np.uint64)
        two = np.zeros(b.num_rows, dtype=np.uint64)
        values = np.zeros((0, 2 * TABLES), dtype=np.uint64)
        if len(has):
            one[has] = np.add.reduceat(A.mix(keys ^ np.uint64(0x1234567)), first)
            two[has] = np.add.reduceat(A.mix(keys * np.uint64(0x2545F4914F6CDD1D)), first)
            values = signature(keys, first)
        filled = np.concatenate([[0], np.cumsum(size > 0)])
        bits = parities(keys, np.searchsorted(has, doc), len(has))
        yield A.batch(schema, b.column("doc_id"), size, one.view(np.int64), two.view(np.int64), A.ragged(values.reshape(-1), filled * 2 * TABLES), A.ragged(bits.reshape(-1), filled * (BITS // 8)))


def signed(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, an order-free 128-bit fingerprint of the set, the minhash tuples and the parity bitmap."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sig", pa.binary()), ("bits", pa.binary())])
    rows = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidy(lambda batches: _signed(batches, k, schema)), "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bits binary")


def _grouped(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and id; size of the group of each entry in it, and the entry's place there)."""
    order = np.lexsort((ids, key))
    first = X.runs(key[order])
    size = np.diff(np.append(first, len(key)))
    return order, np.repeat(size, size), np.arange(len(key)) - np.repeat(first, size)


def _group_pairs(ids: np.ndarray, many: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each small group, from entries in group order."""
    a, b = [ids[:0]], [ids[:0]]
    for back in range(1, SMALL_GROUP):
        at = np.flatnonzero((place >= back) & (many <= SMALL_GROUP))
        a.append(ids[at - back])
        b.append(ids[at])
    return np.concatenate(a), np.concatenate(b)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    keep = low != high
    low, high = low[keep], high[keep]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


def _table_keys(sig: np.ndarray) -> np.ndarray:
    """[rows, TABLES * TABLES] keys of the tables (A_i, B_j), i before j."""
    table = np.arange(TABLES * TABLES, dtype=np.uint64)
    key = (sig[:, :TABLES, None] + np.uint64(0x9E3779B97F4A7C15) * sig[:, None, TABLES:]).reshape(len(sig), -1)
    return A.mix((key + table * np.uint64(0xD1342543DE82EF95)).reshape(-1)).reshape(key.shape)


def candidates(reps: DataFrame, n_buckets: int) -> DataFrame:
    """(a, b, large): pairs a < b under the same table key, and where large is set, each member a of a large group with the group's number b.

    What is large depends on a key's members alone. Of a key that many rows of one chunk share, only the first few
    go to the key's bucket; the others are known to be of a large group and are dealt by their ids.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("large", pa.bool_()), ("x", pa.binary()), ("y", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                key = _table_keys(X.unpack(b.column("sig"), "<u8").reshape(b.num_rows, 2 * TABLES)).reshape(-1)
                ids = np.repeat(np.asarray(b.column("doc_id")), TABLES * TABLES)
                order, _, place = _grouped(key, ids)
                key, ids, more = key[order], ids[order], place > SMALL_GROUP
                home = X.bucket_of(key, n_buckets)
                used, cells = X.pack(home[~more], key[~more].astype("<u4"), ids[~more])
                yield A.batch(schema, used, np.zeros(len(used), dtype=bool), *cells)
                if more.any():
                    number = home[more].astype(np.int64) << 32 | key[more].astype("<u4").astype(np.int64)
                    used, cells = X.pack(X.bucket_of(A.mix(ids[more].view(np.uint64)), n_buckets), number, ids[more])
                    yield A.batch(schema, used, np.ones(len(used), dtype=bool), *cells)

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("large", pa.bool_())])
        known, open_rows = rows.filter(rows.column("large")), rows.filter(pa.compute.invert(rows.column("large")))
        key, ids = X.unpack(open_rows.column("x"), "<u4"), X.unpack(open_rows.column("y"), "<i8")
        order, many, place = _grouped(key, ids)
        key, ids = key[order], ids[order]
        a, b = _distinct(*_group_pairs(ids, many, place))
        large, n = many > SMALL_GROUP, len(a)
        number = np.int64(rows.column("bucket")[0].as_py()) << np.int64(32) | key[large].astype(np.int64)
        a = np.concatenate([a, ids[large], X.unpack(known.column("y"), "<i8")])
        b = np.concatenate([b, number, X.unpack(known.column("x"), "<i8")])
        for at in range(0, len(a), 100_000):
            to = min(len(a), at + 100_000)
            yield A.batch(schema, a[at:to], b[at:to], np.arange(at, to) >= n)

    packed = reps.select("doc_id", "sig").mapInArrow(tidy(spread), "bucket int, large boolean, x binary, y binary")
    return X.per_bucket(packed, settle, "a long, b long, large boolean")


def least_apart(bits: np.ndarray, size: np.ndarray, other_bits: np.ndarray, other_size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of differing shingles, at least; whether the pair may still reach the similarity). bits are rows of 64-bit words."""
    differ = np.maximum(np.bitwise_count(bits ^ other_bits).sum(axis=-1, dtype=np.int64), np.abs(size - other_size))
    total = size + other_size
    return differ / total, differ * (100 + percent) <= total * (100 - percent)


def _rated(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.float64())])
    for b in batches:
        left, right = (X.unpack(b.column(c), "<u8").reshape(b.num_rows, BITS // 64) for c in ("bits_a", "bits_b"))
        apart, may = least_apart(left, np.asarray(b.column("n_a")), right, np.asarray(b.column("n_b")), percent)
        yield A.batch(schema, np.asarray(b.column("a"))[may], np.asarray(b.column("b"))[may], apart[may])


def rated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart): the pairs that may reach the similarity, each once."""
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("doc_id").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    return pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(tidy(lambda batches: _rated(batches, percent)), "a long, b long, apart double")


def _central(bits: np.ndarray) -> int:
    """The row closest to what most rows have."""
    flags = np.unpackbits(bits.view(np.uint8), axis=1)
    usual = np.packbits(2 * flags.sum(axis=0, dtype=np.int64) > len(bits)).view(np.uint64)
    return int(np.bitwise_count(bits ^ usual).sum(axis=1).argmin())


def in_large_groups(large: DataFrame, reps: DataFrame, forest: DataFrame, n_buckets: int, percent: int, which: str) -> DataFrame:
    """(a, b): pairs of large table groups whose ends lie in different components and that may reach the similarity.

    which: "central" pairs each member with the most central one of its part in its largest groups, "nearest" each member outside the group's
    largest component with its nearest one in another component of each part, "all" gives all pairs. A task holds two parts.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        ids, size, key, root, main, part, low, high = (rows.column(c).to_numpy() for c in ("doc_id", "n_shingles", "key", "root", "main", "part", "low", "high"))
        bits = X.unpack(rows.column("bits"), "<u8").reshape(len(ids), BITS // 64)
        order = np.lexsort((high, low, key))
        cuts = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        for m in np.split(order, cuts):
            g_ids, g_size, g_root, g_part, g_bits = ids[m], size[m], root[m], part[m], bits[m]
            outside, crossing = g_root != main[m[0]], low[m[0]] != high[m[0]]
            for x in [_central(g_bits)] if which == "central" else np.flatnonzero(outside):
                apart, may = least_apart(g_bits, g_size, g_bits[x], g_size[x], percent)
                may &= g_root != g_root[x]
                if which == "all":
                    # a pair of two outsiders comes up twice
                    may &= ~outside | (g_ids > g_ids[x])
                if crossing:
                    may &= g_part != g_part[x]
                y = np.flatnonzero(may)
                if which == "nearest" and len(y):
                    y = y[apart[y].argmin()][None]
                if len(y):
                    yield A.batch(schema, np.minimum(g_ids[y], g_ids[x]), np.maximum(g_ids[y], g_ids[x]))

    label = forest.select(F.col("node").alias("doc_id"), "component")
    rows = large.select(F.col("a").alias("doc_id"), F.col("b").alias("key")).join(label, "doc_id", "left").select("doc_id", "key", F.coalesce("component", "doc_id").alias("root"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max(F.struct("n", "root"))["root"].alias("main"))
    parts = F.ceil(F.col("size") / GROUP_PART).cast("int")
    # a key that many share is dealt by key and salt
    salted = sizes.filter("roots > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    if which == "central":
        # copies share nearly all keys, and would meet the same member under each
        order = Window.partitionBy("doc_id").orderBy(F.desc("size"), "key")
        rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CENTRAL_KEYS).drop("place")
    others = F.array("part") if which == "central" else F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.withColumn("other", F.explode(others)).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "low", "high"), F.lit(n_buckets)).cast("int")).join(reps, "doc_id")
    return X.per_bucket(dealt.select("bucket", "doc_id", "n_shingles", "key", "root", "main", "part", "low", "high", "bits"), pairs, "a long, b long").distinct()


def _packed_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.binary())])
    for b in A.chunks(batches):
        keys, doc = shingle_sets(A.Texts.of(b.column("text")), k)
        # shingle_sets gives each document's keys in ascending order of a mixed value; sort for the merge
        order = np.lexsort((keys, doc))
        yield A.batch(schema, b.column("doc_id"), A.ragged(keys[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))])))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for b in batches:
        keep = np.zeros(b.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(b.column("set_a"), b.column("set_b"), strict=True)):
            left, right = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
            if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                continue
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(left) + len(right) - both)
        yield b.filter(pa.array(keep)).select(["a", "b"]).cast(schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(tidy(lambda batches: _confirmed(batches, percent)), "a long, b long")


def _between(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with root_a and root_b."""
    label_a, label_b = forest.select(F.col("node").alias("a"), F.col("component").alias("root_a")), forest.select(F.col("node").alias("b"), F.col("component").alias("root_b"))
    labelled = pairs.join(label_a, "a", "left").join(label_b, "b", "left")
    return labelled.withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")}).filter("root_a <> root_b")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    spark = docs.sparkSession
    rows = cut(signed(docs, k))
    by_set = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("doc_id", "sig", "bits")).alias("rep"))
    classes = cut(by_set.select("n_shingles", "set_a", "set_b", F.col("rep.doc_id").alias("rep"), F.col("rep.sig").alias("sig"), F.col("rep.bits").alias("bits")))
    # one document id may have several texts
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "sig", "bits")
    n = reps.count()
    n_buckets = X.bucket_count(n * TABLES * TABLES, shuffle_partitions(spark))
    met = cut(candidates(reps, n_buckets))
    large = met.filter("large").select("a", "b")
    near = written(rated(met.filter("NOT large").select("a", "b").distinct(), reps, percent))
    # a written table has a known size, so Spark may send it to the texts instead of dealing the texts
    wanted = written(near.select(F.col("a").alias("doc_id")).union(near.select("b")).union(large.select("a")).distinct())
    texts = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(wanted, "doc_id", "left_semi")
    sets = written(texts.mapInArrow(tidy(lambda batches: _packed_sets(batches, k)), "doc_id long, set binary"))
    tried = spark.createDataFrame([], "a long, b long")
    forest = spark.createDataFrame([], "node long, component long")
    # the rounds' tables have a few numbers for each representative
    tasks = -(-(n + 1) // ROUND_ROWS)

    def joined(found: DataFrame) -> DataFrame:
        """The components with more links: the forest and new links only, so few rounds settle them."""
        return star_forest(forest.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    def nearest_of_few() -> DataFrame:
        return near.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))).filter("n = 1").select("a", "b")

    def of_many(which: str) -> DataFrame:
        return in_large_groups(large, reps.select("doc_id", "n_shingles", "bits"), forest, n_buckets, percent, which)

    rounds = (
        lambda: nearest_of_few().unionByName(of_many("central")),
        lambda: _between(near, forest).select("a", "b").unionByName(of_many("nearest")),
        lambda: of_many("nearest"),
        lambda: of_many("all"),
    )
    for pairs in rounds:
        now = cut(pairs().distinct().join(tried, ["a", "b"], "left_anti").coalesce(tasks))
        if not now.isEmpty():
            forest = joined(confirmed(now, sets, percent))
            tried = tried.unionByName(now)
    own = classes.select("set_a", "set_b", F.col("n_shingles").alias("size"), "rep")
    member = rows.join(own, (rows["set_a"] == own["set_a"]) & (rows["set_b"] == own["set_b"]) & (rows["n_shingles"] == own["size"]) & rows["doc_id"].isNotNull(), "left").select("doc_id", "n_shingles", "rep")
    # a document id with several texts ties their classes together
    tied = member.filter("doc_id <> rep").join(reps.select("doc_id"), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = joined(tied)
    labelled = member.join(final, member["rep"] == final["node"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_each_group(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, whole and unchanged, that stand for their group of near duplicates.

    Of several rows with the kept doc_id all stay.
    """
    dropped = near_duplicates(docs, k, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))
