"""Source divergence audit: how far the word frequencies of a language's sources lie apart.

Tasks count terms with Arrow kernels alone (ascii_lower, split_pattern_regex, dictionary_encode, hash group_by) and
send one partial count per (language, source, term). Spark sums them and deals the kept terms into shards of one
language each; a shard is a matrix of sources by terms, whose sums of divergences over its own terms are added up
over the shards. All arithmetic is in whole numbers.

The frequency of a term with c of the N occurrences of V kept terms is p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two
frequencies lie f = floor((p - q)^2 / (p + q)) apart.

Defined results: null texts, languages and sources count as empty ones, which are groups like others; each row is a
document of its own, repeated ones too; a group without terms has the frequencies of zero counts; a language
without kept terms has divergences of 0; equal values rank by their items in UTF-8 order; further columns are
ignored; an empty table gives no rows. The size of a text is bounded by what a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .session import cut, text_rows, written

#: What stands between terms: all ASCII characters that are not letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept where so many documents of its language hold it; so many terms of a group are reported.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Frequencies are counted in parts of this, which is BASE ** 3.
SCALE, BASE = 1_000_000_000, 1000
#: Bytes of text counted at once, and partial counts that a task gathers before it sends them.
CHUNK_BYTES, GATHERED = 1 << 20, 250_000
#: Cells of a shard's matrix: at least so many, and so many times the pairs of sources that its sums give.
SHARD_CELLS, CELLS_PER_PAIR = 1 << 16, 16
#: Cells whose divergences are computed at once.
BLOCK_CELLS = 1 << 18
#: Languages up to this number are sent to all tasks; more are joined like any table.
SENT_LANGS = 100_000

PARTIAL_DDL = "lang string, source string, term string, n long, docs long"
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
FOUND_DDL = "lang string, source string, part string, item string, value long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_KEYS = ["lang", "source", "term"]


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_PARTIAL.names).combine_chunks()


def _chunk_counts(batch: pa.RecordBatch) -> pa.Table:
    """Partial counts of one chunk; the empty term stands for the documents of a group themselves."""
    lang, source = (pc.fill_null(batch.column(c), "") for c in ("lang", "source"))
    # 64-bit offsets: the pieces of a long text
    text = pc.ascii_lower(A.compact(pc.fill_null(batch.column("text"), "").cast(pa.large_string())))
    pieces = pc.split_pattern_regex(text, BETWEEN)
    doc, terms = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.greater(pc.binary_length(terms), 0)
    coded = pc.filter(terms, real).dictionary_encode()
    each = pa.table({"doc": pc.filter(doc, real), "code": coded.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    doc = each.column("doc")
    counted = pa.table({"lang": pc.take(lang, doc), "source": pc.take(source, doc), "code": each.column("code"), "n": each.column("count_all")})
    counted = counted.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    term = pc.take(coded.dictionary, counted.column("code")).cast(pa.string())
    found = pa.table([counted.column("lang"), counted.column("source"), term, counted.column("n_sum"), counted.column("n_count")], schema=_PARTIAL)
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([([], "count_all")])
    own = pa.table([groups.column("lang"), groups.column("source"), pa.repeat("", len(groups)), pa.repeat(0, len(groups)), groups.column("count_all")], schema=_PARTIAL)
    return pa.concat_tables([found, own])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents, summed as long as they stay few."""
    parts: list[pa.Table] = []
    for b in A.chunks(batches, limit=CHUNK_BYTES):
        parts.append(_chunk_counts(b))
        if sum(map(len, parts)) > GATHERED:
            parts = [_summed(parts)]
            if len(parts[0]) > GATHERED // 2:
                yield from parts.pop().to_batches(max_chunksize=1 << 16)
    if parts:
        yield from _summed(parts).to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); the row of term '' has the documents of its group."""
    rows = text_rows(docs, "lang", "source", "text").select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    # tasks have summed their rows; dealt by term, so that the next step finds all sources of a term together
    return rows.mapInArrow(_partial_counts, PARTIAL_DDL).repartition("lang", "term").groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n of the terms that at least so many documents of a language hold, and all rows of term ''."""
    held = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("held", held).filter((F.col("held") >= least_docs) | (F.col("term") == "")).select(*_KEYS, "n")


def frequency(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total < 2^63 / BASE, by long division in three digits."""
    out, rest = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), np.asarray(count, dtype=np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * BASE, total)
        out = out * BASE + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of the terms of one shard: sums of divergences of every two sources, and the top terms of every source.

    Rows without a term are the language's sources, n their occurrences; the others have the count of a term in a source.
    """
    heads, cells = rows.filter(pc.is_null(rows.column("term"))), rows.filter(pc.is_valid(rows.column("term")))
    heads = heads.sort_by("source")
    names = heads.column("source").combine_chunks()
    lang, v = rows.column("lang")[0].as_py(), heads.column("v")[0].as_py()
    total = np.asarray(heads.column("n")) + 2 * v
    n_sources = len(names)
    coded = cells.column("term").combine_chunks().dictionary_encode()
    row = np.asarray(pc.index_in(cells.column("source"), value_set=names), dtype=np.int64)
    at, n = np.asarray(coded.indices, dtype=np.int64), np.asarray(cells.column("n"))
    terms = coded.dictionary
    order = np.argsort(at, kind="stable")
    row, at, n = row[order], at[order], n[order]
    sums = np.zeros((n_sources, n_sources), dtype=np.int64)
    whole = int(total.sum()) - 2 * v * (n_sources - 1)
    best: list[pa.Table] = []
    step = max(1, BLOCK_CELLS // n_sources)
    for low in range(0, len(terms), step):
        high = min(low + step, len(terms))
        a, b = np.searchsorted(at, [low, high])
        count = np.zeros((n_sources, high - low), dtype=np.int64)
        count[row[a:b], at[a:b] - low] = n[a:b]
        p = frequency(count + 2, total[:, None])
        for i in range(n_sources - 1):
            sums[i, i + 1 :] += apart(p[i + 1 :], p[i]).sum(axis=1)
        q = frequency(count.sum(axis=0) + 2, whole)
        above = (count > 0) & (p > q)
        i, j = np.nonzero(above)
        value = apart(p[i, j], q[j])
        best = [_top(pa.concat_tables([*best, pa.table({"at": i, "item": pc.take(terms, pa.array(j + low)), "value": value})]))]
    sums += sums.T
    i, j = np.nonzero(~np.eye(n_sources, dtype=bool))
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        yield A.batch(_FOUND, pa.repeat(lang, len(x)), names.take(pa.array(x)), pa.repeat("pair", len(x)), names.take(pa.array(y)), sums[x, y])
    for t in best:
        if len(t):
            yield A.batch(_FOUND, pa.repeat(lang, len(t)), names.take(t.column("at").combine_chunks()), pa.repeat("term", len(t)), t.column("item").combine_chunks(), t.column("value").combine_chunks())


def _top(table: pa.Table) -> pa.Table:
    """The first TOP_TERMS rows of each place by value, then item."""
    table = table.sort_by([("at", "ascending"), ("value", "descending"), ("item", "ascending")])
    at = np.asarray(table.column("at"))
    return table.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < TOP_TERMS))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    A pair row holds the divergence of a group from another source of its language over all kept terms; a term row
    one of the TOP_TERMS terms that are more frequent in the group than in its language and lie furthest apart.
    """
    found = written(kept_terms(term_counts(docs), least_docs))
    groups, kept = found.filter("term = ''").select("lang", "source"), found.filter("term <> ''")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    n_sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    per_shard = F.greatest(F.lit(SHARD_CELLS) / F.col("sources"), CELLS_PER_PAIR * F.col("sources"))
    langs = cut(n_sources.join(terms, "lang", "left")).select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.greatest(F.ceil(F.col("v") / per_shard), F.lit(1)).cast("int").alias("shards"))
    if langs.count() <= SENT_LANGS:
        langs = F.broadcast(langs)
    # every shard knows all sources of its language
    heads = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang")
    heads = heads.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("n"), "v")
    cells = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shard(pa.Table.from_batches(list(batches)))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    found = heads.unionByName(cells).groupBy("lang", "shard").applyInArrow(run, FOUND_DDL)
    # a term lies in one shard; of a pair every shard has a part
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
