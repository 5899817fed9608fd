"""Quality rules with thresholds learned per language and source.

measure() counts each whole text once. thresholds() turns the measures into mergeable quantile
sketches: logarithmic histograms with a fixed relative error, whose bucket counts add up, so that
partial aggregation merges them before any shuffle and a source, a language and the whole corpus
share the same counts. verdicts() joins the fences back and filters. A group without a document that passes
the base rules has no fences and needs none.

Defined results: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import arrays as A
from .session import cut, text_rows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

#: Sketch resolution: neighbouring buckets differ by this factor, after adding SHIFT.
GAMMA, SHIFT = 1.02, 1e-3
#: A group of so many documents weighs as much as its language, and a language as much as the corpus.
PRIOR = 200


@dataclass(frozen=True)
class Fence:
    """A feature's fences: above its quantile `high` by `spread` times the way from the quantile `base` up to it, and as far below base if two_sided."""

    base: float
    high: float
    spread: float
    two_sided: bool = False


#: Word lengths spread around their middle. The others are 0 in most documents: symbols are rare where text is clean, so
#: their fence starts where a tenth of the documents show more; some repeated lines and words are ordinary.
FEATURES = {"mean_word": Fence(0.25, 0.75, 6.0, two_sided=True), "symbol_share": Fence(0.5, 0.9, 1.0), "dup_share": Fence(0.5, 0.99, 1.0), "repeat_share": Fence(0.5, 0.99, 1.5)}
#: The least width, where both quantiles fall into one bucket, beside the width of that bucket.
LEAST_WIDTH = 0.01

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _line_repeats(texts: A.Texts, sums: np.ndarray, words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines holding a word, and how many of them equal an earlier one."""
    breaks = np.flatnonzero(texts.buf == 0x0A)
    filled = np.flatnonzero(np.diff(texts.off))
    start = np.unique(np.concatenate([texts.off[:-1][filled], breaks + 1, texts.off[1:][filled]]))
    start = start[start < len(texts.buf)]
    nxt = np.append(start[1:], len(texts.buf))
    end = np.where(texts.buf[nxt - 1] == 0x0A, nxt - 1, nxt)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(texts.off, start, side="right") - 1
    keys = A.prints(texts, start, end, sums) ^ A.mix(doc.astype(np.uint64))
    first = np.unique(keys, return_index=True)[1]
    distinct = np.bincount(doc[first], minlength=texts.n)
    lines = np.bincount(doc, minlength=texts.n)
    return lines, lines - distinct


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in A.chunks(batches):
        texts = A.Texts.of(b.column("text"))
        words, sums = A.Words(texts, A.NOT_SPACE), texts.sums()
        chars = np.zeros(len(texts.buf) + 1, dtype=np.int64)
        np.cumsum((texts.buf & 0xC0) != 0x80, out=chars[1:])
        at, keys = A.windows(A.prints(texts, words.start, words.end, sums), words.doc, REPEAT_WINDOW)
        keys ^= A.mix(words.doc[at].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeats = A.covered(at[twice], REPEAT_WINDOW, words.n)
        per_word = chars[words.end] - chars[words.start]
        symbols = A.per_doc(_SYMBOL[texts.buf], texts.off)
        lines, dup_lines = _line_repeats(texts, sums, words)
        yield A.batch(schema, *(b.column(c) for c in ("doc_id", "lang", "source")), words.counts, A.per_doc(per_word, words.first), symbols, dup_lines, A.per_doc(repeats, words.first), lines)


def measure(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, lang, source, the five counts and n_lines, its lines with a word."""
    rows = text_rows(docs, "doc_id", "lang", "source", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((m, pa.int64()) for m in (*MEASURES, "n_lines"))])
    return rows.mapInArrow(lambda batches: _counted(batches, schema), "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in (*MEASURES, "n_lines")))


def _features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"mean_word": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "dup_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words}


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n: the mergeable sketch of every group, over documents that pass the base rules."""
    cells = F.array(*(F.struct(F.lit(name).alias("feature"), F.floor(F.log(value + SHIFT) / float(np.log(GAMMA))).cast("int").alias("bucket")) for name, value in _features().items()))
    return measured.filter(~_base_failed()).select("lang", "source", F.inline(cells)).groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def _by_feature(of: Callable[[Fence], float | bool]) -> Column:
    """A parameter of the row's feature."""
    return F.element_at(F.create_map(*(F.lit(x) for f, rule in FEATURES.items() for x in (f, of(rule)))), F.col("feature"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and lo_/hi_ for each feature: the fences that hold for each group.

    A fence is the mean of the group's, its language's and the corpus' own, weighted by documents against PRIOR, so
    that no verdict jumps when a group grows by one.
    """
    levels = {"g": ["lang", "source"], "l": ["lang"], "c": []}
    fences = {}
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "feature")
        seen = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)})
        value = F.greatest(F.pow(F.lit(GAMMA), F.col("bucket") + 0.5) - SHIFT, F.lit(0.0))
        # the value at a rank leaves out the largest one where a quantile is cut among few documents
        at = {q: F.floor(_by_feature(lambda r: getattr(r, q)) * (F.col("total") - 1)) + 1 for q in ("base", "high")}
        cuts = seen.groupBy(*keys, "feature").agg(F.max("total").alias("n"), *(F.min(F.when(F.col("upto") >= rank, value)).alias(q) for q, rank in at.items()))
        width = F.greatest(_by_feature(lambda r: r.spread) * (F.col("high") - F.col("base")), LEAST_WIDTH + (GAMMA - 1) * (F.col("high") + SHIFT))
        low = F.when(_by_feature(lambda r: r.two_sided), F.col("base") - width).otherwise(F.lit(-1.0))
        cuts = cuts.select(*keys, "feature", "n", F.struct(low.alias("lo"), (F.col("high") + width).alias("hi")).alias("fence"))
        wide = cuts.groupBy(*keys).agg(F.max("n").alias(f"{level}_n"), *(F.max(F.when(F.col("feature") == f, F.col("fence"))).alias(f"{level}_{f}") for f in FEATURES))
        fences[level] = wide
    g, lang, corpus = fences["g"], fences["l"].withColumnRenamed("lang", "l_lang"), fences["c"]
    # one row for the corpus and one per language: aggregates without further growth
    found = g.join(lang, g["lang"].eqNullSafe(lang["l_lang"]), "left").crossJoin(F.broadcast(corpus))

    def blended(f: str, side: str) -> Column:
        weight = {level: F.col(f"{level}_n") / (F.col(f"{level}_n") + PRIOR) for level in "gl"}
        wide = weight["l"] * F.col(f"l_{f}")[side] + (1 - weight["l"]) * F.col(f"c_{f}")[side]
        return weight["g"] * F.col(f"g_{f}")[side] + (1 - weight["g"]) * wide

    return found.select("lang", "source", *(blended(f, side).alias(f"{side}_{f}") for f in FEATURES for side in ("lo", "hi")))


def verdicts(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """The measures with base_failed and kept; a document is kept if no feature leaves its group's fences."""
    right = fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = measured.join(right, measured["lang"].eqNullSafe(right["f_lang"]) & measured["source"].eqNullSafe(right["f_source"]), "left")
    inside = F.lit(True)
    for f, value in _features().items():
        inside &= F.coalesce(value.between(F.col(f"lo_{f}"), F.col(f"hi_{f}")), F.lit(True))
    return joined.select("doc_id", "lang", "source", *MEASURES, _base_failed().alias("base_failed"), (~_base_failed() & inside).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measure, learn the fences from the same rows, and judge every row."""
    measured = cut(measure(docs))
    return verdicts(measured, thresholds(sketches(measured)))
