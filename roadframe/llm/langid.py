"""Language by compression: the language whose dictionary makes a text smallest.

fit() takes a bounded sample of labelled texts per language and keeps its bytes as a raw-content
zstandard dictionary. predict() compresses every piece of every whole text with each dictionary and
compares the sums. The score is the relative margin to the runner-up; narrow margins are rejected.

Defined results: `und` with score 0, rejected, for null texts and texts without a letter; ties go to
the language with more labelled rows, then by name; with no labelled row every text is `und`;
repeated rows give one row each; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .session import filtered, text_rows

UNKNOWN = "und"
#: Bounds of the labelled sample: bytes of dictionary, rows and characters per row, for each language.
DICT_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 96_000, 160, 1000
PIECE_BYTES, LEVEL = 1024, 6
#: Predictions whose margin is narrower than this are rejected.
MIN_MARGIN = 0.005


@dataclass(frozen=True)
class Model:
    """Languages in order of preference at ties, with their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, lang. At most SAMPLE_ROWS rows of SAMPLE_CHARS characters per language are gathered."""
    rows = text_rows(labelled, "doc_id", "text", "lang").filter("lang IS NOT NULL AND length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), ())
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * SAMPLE_ROWS / n)))), F.col("lang"))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    drawn = rows.filter(draw < share).select("lang", F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)).alias("text"), draw.alias("draw"))
    best = drawn.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "text"))), 1, SAMPLE_ROWS)["text"].alias("texts"))
    # one row of bounded size per language
    found = {r["lang"]: "\n".join(r["texts"]).lower().encode()[-DICT_BYTES:] for r in best.collect()}
    order = sorted(found, key=lambda lang: (-sizes[lang], lang))
    return Model(tuple(order), tuple(found[lang] for lang in order))


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    # \w also has numerals of other scripts, which are not letters
    while m is not None and not m[0].isalpha():
        m = _LETTER.search(text, m.end())
    return m is not None


def _compressors(model: Model) -> list:
    import zstandard as z

    found = []
    for raw in model.dictionaries:
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        found.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def classify(text: str | None, model: Model, compressors: list) -> tuple[str, float]:
    if not compressors or not text or not has_letter(text):
        return UNKNOWN, 0.0
    raw = text.lower().encode("utf-8", "replace")
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return model.languages[0], 1.0
    second = min(s for i, s in enumerate(sizes) if i != best)
    return model.languages[best], (second - sizes[best]) / second


def _predicted(batches: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    compressors = _compressors(model)
    for b in A.chunks(batches):
        found = [classify(t, model, compressors) for t in b.column("text").to_pylist()]
        yield A.batch(schema, b.column("doc_id"), [lang for lang, _ in found], [score for _, score in found], [lang == UNKNOWN or score < MIN_MARGIN for lang, score in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs, from its text alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    return text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(lambda batches: _predicted(batches, model, schema), "doc_id long, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return text_rows(docs, "doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, whole and unchanged, whose language is not rejected."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model)
        for b in A.chunks(batches):
            found = (classify(t, model, compressors) for t in b.column("text").to_pylist())
            yield b.filter(pa.array([lang != UNKNOWN and score >= MIN_MARGIN for lang, score in found], type=pa.bool_()))

    return filtered(docs, keep)
