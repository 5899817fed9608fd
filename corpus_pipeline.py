"""A corpus from raw documents to packed token ids: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and gives a defined result for nulls in any column,
empty and very long texts, ties, repeated rows, empty tables and further columns of any name. All but the last
return the columns of docs, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadframe.llm import decontaminate, langid, minhash, packing, secrets
from roadframe.llm.queries import tokenizer_path
from roadframe.llm.session import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected.

    A text that is null, empty or without a letter is rejected, and so is one whose best two languages are too close
    to tell; equal texts share their verdict. Rows without a lang are judged but not learned from. An empty table stays empty.
    """
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Five-word shingles, similarity 0.8. Texts without words and rows without a doc_id are kept, each; of several rows
    with the kept doc_id all stay.
    """
    return minhash.first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; an empty benchmark drops nothing; repeated rows go or stay together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars stays that of the source text.

    Null texts stay null; overlapping secrets are masked as one; repeated rows are masked alike.
    """
    return secrets.masked(docs)


#: Words that a worker remembers while it packs: fewer than for packing alone, since the stages before left their own tables in it.
REMEMBERED = 100_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their token ids and their places in the packed sequences.

    Null and empty texts give the end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.packed(docs, tokenizer_path(), with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing_stage),
]

#: SQL can express neither the compression classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
