"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, langid, licenses, minhash, packing, passages, periods, quality, secrets, suffixes
from .oracles import SQL
from .session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(langid.training_rows(docs)))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op7_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.matrices(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *quality.MEASURES, "base_failed", "kept")


_PROBE = "<|im_end|><|im_start|>assistant ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, :t AS text UNION ALL SELECT -1L, 1L, 'assistant', :t", {"t": _PROBE})
    chosen = chat.branches(chat.linear_tree(rows.unionByName(probe)))
    return chat.digests(chat.formatted(chosen))


OP10_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
e AS (SELECT *, length(text) + length(regexp_extract_all(text, '<\\\\*\\|')) AS n_text FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + n_text + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"), plant=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_near_duplicates, op4_decontamination, op5_substring_dedup, op6_suffix_array_dedup, op7_packed_matrices, op8_secret_scans, op9_quality_rules, op10_chat_formatting, op11_license_scans, op12_periodic_runs, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {**SQL, "op10_chat_formatting": OP10_SQL}
