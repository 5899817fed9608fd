"""One row per id: union in order, duplicates, ids shared between layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .conform import findings, union_all


def merged(rows: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first (or last) row of each key in the given order. Rows whose key is null or empty drop out."""
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    present = F.lit(True)
    for k in key:
        present &= F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return rows.filter(present).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("__n = 1").drop("__n")


def duplicates(rows: DataFrame, key: Sequence[str], order: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """All but the first row of each key, with `identical`: whether the compared columns equal the kept row's. NaN equals NaN."""
    by = Window.partitionBy(*key).orderBy(*order)
    first = F.first(F.struct(*compare)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumns({"__n": F.row_number().over(by), "identical": F.struct(*compare).eqNullSafe(first)})
    return ranked.filter("__n > 1").drop("__n")


def merge_layer(rows: DataFrame, layer: str, key: str = "id", order: str = "ord", config: Config | None = None, keep: str = "first", ignore: Sequence[str] = ("ord", "section", "source_path", "source_row"), within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(one row per key, findings). Conflicting duplicates drop in every mode; `off` only silences the finding.

    within names columns, such as the section, that are part of the key; their values must not be null.
    """
    config = config or Config()
    compare = [c for c in rows.columns if c not in ignore and c != key and c not in within]
    path = F.col("source_path") if "source_path" in rows.columns else F.lit(None).cast("string")
    keyed = rows.withColumn("__path", path)
    empty = keyed.filter(F.col(key).isNull() | (F.col(key).cast("string") == ""))
    again = duplicates(keyed.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [*within, key], [order], compare)
    parts = [findings(empty.filter(F.lit(config.reports("feature_id_missing"))), "warning", "feature-id-missing", layer, F.lit(""), "", source_path=F.col("__path"))]
    if config.reports("feature_id_duplicate_identical"):
        parts.append(findings(again.filter("identical"), "warning", "feature-id-duplicate-identical", layer, F.col(key), "", source_path=F.col("__path")))
    if config.reports("feature_id_duplicate_conflicting"):
        repairs = config.repairs("feature_id_duplicate_conflicting")
        parts.append(findings(again.filter("NOT identical"), "action" if repairs else "warning", "feature-id-duplicate-conflicting" + "-dropped" * repairs, layer, F.col(key), "", source_path=F.col("__path")))
    return merged(rows, [*within, key], [order], keep), union_all(parts)


def global_ids(layers: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """id, layers (sorted), ambiguous: every id of every layer once."""
    every = union_all([df.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("layer")) for name, df in layers.items()])
    return every.filter("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("layer")).alias("layers")).withColumn("ambiguous", F.size("layers") > 1)


def collisions(ids: DataFrame) -> DataFrame:
    return findings(ids.filter("ambiguous"), "warning", "global-id-collision", "", F.col("id"), F.array_join("layers", ","))


def distinct_in_order(rows: DataFrame, key: Sequence[str], value: str, order: str) -> DataFrame:
    """key, values: distinct non-null values by first appearance."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("__o"))
    pair: Column = F.struct("__o", F.col(value).alias("v"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["v"]).alias("values"))
