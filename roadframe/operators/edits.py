"""Batch edits with validation, and reports over whole datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import Layer
from .conform import FLOAT, is_integer, union_all


def edit_reason(layer: Layer, column: Column, value: Column) -> Column:
    """Why an edit is rejected, or null."""
    text = stripped(value)
    out = F.when(~column.isin(*(f.column for f in layer.fields)), "unknown column")
    for f in layer.fields:
        mine = column == f.column
        if f.required:
            out = out.when(mine & (text == ""), "required")
        if f.max_length is not None:
            out = out.when(mine & (F.char_length(text) > f.max_length), "too long")
        if f.codes:
            out = out.when(mine & (text != "") & ~text.isin(*f.codes), "unknown code")
        if f.kind == "integer":
            out = out.when(mine & (text != "") & ~is_integer(text), "no integer")
        if f.kind == "float":
            out = out.when(mine & (text != "") & ~text.rlike(FLOAT), "no number")
    return out


def apply_edits(rows: DataFrame, layer: Layer, edits: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(edited rows, rejected edits with reason). edits: key, column, value, seq; the last valid edit of a cell wins.

    Empty values become null references, -1, NaN or empty text. Ids are renamed only to unused ones;
    references to them stay as they are.
    """
    judged = edits.withColumn("reason", edit_reason(layer, F.col("column"), F.col("value")))
    known = rows.select(F.col(key).alias("__k"))
    judged = judged.join(known.withColumn("__known", F.lit(True)), judged[key] == F.col("__k"), "left").drop("__k").withColumn("reason", F.coalesce("reason", F.when(F.col("__known").isNull(), "unknown id")))
    taken = known.select(F.col("__k").alias("__v"), F.lit(True).alias("__taken"))
    judged = judged.join(taken, stripped(F.col("value")) == F.col("__v"), "left").withColumn("reason", F.coalesce("reason", F.when((F.col("column") == key) & F.coalesce(F.col("__taken"), F.lit(False)), "id in use"))).drop("__known", "__taken", "__v")
    good = judged.filter("reason IS NULL").groupBy(key, "column").agg(F.max_by(stripped(F.col("value")), "seq").alias("value"))
    columns = [f for f in layer.fields if f.column in rows.columns]
    wide = good.groupBy(F.col(key).alias("__e")).agg(*(F.max(F.when(F.col("column") == f.column, F.col("value"))).alias(f"__{f.column}") for f in columns))
    out = rows.join(wide, rows[key] == F.col("__e"), "left")
    for f in columns:
        new = F.col(f"__{f.column}")
        if f.kind == "integer":
            value = F.when(new == "", F.lit(-1)).otherwise(new.try_cast("double").cast("long"))
        elif f.kind == "float":
            value = F.when(new == "", F.lit(float("nan"))).otherwise(new.try_cast("double"))
        else:
            value = F.nullif(new, F.lit("")) if f.targets else new
        out = out.withColumn(f.column, F.when(new.isNotNull(), value).otherwise(F.col(f.column)))
    return out.select(*rows.columns), judged.filter("reason IS NOT NULL").select(*edits.columns, "reason")


def counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """section, layer, geom_kind, n with subtotals (null section or layer)."""
    every = union_all([df.select(F.lit(name).alias("layer"), *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("section", "geom_kind"))) for name, df in layers.items()])
    return every.rollup("section", "layer", "geom_kind").agg(F.count("*").alias("n"))
