"""Codes with their labels, for all coded fields of a layer at once.

A dictionary is a table (version, layer, field, code, label), as a manual of a version lists it; a null layer holds for
all layers. It is data like any other and handed in by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import Layer

#: Entries up to which a dictionary is sent to all tasks.
SENT_ENTRIES = 100_000


def coded_cells(rows: DataFrame, layer: Layer, key: str = "id") -> DataFrame:
    """key, field, code: one row per coded field of every row; a null code counts as empty."""
    cells = [F.struct(F.lit(f.name).alias("field"), stripped(F.col(f.column)).alias("code")) for f in layer.fields if f.codes and f.column in rows.columns]
    if not cells:
        return rows.filter(F.lit(False)).select(key, F.lit("").alias("field"), F.lit("").alias("code"))
    return rows.select(key, F.inline(F.array(*cells)))


def shown(code: Column, label: Column) -> Column:
    """`code (label)`; a code without a label as it is; `-` for an empty one."""
    return F.when(code == "", "-").otherwise(F.coalesce(F.concat(code, F.lit(" ("), label, F.lit(")")), code))


def decoded(rows: DataFrame, layer: Layer, dictionary: DataFrame, version: str, key: str = "id") -> DataFrame:
    """key, layer, field, code, label, text of every coded cell. Of several labels of one code the layer's own counts before one for all layers, then the smallest."""
    own = dictionary.filter((F.col("version") == version) & F.coalesce(F.col("layer") == layer.name, F.lit(True)))
    known = own.groupBy("field", "code").agg(F.min(F.struct(F.col("layer").isNull().alias("shared"), "label"))["label"].alias("label"))
    known = known.checkpoint()
    small = known.count() <= SENT_ENTRIES
    cells = coded_cells(rows, layer, key)
    return cells.join(F.broadcast(known) if small else known, ["field", "code"], "left").select(key, F.lit(layer.name).alias("layer"), "field", "code", "label", shown(F.col("code"), F.col("label")).alias("text"))
