"""Sections of a delivery as part of every key.

Sections are delivered side by side and may use the same ids. A qualified layer carries its section in its ids, in its
references and in its group keys, so resolving, cascades, components, pairing and numbering work as they are and
never mix two sections. A row outside any section is in the section of the empty name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Layer, Schema

#: Between a section and an id; a control character that no text field of a delivery holds.
BETWEEN = "\x1f"


def keys_of(layer: Layer, schema: Schema) -> list[str]:
    """Columns of a layer that hold ids of the delivery."""
    groups = [c for _, role, columns in schema.role_keys if role == layer.role for c in columns]
    return ["id", *(f.column for f in layer.references), *groups]


def qualified_id(section: Column, value: Column) -> Column:
    """The id within its section; null and empty stay what they are."""
    text = value.cast("string")
    return F.when(text == "", text).otherwise(F.concat(F.coalesce(section, F.lit("")), F.lit(BETWEEN), text))


def section_of(value: Column) -> Column:
    return F.nullif(F.substring_index(value, BETWEEN, 1), F.lit(""))


def local_id(value: Column) -> Column:
    """The id without its section; one that has none stays."""
    return F.substring_index(value, BETWEEN, -1)


def qualified(df: DataFrame, columns: Sequence[str], section: str = "section") -> DataFrame:
    """df with the section in the given key columns."""
    return df.withColumns({c: qualified_id(F.col(section), F.col(c)) for c in columns if c in df.columns})


def local(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: local_id(F.col(c)) for c in columns if c in df.columns})


def qualified_layers(layers: Mapping[str, DataFrame], schema: Schema) -> dict[str, DataFrame]:
    return {name: qualified(df, keys_of(schema.by_name[name], schema)) for name, df in layers.items()}


def local_layers(layers: Mapping[str, DataFrame], schema: Schema) -> dict[str, DataFrame]:
    """The layers under their delivered ids; section tells equal ones apart."""
    return {name: local(df, keys_of(schema.by_name[name], schema)) for name, df in layers.items()}
