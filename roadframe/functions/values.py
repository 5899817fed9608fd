"""Single values as column expressions: codes, numbers, and the first filled one of several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

_WHOLE = r"^[+-]?\d+$"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def code(c: Column) -> Column:
    """The text of a code, without the fraction of a whole number; null where it is empty. Give booleans as integers."""
    return F.nullif(F.regexp_replace(stripped(c), r"^([+-]?\d+)\.0$", "$1"), F.lit(""))


def enum_value(c: Column, codes: Sequence[str]) -> Column:
    """The code if it is one of codes, else null."""
    value = code(c)
    return F.when(value.isin(*codes), value)


def enum_issue(c: Column, codes: Sequence[str], required: bool) -> Column:
    """`missing` or `invalid` for a required value that enum_value does not take over, else null. Optional values fail silently."""
    value = code(c)
    if not required:
        return F.lit(None).cast("string")
    return F.when(value.isNull(), "missing").when(~value.isin(*codes), "invalid")


def first_filled(columns: Sequence[str], *names: str) -> Column:
    """The first non-null value under one of the names, in their order. Case does not matter, as in all of Spark's names."""
    by_lower = {c.lower(): c for c in columns}
    order = [by_lower[n.lower()] for n in names if n.lower() in by_lower]
    return F.coalesce(*(F.col(f"`{c}`") for c in order)) if order else F.lit(None)


def integer(c: Column) -> Column:
    """A whole number, written with or without a `.0`, or null."""
    value = code(c)
    return F.when(value.rlike(_WHOLE), value.try_cast("long"))


def number(c: Column) -> Column:
    """A decimal number, or null."""
    value = stripped(c)
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def or_zero(c: Column) -> Column:
    """A number, 0 where it is null."""
    return F.coalesce(c, F.lit(0))
