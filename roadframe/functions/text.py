"""Text repair, counting and decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

HANGUL = "[\\uAC00-\\uD7A3]"
#: Characters that Korean text read in the wrong encoding is made of.
MARKER = "[\\u00A1-\\u00FF\\uFF61-\\uFF9F]"


def stripped(c: Column) -> Column:
    """Text without surrounding white space of any kind; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def hangul_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HANGUL))


def marker_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MARKER))


@pandas_udf(StringType())
def _reread(s: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else t.encode("latin-1").decode("cp949")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None

    return s.map(one)


def repaired(c: Column) -> Column:
    """Korean text that was read as Latin-1, read again as CP949 where that is clearly right; else c.

    Right means: changed, without replacement characters, more Hangul than before, and either a marker
    before or at least two Hangul after. Plain ASCII never leaves the JVM.
    """
    again = F.when(c.rlike("[\\u0080-\\u00FF]"), _reread(c))
    better = (again != c) & ~again.contains("�") & (hangul_count(again) > hangul_count(c)) & ((marker_count(c) > 0) | (hangul_count(again) >= 2))
    return F.when(F.coalesce(better, F.lit(False)), again).otherwise(c)


def broken(c: Column) -> Column:
    return c.contains("�")


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """`code (label)`; an unknown code as it is; `-` for an empty one."""
    code = stripped(c)
    found = F.lit(None).cast("string")
    if labels:
        found = F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), code)
    return F.when(code == "", "-").otherwise(F.coalesce(F.concat(code, F.lit(" ("), found, F.lit(")")), code))


#: What the first digit of a lane line's type says about its colour.
LINE_COLOURS = {"1": "황색", "2": "백색", "3": "청색", "9": "기타"}


def line_colour(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LINE_COLOURS.items() for x in kv)), F.substring(stripped(kind), 1, 1)), F.lit("-"))


def _searched(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))


def search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows in which the columns, joined by blanks, hold the query; case does not matter."""
    return rows.filter(F.contains(_searched(*columns), F.lower(F.lit(query.strip()))))


#: Characters of the pieces that a search index holds, and of a query's pieces how many of the rarest are looked up.
GRAM, RAREST = 3, 4


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def search_index(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """gram, key: which rows hold each piece of GRAM characters. Write it sorted by gram, and a search reads little of it."""
    return rows.select(key, F.explode(_grams(_searched(*columns))).alias("gram"))


def save_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def indexed_search(rows: DataFrame, index: DataFrame, key: str, query: str, *columns: str) -> DataFrame:
    """The rows that search() gives, from an index over the same columns.

    Rows that hold the rarest pieces of the query are candidates, and those are compared as a whole; a query shorter than
    a piece is looked for in all rows.
    """
    wanted = index.sparkSession.range(1).select(_grams(F.lower(F.lit(query.strip()))).alias("g")).first()["g"]
    if not wanted:
        return search(rows, query, *columns)
    held = index.filter(F.col("gram").isin(wanted))
    counts = {r["gram"]: r["n"] for r in held.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rare = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    if rare[0] not in counts:
        return rows.filter(F.lit(False))
    candidates = held.filter(F.col("gram").isin(rare)).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") == len(rare)).select(key)
    return search(rows.join(candidates, key, "left_semi"), query, *columns)
