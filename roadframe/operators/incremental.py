"""Segmentation after edits: sections without an edit keep their results.

Sections are independent of each other, and entities are numbered by first appearance in the order of the links, in
which sections follow one another. So an entity's number is its number within its section plus the entities of
the sections before, and results of some sections can be exchanged by moving numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sections import section_of

#: Which column of each stage names a feature, and which columns are numbers of which entities.
STAGES: dict[str, tuple[str | None, dict[str, str]]] = {
    "uturns": ("link", {"id": "uturn"}),
    "lateral_groups": ("id", {"grp": "grp"}),
    "group_references": ("first_link", {"grp": "grp"}),
    "node_groups": ("node", {"node_grp": "node_grp", "grp": "grp"}),
    "junctions": ("id", {"junction": "junction"}),
    "junction_nodes": ("node", {"junction": "junction"}),
    "connections": (None, {"connection": "connection", "junction": "junction", "node_grp": "node_grp", "grp": "grp"}),
    "references": ("link", {"connection": "connection", "junction": "junction"}),
    "edges": ("link", {"connection": "connection", "junction": "junction"}),
}
#: The stage that numbers each kind of entity, by the column of that name or, for U-turns, id.
NUMBERED = {"uturn": "uturns", "grp": "lateral_groups", "node_grp": "node_groups", "junction": "junctions", "connection": "connections"}
#: Sections up to this number are sent to all tasks.
SENT_SECTIONS = 100_000


def _name(id_: Column) -> Column:
    return F.coalesce(section_of(id_), F.lit(""))


def sections_of(ids: DataFrame, column: str = "id") -> DataFrame:
    """The distinct sections of ids that carry them; the empty name stands for none."""
    return ids.select(_name(F.col(column)).alias("section")).distinct().checkpoint()


def _sent(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.count() <= SENT_SECTIONS else few


def within(rows: DataFrame, few: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in one of the sections."""
    return rows.join(_sent(few).select(F.col("section").alias("__section")), _name(F.col(column)) == F.col("__section"), "left_semi")


def _placed(stages: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each stage with the section of every row."""
    out = {}
    for stage, rows in stages.items():
        feature, _ = STAGES[stage]
        if feature is not None:
            out[stage] = rows.withColumn("__section", _name(F.col(feature)))
    if "connections" in stages:
        of = out["lateral_groups"].select("grp", "__section").distinct()
        out["connections"] = stages["connections"].join(of, "grp").select(*stages["connections"].columns, "__section")
    return out


def _counted(placed: Mapping[str, DataFrame]) -> DataFrame:
    """section, kind, first and n: the numbers of each kind of entity in each section."""
    parts = []
    for kind, stage in NUMBERED.items():
        if stage in placed:
            number = F.col("id" if kind == "uturn" else kind)
            parts.append(placed[stage].groupBy(F.col("__section").alias("section")).agg(F.min(number).alias("first"), F.count_distinct(number).alias("n")).withColumn("kind", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(old: Mapping[str, DataFrame], fresh: Mapping[str, DataFrame], dirty: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Stages of old outside the dirty sections and of fresh, which covers those, with numbers as one run would give them."""
    sides = {"old": _placed(old), "fresh": _placed(fresh)}
    few = _sent(dirty).select(F.col("section").alias("__dirty"))
    sides["old"] = {k: df.join(few, F.col("__section") == F.col("__dirty"), "left_anti") for k, df in sides["old"].items()}
    counts = _counted(sides["old"]).unionByName(_counted(sides["fresh"]))
    order = links.groupBy(_name(F.col("id")).alias("section")).agg(F.min("ord").alias("o"))
    before = Window.partitionBy("kind").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    # a row per section and kind
    moves = counts.join(order, "section").withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("section", "kind", "shift").checkpoint()
    small = moves.count() <= SENT_SECTIONS
    out = {}
    for stage, (_, columns) in STAGES.items():
        if stage not in fresh or stage not in old:
            continue
        rows = sides["old"][stage].unionByName(sides["fresh"][stage])
        for i, (column, kind) in enumerate(columns.items()):
            own = moves.filter(F.col("kind") == kind).select(F.col("section").alias(f"__s{i}"), F.col("shift").alias(f"__m{i}"))
            rows = rows.join(F.broadcast(own) if small else own, F.col("__section") == F.col(f"__s{i}")).withColumn(column, (F.col(column) + F.col(f"__m{i}")).cast(old[stage].schema[column].dataType))
        out[stage] = rows.select(*old[stage].columns).checkpoint()
    return out
