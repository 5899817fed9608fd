"""Segmentation after edits equals a full run, and computes the edited sections only."""

import os

import pytest
from pyspark.sql import functions as F

from roadframe.operators import incremental, sections, segment
from roadframe.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def test_edited_sections(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    n = catalog._classes(spark, DATA)
    # thirds of the network, as three sections that use the same ids
    n["links"] = n["links"].filter("id % 3 <> 0 OR id < 4000")
    parts = []
    for k, name in enumerate(("S1", "S2", "S3")):
        df = {t: rows.withColumn("section", F.lit(name)) for t, rows in n.items()}
        for t in ("links", "nodes"):
            df[t] = df[t].withColumn("ord", F.col("ord") + k * 10**9)
        df["links"] = sections.qualified(df["links"], ["id", "from_id", "to_id", "r_id", "l_id"]).filter(F.col("ord") % 3 != (5 if k == 0 else k))
        df["nodes"] = sections.qualified(df["nodes"], ["id", "group_key"])
        df["markers"] = sections.qualified(df["markers"], ["id"])
        parts.append(df)
    whole = {t: parts[0][t].unionByName(parts[1][t]).unionByName(parts[2][t]).checkpoint() for t in parts[0]}
    before = segment.segment(whole["links"], whole["nodes"], whole["markers"], by_section=True)
    assert before["junctions"].filter(F.col("id").startswith("S2")).count() and before["connections"].count() > 10
    # every junction and group lies in one section, though links of different sections cross at the same places
    assert before["junctions"].groupBy("junction").agg(F.count_distinct(sections.section_of(F.col("id"))).alias("n")).filter("n > 1").isEmpty()
    changed = (sections.section_of(F.col("id")) == "S2") & (F.col("ord") % 7 == 1)
    edited = whole["links"].filter(changed).select("id")
    links = whole["links"].withColumns({"is_junction": F.when(changed, ~F.col("is_junction")).otherwise(F.col("is_junction")), "l_id": F.when(changed, None).otherwise(F.col("l_id"))}).checkpoint()
    want = segment.segment(links, whole["nodes"], whole["markers"], by_section=True)
    dirty = incremental.sections_of(edited)
    assert [r["section"] for r in dirty.collect()] == ["S2"]
    fresh = segment.segment(*(incremental.within(df, dirty) for df in (links, whole["nodes"], whole["markers"])), by_section=True, declared=False)
    assert fresh["lateral_groups"].filter(~F.col("id").startswith("S2")).isEmpty()
    got = incremental.merged(before, fresh, dirty, links)
    assert set(got) == set(want)
    for stage in want:
        assert got[stage].dtypes == want[stage].dtypes and rows_of(got[stage]) == rows_of(want[stage]), stage
    assert any(rows_of(before[s]) != rows_of(want[s]) for s in ("junctions", "connections"))


def test_only_sections_fall_into_parts(spark):
    from roadframe.dataset import MapDataset, resegmented
    from roadframe.specs import V2023

    with pytest.raises(ValueError, match="section"):
        resegmented(MapDataset(V2023, {}), {}, spark.range(1))
