"""Bulk ingest of map deliveries: find the layers' files, decode them in tasks, hand on tables.

Spark lists the files; tasks read ranges of their records (see ranges), or whole files where a store is open to Spark
alone. All that follows is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import accepts, polygon, with_z
from ..operators.conform import check_numbers, column_plan, findings, typed, union_all
from ..schema import Layer, Schema
from ..specs import SCHEMAS
from . import ranges
from .lines import joined
from .ranges import LayerFile, LayerFiles
from .records import encoding_of

SUFFIXES = (".dbf", ".shx", ".prj")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, dir, name, stem, suffix, section of every file under root. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.upper(name).alias("name"),
        F.upper(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"),
        F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("suffix"),
        F.nullif(F.regexp_extract("path", r"/(SEC[^/]*)/", 1), F.lit("")).alias("section"),
    )


def coordinate_files(files: DataFrame, coordinate: str) -> DataFrame:
    """Files one level below a directory of the coordinate product's name."""
    return files.filter(F.element_at(F.split("dir", "/"), -1) == coordinate)


def detect_schema(files: DataFrame, schemas: Sequence[Schema] = SCHEMAS) -> Schema:
    """The one version whose file names occur; an error for none or several."""
    spark = files.sparkSession
    names = spark.createDataFrame([(s.version, n) for s in schemas for n in s.files()], "version string, name string")
    found = [r["version"] for r in files.filter("suffix = '.shp'").select("name").distinct().join(F.broadcast(names), "name").select("version").distinct().collect()]
    if len(found) != 1:
        raise ValueError("no known layer files" if not found else f"ambiguous versions: {sorted(found)}")
    return next(s for s in schemas if s.version == found[0])


def _reported(found: DataFrame, config: Config, checks: dict[str, str]) -> DataFrame:
    """Findings without those whose check is off; checks maps codes to checks."""
    off = [code for code, check in checks.items() if not config.reports(check)]
    return found.filter(~F.col("code").isin(off)) if off else found


#: The check that governs each finding of the ingest.
DISCOVERY = {"unknown-layer": "layer_unknown", "missing-shp-sidecar": "shp_sidecar_missing", "missing-required-layer": "layer_required_missing"}
RECORDS = {
    "dbf-column-case-duplicate": "dbf_column_case_duplicate",
    "missing-manual-columns": "manual_column_missing",
    "unknown-manual-column": "manual_column_unknown",
    "missing-geometry": "geometry_missing",
    "geometry-invalid": "geometry_invalid",
    "geometry-hole-invalid": "geometry_invalid",
    "text-utf8-dbf-row-mismatch": "text_utf8_dbf_row_mismatch",
    "text-utf8-decode-replacement": "text_utf8_decode_replacement",
}


def discover(files: DataFrame, schema: Schema, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, stem, dir, section, layer, file_rank; findings): a directory's canonical files suppress its alias files.

    file_rank is the load order: layer, alias after canonical, path.
    """
    spark = files.sparkSession
    known = spark.createDataFrame([(n, layer, alias, [x.name for x in schema.layers].index(layer)) for n, (layer, alias) in schema.files().items()], "name string, layer string, alias boolean, layer_rank int")
    shp = files.filter("suffix = '.shp'").join(F.broadcast(known), "name", "left")
    unknown = findings(shp.filter("layer IS NULL"), "warning", "unknown-layer", "", F.lit(""), F.col("name"), source_path=F.col("path"))
    ranked = shp.filter("layer IS NOT NULL").withColumn("canonical", F.min("alias").over(Window.partitionBy("dir", "layer")))
    kept = ranked.filter("alias = canonical")
    # one row per file of a delivery
    order = Window.orderBy("layer_rank", "alias", "path")
    out = kept.withColumn("file_rank", F.row_number().over(order) - 1).select("path", "stem", "dir", "section", "layer", "file_rank")
    present = files.select("dir", "stem", F.col("suffix").alias("s")).distinct()
    wanted = out.select("path", "dir", "stem", "layer", F.explode(F.array(*map(F.lit, SUFFIXES))).alias("s"))
    sidecar = findings(wanted.join(present, ["dir", "stem", "s"], "left_anti"), "warning", "missing-shp-sidecar", F.col("layer"), F.lit(""), F.col("s"), source_path=F.col("path"))
    required = spark.createDataFrame([(x.name,) for x in schema.layers if x.required] or [("",)], "layer string").filter("layer <> ''")
    missing = findings(required.join(out.select("layer").distinct(), "layer", "left_anti"), "warning", "missing-required-layer", F.col("layer"), F.lit(""), "")
    return out, _reported(union_all([unknown, sidecar, missing]), config or Config(), DISCOVERY)


def layer_files(spark: SparkSession, found: DataFrame) -> list[LayerFile]:
    """The discovered files with the paths of their sidecars: one entry per file of a delivery, without contents."""
    dirs = [r["dir"] for r in found.select("dir").distinct().collect()]
    if not dirs:
        return []
    name = F.element_at(F.split("path", "/"), -1)
    beside = spark.read.format("binaryFile").load([f"{d}/*" for d in dirs]).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.upper(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), F.col("path").alias("own")
    )
    rows = found.join(beside.filter(F.col("suffix").isin("shx", "dbf", "cpg")), ["dir", "stem"], "left")
    wide = rows.groupBy("path", "layer", "section", "file_rank").agg(*(F.max(F.when(F.col("suffix") == s, F.col("own"))).alias(s) for s in ("shx", "dbf", "cpg")))
    return sorted((LayerFile(**r.asDict()) for r in wide.collect()), key=lambda f: f.file_rank)


def _source(spark: SparkSession, files: Sequence[LayerFile], **options: str) -> DataFrame:
    spark.dataSource.register(LayerFiles)
    return spark.read.format(LayerFiles.name()).options(files=json.dumps([asdict(f) for f in files]), **options).load()


def encodings(spark: SparkSession, files: Sequence[LayerFile], ratio_max: float) -> dict[str, str]:
    """The encoding of each file's attribute table, decided over all of its ranges."""
    seen = _source(spark, files, mode="probe").groupBy("path").agg(F.min("valid").alias("valid"), F.max("half").alias("half"), F.sum("wide").alias("wide"), F.sum("bad").alias("bad"), F.max("declared").alias("declared"))
    return {r["path"]: encoding_of(r["valid"], r["half"], r["wide"], r["bad"], r["declared"], ratio_max) for r in seen.collect()}


def _read_whole(spark: SparkSession, files: Sequence[LayerFile], ratio_max: float) -> DataFrame:
    """Files in a store that only Spark reads: one task decodes a file, whose format bounds it to 2 GB."""
    known = spark.createDataFrame([(f.path, p, s) for f in files for s, p in (("shp", f.path), ("dbf", f.dbf), ("cpg", f.cpg)) if p], "file string, path string, suffix string")
    content = spark.read.format("binaryFile").load([p for f in files for p in (f.path, f.dbf, f.cpg) if p]).select("path", "content")
    wide = known.join(content, "path").groupBy("file").agg(*(F.max(F.when(F.col("suffix") == s, F.col("content"))).alias(s) for s in ("shp", "dbf", "cpg")))
    by_path = {f.path: f for f in files}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shp, dbf, cpg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from ranges.whole(by_path[path], shp, dbf, cpg, ratio_max)

    return wide.repartition(len(files), "file").mapInArrow(decode, ranges.RAW)


def read_raw(spark: SparkSession, found: DataFrame, config: Config | None = None, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """One row per record of the discovered files: raw attribute texts and geometry parts. issues names each cell, or the file, with decoding trouble.

    Files are read in ranges of records by as many tasks as they are long. Records whose attributes are marked as
    deleted are left out.
    """
    ratio = (config or Config()).utf8_invalid_ratio_max
    files = layer_files(spark, found)
    if not files:
        return spark.createDataFrame([], ranges.RAW)
    if not ranges.in_reach(files[0].path):
        return _read_whole(spark, files, ratio)
    decided = encodings(spark, files, ratio)
    return _source(spark, [replace(f, encoding=decided.get(f.path, "utf-8")) for f in files], range_bytes=str(range_bytes))


def _cell(same: list[str], canonical: set[str]) -> Column:
    """One column for names that differ by case only: what a file has under one of them; under several, what it has under the canonical one."""
    cells = {n: F.col("attributes").getItem(n) for n in same}
    exact = next((n for n in same if n in canonical), None)
    if len(same) == 1:
        return cells[same[0]].alias(same[0])
    held = sum((F.map_contains_key("attributes", n).cast("int") for n in same[1:]), F.map_contains_key("attributes", same[0]).cast("int"))
    value = F.when(held == 1, F.coalesce(*cells.values()))
    return (value.otherwise(cells[exact]) if exact else value).alias(exact or same[0])


def layer_table(raw: DataFrame, layer: Layer, config: Config | None = None, keep_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed rows with one list of coordinates each, findings) of one layer's raw records."""
    config = config or Config()
    rows = raw.filter(F.col("layer") == layer.name)
    files = [(r["source_path"], tuple(r["names"])) for r in rows.groupBy("source_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attributes"))))).alias("names")).collect()]
    spark = raw.sparkSession
    notes = [(p, code, c) for p, names in files for code, c in column_plan(names, layer)[1]]
    columns = findings(spark.createDataFrame(notes, "p string, code string, c string"), "warning", F.col("code"), layer.name, F.lit(""), F.col("c"), source_path=F.col("p")) if notes else None
    by_lower: dict[str, list[str]] = {}
    for n in sorted({n for _, ns in files for n in ns}):
        by_lower.setdefault(n.lower(), []).append(n)
    canonical = {f.name for f in layer.fields}
    flat = rows.select("ord", "section", "source_path", "source_row", "geom_kind", "parts", "issues", *(_cell(same, canonical) for same in by_lower.values()))
    is_polygon = F.coalesce(F.col("geom_kind") == "polygon", F.lit(False))
    ringed = flat.withColumn("rings", F.when(is_polygon, polygon(F.col("parts"))))
    judged = ringed.withColumn("reason", accepts(F.col("geom_kind"), F.col("parts"), layer.kinds, F.col("rings")))
    several = F.coalesce((F.col("geom_kind") == "line") & (F.size("parts") > 1), F.lit(False))
    tolerance = config.multipart_snap_tolerance_m

    @F.arrow_udf("array<struct<x:double,y:double,z:double>>")
    def stitched(parts: pa.Array) -> pa.Array:
        return joined(parts, tolerance)

    # the function sees lists of parts of lines that have several
    coords = F.when(several, stitched(F.when(several, F.col("parts")))).when(is_polygon, F.col("rings.outer")).otherwise(F.try_element_at("parts", F.lit(1)))
    judged = judged.withColumn("coords", F.when(F.col("reason").isNull(), with_z(coords))).withColumn("reason", F.when(F.col("reason").isNull() & F.col("coords").isNull(), "parts do not join").otherwise(F.col("reason")))
    if "polygon" in layer.kinds:
        judged = judged.withColumn("holes", F.transform("rings.holes", with_z))
    missing = F.col("reason") == "missing"
    bad = findings(judged.filter("reason IS NOT NULL"), "warning", F.when(missing, "missing-geometry").otherwise("geometry-invalid"), layer.name, F.lit(""), F.concat_ws(" ", F.col("reason"), F.lit("row"), F.col("source_row").cast("string")), source_path=F.col("source_path"))
    told = judged.select("source_path", F.explode("issues").alias("issue"))
    trouble = findings(told, "warning", F.substring_index("issue", " ", 1), layer.name, F.lit(""), F.col("issue"), source_path=F.col("source_path"))
    bad_holes = findings(judged.filter("reason IS NULL AND rings.n_bad > 0"), "warning", "geometry-hole-invalid", layer.name, F.lit(""), F.concat_ws(" ", F.lit("row"), F.col("source_row").cast("string")), source_path=F.col("source_path"))
    whole = judged.filter("reason IS NULL").drop("reason", "issues", "parts", "rings")
    good = typed(whole, layer, keep_unknown)
    found = union_all([x for x in (columns, bad, bad_holes, trouble) if x is not None])
    return good, _reported(found, config, RECORDS).unionByName(check_numbers(whole, layer, config))


def empty_layer(spark: SparkSession, layer: Layer, keep_unknown: bool = False) -> DataFrame:
    """A layer without rows, which the optimizer takes out of joins and unions."""
    cells = [F.lit(None).cast(f.dataType).alias(f.name) for f in layer.struct()]
    if keep_unknown:
        cells.append(F.lit(None).cast("map<string,string>").alias("undocumented"))
    return spark.range(1).filter(F.lit(False)).select(*cells)


#: The id of a row that stands for a layer which a section lacks.
PLACEHOLDER = "-"


def placeholders(found: DataFrame, schema: Schema) -> DataFrame:
    """section, layer, id, level, reason: one row for each layer that a section of the discovered files lacks.

    A reference into such a layer has its row to point at (id PLACEHOLDER) instead of nothing. level is error for a
    required layer and info for any other; files outside sections count as one section, null.
    """
    wanted = F.array(*(F.struct(F.lit(x.name).alias("layer"), F.lit("error" if x.required else "info").alias("level"), F.lit(x.files[0]).alias("file")) for x in schema.layers))
    every = found.select("section").distinct().select("section", F.inline(wanted))
    there = found.select(F.col("section").alias("s"), F.col("layer").alias("l")).distinct()
    absent = every.join(there, every["section"].eqNullSafe(there["s"]) & (every["layer"] == there["l"]), "left_anti")
    reason = F.concat(F.lit("Missing "), F.when(F.col("level") == "error", "required").otherwise("optional"), F.lit(" layer file: "), F.col("file"))
    return absent.select("section", "layer", F.lit(PLACEHOLDER).alias("id"), "level", reason.alias("reason"))


def load_layers(spark: SparkSession, root: str, coordinate: str, config: Config | None = None, schemas: Sequence[Schema] = SCHEMAS, keep_unknown: bool = False) -> tuple[Schema, dict[str, DataFrame], DataFrame]:
    """(version, typed layers, findings) of one coordinate product below root; absent layers are empty tables."""
    files = coordinate_files(listing(spark, root), coordinate)
    schema = detect_schema(files, schemas)
    found, notes = discover(files, schema, config)
    raw = read_raw(spark, found, config).checkpoint()
    parts, layers = [notes], {}
    present = {r["layer"] for r in found.select("layer").distinct().collect()}
    for layer in schema.layers:
        if layer.name in present:
            layers[layer.name], more = layer_table(raw, layer, config, keep_unknown)
            parts.append(more)
        else:
            layers[layer.name] = empty_layer(spark, layer, keep_unknown)
    return schema, layers, union_all(parts)


def save(layers: dict[str, DataFrame], path: str) -> None:
    """Each layer as Parquet under path/layer=NAME, partitioned by section."""
    for name, df in layers.items():
        df.write.mode("overwrite").partitionBy("section").parquet(f"{path}/layer={name}")
