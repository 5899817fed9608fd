"""Field checks: every rule on every row in one pass, and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.text import broken, repaired, stripped
from ..schema import Field, Layer

FINDINGS = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("kind", "code", "layer", "feature_id", "source_path", "reason")),
        T.StructField("before", T.MapType(T.StringType(), T.StringType())),
        T.StructField("after", T.MapType(T.StringType(), T.StringType())),
    ]
)
INTEGER = r"(?U)^\s*[+-]?\d+\s*$"
FLOAT = r"(?U)^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_HIST = "00[1-8]"


def findings(rows: DataFrame, kind: str, code: Column | str, layer: Column | str, feature_id: Column, reason: Column | str, before: Column | None = None, after: Column | None = None, source_path: Column | None = None) -> DataFrame:
    """Rows of any table as findings."""
    empty = F.lit(None).cast("map<string,string>")
    value = {"kind": F.lit(kind), "code": code, "layer": layer, "feature_id": feature_id, "source_path": source_path, "reason": reason}
    cells = [(F.lit(v) if isinstance(v, str) or v is None else v).cast("string").alias(k) for k, v in value.items()]
    return rows.select(*cells, (empty if before is None else before).alias("before"), (empty if after is None else after).alias("after"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_text(c: Column, kind: str) -> Column:
    """The text that rules look at: stripped, whole decimal numbers without their fraction."""
    if kind == "float":
        return F.when(c.isNull() | F.isnan(c), "").when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return stripped(c)


def is_integer(text: Column) -> Column:
    """An integer, or a decimal number that is whole."""
    number = text.try_cast("double")
    return text.rlike(INTEGER) | (text.rlike(FLOAT) & F.coalesce(number == F.floor(number), F.lit(False)))


def field_rules(f: Field, layer_name: str, c: Column, config: Config, raw: bool = True) -> list[Column]:
    """One struct(code, field, value) per broken rule of a field, null where it holds.

    raw says that numbers still are the texts of the file; empty numbers are reported as missing only
    if the configuration asks for it, since typing gives them a default.
    """
    text = value_text(c, "text" if raw else f.kind)
    number = f.kind in ("integer", "float")
    found: list[tuple[str, str, Column]] = []
    if f.required and (not number or config.report_required_numbers):
        found.append(("manual_field_required_missing", "manual-field-required-missing", text == ""))
    if f.max_length is not None:
        found.append(("manual_field_length_exceeded", "manual-field-length-exceeded", F.char_length(text) > f.max_length))
    if number and raw:
        good = is_integer(text) if f.kind == "integer" else text.rlike(FLOAT)
        found.append(("manual_field_type_invalid", "manual-field-type-invalid", (text != "") & ~good))
    if f.codes:
        found.append(("manual_field_code_invalid", "manual-field-code-invalid", (text != "") & ~text.isin(*f.codes)))
    if f.name == "HistType":
        prefix = "" if (f.max_length or 0) <= 3 else layer_name.split("_")[0]
        found.append(("manual_hist_type_invalid", "manual-hist-type-invalid", (text != "") & ~text.rlike(f"^{prefix}{_HIST}$")))
    return [F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(f.name).alias("field"), text.alias("value"))) for check, code, bad in found if config.reports(check)]


def check_fields(rows: DataFrame, layer: Layer, config: Config | None = None, feature_id: str = "id", raw: bool = True) -> DataFrame:
    """Findings of all field rules: one scan, one row per finding. It keeps no state, so it also runs on streams."""
    config = config or Config()
    checks = [r for f in layer.fields if f.column in rows.columns for r in field_rules(f, layer.name, F.col(f.column), config, raw)]
    path = F.col("source_path") if "source_path" in rows.columns else F.lit(None).cast("string")
    if not checks:
        return findings(rows.filter(F.lit(False)), "warning", "", layer.name, F.col(feature_id), "")
    broken_rules = F.filter(F.array(*checks), lambda x: x.isNotNull())
    out = rows.select(F.col(feature_id).alias("__id"), path.alias("__path"), F.inline(broken_rules))
    return findings(out, "warning", F.col("code"), layer.name, F.col("__id"), F.concat_ws(" ", "field"), before=F.create_map("field", "value"), source_path=F.col("__path"))


def check_numbers(rows: DataFrame, layer: Layer, config: Config | None = None) -> DataFrame:
    """Findings of numbers as the file's texts, before typed() gives them defaults: bad ones, and empty integers if asked for.

    An empty float stays visible to check_fields as NaN. Rows need source_path and source_row.
    """
    config = config or Config()
    plan, _ = column_plan([c for c in rows.columns if c not in _POSITION], layer)
    of = {f.name: F.col(f"`{plan[f.name]}`") for f in layer.fields if f.name in plan}
    feature = next((of[f.name] for f in layer.fields if f.column == "id" and f.name in of), F.lit(""))
    checks = [r for f in layer.fields if f.kind in ("integer", "float") and f.name in of for r in field_rules(f, layer.name, of[f.name], config, raw=True)]
    if not checks:
        return findings(rows.filter(F.lit(False)), "warning", "", layer.name, F.lit(""), "")
    integers = [f.name for f in layer.fields if f.kind == "integer"]
    out = rows.select(stripped(feature).alias("__id"), F.col("source_path").alias("__path"), F.col("source_row").alias("__row"), F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))
    # length and code rules look at typed numbers as well
    out = out.filter((F.col("code") == "manual-field-type-invalid") | ((F.col("code") == "manual-field-required-missing") & F.col("field").isin(*integers)))
    return findings(out, "warning", F.col("code"), layer.name, F.col("__id"), F.concat_ws(" ", "field", F.lit("row"), F.col("__row").cast("string")), before=F.create_map("field", "value"), source_path=F.col("__path"))


def column_plan(columns: Sequence[str], layer: Layer) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(canonical name -> column of the file; (code, column) findings).

    Names and aliases match without regard to case. Columns that differ only by case are reported and
    not renamed.
    """
    by_lower: dict[str, list[str]] = {}
    for c in columns:
        by_lower.setdefault(c.lower(), []).append(c)
    found, plan, used = [], {}, set()
    for same in by_lower.values():
        if len(same) > 1:
            found.append(("dbf-column-case-duplicate", ",".join(sorted(same))))
    for f in layer.fields:
        for name in (f.name, *f.aliases):
            hit = by_lower.get(name.lower(), [])
            exact = [c for c in hit if c == f.name]
            if len(hit) == 1 or exact:
                plan[f.name] = (exact or hit)[0]
                used.add(plan[f.name])
                break
    found += [("missing-manual-columns", n) for n in sorted(f.name for f in layer.fields if f.name not in plan)]
    found += [("unknown-manual-column", c) for c in sorted(c for c in columns if c not in used)]
    return plan, found


def typed(rows: DataFrame, layer: Layer, keep_unknown: bool = False) -> DataFrame:
    """File columns as the layer's columns: text stripped, -1 and NaN for numbers that do not parse, null for empty references."""
    plan, _ = column_plan([c for c in rows.columns if c not in _POSITION], layer)
    cells = [F.col(f"`{c}`") for c in rows.columns if c in _POSITION]
    for f in layer.fields:
        raw = F.col(f"`{plan[f.name]}`") if f.name in plan else F.lit(None).cast("string")
        text = stripped(raw)
        if f.kind == "integer":
            value = F.when(is_integer(text), F.coalesce(text.try_cast("long"), text.try_cast("double").cast("long"))).otherwise(F.lit(-1))
        elif f.kind == "float":
            value = F.coalesce(F.when(text.rlike(FLOAT), text.try_cast("double")), F.lit(float("nan")))
        else:
            value = F.nullif(text, F.lit("")) if f.targets else text
        cells.append(value.cast(f.spark_type).alias(f.column))
    if keep_unknown:
        unknown = [c for c in rows.columns if c not in plan.values() and c not in _POSITION]
        cells.append((F.create_map(*(x for c in unknown for x in (F.lit(c), F.col(f"`{c}`").cast("string")))) if unknown else F.expr("CAST(map() AS map<string,string>)")).alias("undocumented"))
    return rows.select(*cells)


_POSITION = ("ord", "section", "source_path", "source_row", "geom_kind", "coords", "holes", "parts")


def repair_text(rows: DataFrame, layer: Layer, config: Config | None = None, feature_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with misread Korean text repaired, findings): all text fields but the id; remaining broken characters are reported."""
    config = config or Config()
    columns = [f.column for f in layer.fields if f.kind in ("text", "reference") and f.column != "id" and f.column in rows.columns]
    if not columns:
        return rows, findings(rows.filter(F.lit(False)), "warning", "", layer.name, F.col(feature_id), "")
    fixed = rows.withColumns({f"__{c}": repaired(F.col(c)) for c in columns})
    parts = []
    if config.reports("text_mojibake"):
        repairs = config.repairs("text_mojibake")
        cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("old"), F.col(f"__{c}").alias("new")) for c in columns))
        changed = fixed.select(F.col(feature_id).alias("__id"), F.inline(cells)).filter("NOT (old <=> new)")
        parts.append(findings(changed, "action" if repairs else "warning", "text-mojibake-repaired" if repairs else "text-mojibake", layer.name, F.col("__id"), F.col("field"), F.create_map("field", "old"), F.create_map("field", "new")))
    out = fixed.withColumns({c: F.col(f"__{c}") for c in columns}) if config.repairs("text_mojibake") else fixed
    out = out.drop(*(f"__{c}" for c in columns))
    if config.reports("text_replacement_char"):
        cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("old")) for c in columns))
        left = out.select(F.col(feature_id).alias("__id"), F.inline(cells)).filter(broken(F.col("old")))
        parts.append(findings(left, "warning", "text-replacement-char", layer.name, F.col("__id"), F.col("field"), F.create_map("field", "old")))
    return out, union_all(parts) if parts else findings(rows.filter(F.lit(False)), "warning", "", layer.name, F.col(feature_id), "")


def summary(found: DataFrame, examples: int = 8) -> DataFrame:
    """Findings per kind, code, layer, path and reason: n, and the first ids in order.

    Ids are kept sorted and cut in partial sums, so no group is gathered whole.
    """
    keys = ["kind", "code", "layer", "source_path", "reason"]
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("feature_id").alias("n_features"))
    # the smallest ids of a group: at most `examples` per hash part, then of their union
    dealt = found.select(*keys, "feature_id").distinct().withColumn("part", F.pmod(F.xxhash64("feature_id"), F.lit(1024)))
    from pyspark.sql import Window

    near = dealt.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("feature_id"))).filter(F.col("r") <= examples)
    first = near.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("feature_id")), 1, examples).alias("examples"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond &= s
    return counts.alias("c").join(first.alias("f"), cond, "left").select(*(F.col(f"c.{k}") for k in keys), "n", "n_features", "examples").orderBy(F.desc("n"), *keys)


def totals(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))
