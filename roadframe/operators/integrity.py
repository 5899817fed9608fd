"""References between layers: resolve, report, cascade, clear, look back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import ensure_checkpoint_dir
from .conform import findings, union_all
from ..schema import Schema


@dataclass(frozen=True)
class Edge:
    """A reference: layer.column points at a row of one of the targets; a required one decides the row's life."""

    layer: str
    column: str
    targets: tuple[str, ...]
    required: bool = False


def schema_edges(schema: Schema) -> list[Edge]:
    return [Edge(x.name, f.column, f.targets, f.required) for x in schema.layers for f in x.references]


def _references(layers: Mapping[str, DataFrame], edges: Sequence[Edge], key: str) -> DataFrame:
    """layer, id, column, rank, required, value, target_rank and target: one row per filled reference and possible target, in declared order."""
    parts = []
    for name, df in layers.items():
        own = [(rank, e) for rank, e in enumerate(edges) if e.layer == name]
        if own:
            cells = [F.struct(F.lit(e.column).alias("column"), F.lit(rank).alias("rank"), F.lit(e.required).alias("required"), F.col(e.column).cast("string").alias("value"), F.lit(i).alias("target_rank"), F.lit(t).alias("target")) for rank, e in own for i, t in enumerate(e.targets)]
            parts.append(df.select(F.lit(name).alias("layer"), F.col(key).cast("string").alias("id"), F.inline(F.array(*cells))).filter("value IS NOT NULL AND value <> ''"))
    return union_all(parts)


def _ids(layers: Mapping[str, DataFrame], key: str, edges: Sequence[Edge] | None = None) -> DataFrame:
    """target, value: the ids of all layers, or of those that the edges may point at."""
    wanted = set(layers) if edges is None else {t for e in edges for t in e.targets}
    some = {name: df for name, df in layers.items() if name in wanted} or layers
    return union_all([df.select(F.lit(name).alias("target"), F.col(key).cast("string").alias("value")) for name, df in some.items()]).distinct()


def resolved(layers: Mapping[str, DataFrame], edges: Sequence[Edge], how: str = "one", key: str = "id") -> DataFrame:
    """layer, id, column, target, target_id of every reference that resolves.

    how: "any" gives every target layer that holds the id, "one" only references that exactly one
    layer holds, "first" the first layer in declared order.
    """
    hit = _references(layers, edges, key).join(_ids(layers, key, edges), ["target", "value"])
    keys = ["layer", "id", "column", "value"]
    if how != "any":
        found = hit.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("target", "target_rank").alias("target"))
        hit = found.filter("n = 1") if how == "one" else found
    return hit.select("layer", "id", "column", "target", F.col("value").alias("target_id"))


#: Rows that one task of a join of references should hold.
TASK_ROWS = 2_000_000
#: Ids that are sent to all references instead of dealing the references anew.
SENT_ROWS = 400_000


def _sizes(layers: Mapping[str, DataFrame], edges: Sequence[Edge]) -> dict[str, int]:
    """Rows of every layer that an edge starts from or points at."""
    used = {e.layer for e in edges} | {t for e in edges for t in e.targets}
    parts = [df.select(F.lit(name).alias("layer")) for name, df in layers.items() if name in used]
    return {r["layer"]: r["n"] for r in union_all(parts).groupBy("layer").agg(F.count("*").alias("n")).collect()} if parts else {}


def _tasks(spark: SparkSession, rows: int) -> int:
    """Partitions of about TASK_ROWS rows, at least as many as the session takes, so that a task's memory does not follow the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _values(layers: Mapping[str, DataFrame], edge: Edge, key: str) -> DataFrame:
    """id, value: the filled references of one edge, a narrow row each."""
    return layers[edge.layer].select(F.col(key).cast("string").alias("id"), F.col(edge.column).cast("string").alias("value")).filter("value IS NOT NULL AND value <> ''")


def _layer_ids(layers: Mapping[str, DataFrame], name: str, key: str, column: str = "value") -> DataFrame:
    return layers[name].select(F.col(key).cast("string").alias(column))


def _joined(rows: DataFrame, other: DataFrame, on: str, how: str, n_rows: int, n_other: int) -> DataFrame:
    """rows joined with the ids of other: sent to all tasks where they are few, else both are dealt to tasks of bounded size."""
    if n_other <= SENT_ROWS:
        return rows.join(F.broadcast(other), on, how)
    n = _tasks(rows.sparkSession, n_rows + n_other)
    return rows.repartition(n, on).join(other.repartition(n, on), on, how)


def unresolved(layers: Mapping[str, DataFrame], edges: Sequence[Edge], key: str = "id") -> DataFrame:
    """layer, id, column, required, value of references that no target layer holds, and of empty required ones."""
    known = [e for e in edges if e.layer in layers]
    n, parts = _sizes(layers, known), []
    for e in known:
        rows = _values(layers, e, key)
        for t in e.targets:
            if t in layers:
                rows = _joined(rows, _layer_ids(layers, t, key), "value", "left_anti", n.get(e.layer, 0), n.get(t, 0))
        parts.append(rows.distinct().select(F.lit(e.layer).alias("layer"), "id", F.lit(e.column).alias("column"), F.lit(e.required).alias("required"), "value"))
    empty = [layers[e.layer].filter(F.col(e.column).isNull() | (F.col(e.column).cast("string") == "")).select(F.lit(e.layer).alias("layer"), F.col(key).cast("string").alias("id"), F.lit(e.column).alias("column"), F.lit(True).alias("required"), F.lit(None).cast("string").alias("value")) for e in known if e.required]
    return union_all([*parts, *empty])


def back_references(edge_rows: DataFrame) -> DataFrame:
    """target, target_id, layer, column, id, n: who points at each row, a row each, and how many of that layer and column do.

    Counts are summed before they are dealt, and no target's dependants are gathered into one row.
    """
    keys = ["target", "target_id", "layer", "column"]
    return edge_rows.join(edge_rows.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(*keys, "id", "n")


def dependants_of(edge_rows: DataFrame, target: str, target_id: str) -> DataFrame:
    """layer, column, ids (sorted): the lists of one chosen row, for a reader."""
    own = edge_rows.filter((F.col("target") == target) & (F.col("target_id") == target_id))
    return own.groupBy("layer", "column").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def with_placeholders(rows: DataFrame, targets: DataFrame, column: str, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """rows with `<column>_status`: ok, Missing, Ambiguous, or null where the reference is empty; looked up within `by`, such as the section."""
    held = targets.select(*by, F.col(key).alias(column)).groupBy(*by, column).agg(F.count("*").alias("__n"))
    status = F.when(F.col(column).isNull(), None).when(F.col("__n").isNull(), "Missing").when(F.col("__n") > 1, "Ambiguous").otherwise("ok")
    return rows.join(held, [*by, column], "left").withColumn(f"{column}_status", status).drop("__n")


#: A cascade deeper than this is taken for an error.
MAX_ROUNDS = 1_000


def _by_layer(rows: DataFrame) -> dict[str, int]:
    return {r["layer"]: r["n"] for r in rows.groupBy("layer").agg(F.count("*").alias("n")).collect()}


def _present(layers: Mapping[str, DataFrame], rows: DataFrame, name: str, key: str, n_rows: int, n_layer: int) -> DataFrame:
    """value: the ids of rows (layer, id) in one layer that the layer holds."""
    own = rows.filter(F.col("layer") == name).select(F.col("id").alias("value"))
    return _joined(_layer_ids(layers, name, key), own, "value", "left_semi", n_layer, n_rows).distinct()


def cascade(layers: Mapping[str, DataFrame], edges: Sequence[Edge], seeds: DataFrame, key: str = "id") -> DataFrame:
    """layer, id, depth, cause_layer, cause_id of every row that goes once the seeds (layer, id) go.

    A row follows when one of its required references hits a gone row and no other target layer still
    holds that id. Only the newest rows are looked at in each round, against the references that may point at them;
    rounds end when none is new.
    """
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)
    required = [(rank, e) for rank, e in enumerate(edges) if e.required and e.layer in layers]
    n = _sizes(layers, [e for _, e in required])
    several = [rank for rank, e in required if len(e.targets) > 1]
    if several:
        held = _references(layers, edges, key).filter(F.col("rank").isin(several)).select("layer", "id", "rank", "target", "value").join(_ids(layers, key, edges), ["target", "value"], "left_semi").checkpoint()
    none = F.lit(None).cast("string")
    gone = frontier = seeds.select("layer", F.col("id").cast("string").alias("id")).distinct().withColumns({"depth": F.lit(0), "cause_layer": none, "cause_id": none}).checkpoint()
    for depth in range(1, MAX_ROUNDS):
        newest = _by_layer(frontier)
        if not newest:
            return gone
        if depth > 1:
            # each round's rows are written once; gone is their union
            gone = gone.unionByName(frontier)
        parts, most = [], 0
        for rank, e in required:
            for t in e.targets:
                if t in newest and t in layers:
                    # seeds need not be rows of a layer; later rows are
                    own = _present(layers, frontier, t, key, newest[t], n.get(t, 0)) if depth == 1 else frontier.filter(F.col("layer") == t).select(F.col("id").alias("value"))
                    hit = _joined(_values(layers, e, key), own, "value", "inner", n.get(e.layer, 0), newest[t])
                    parts.append(hit.select(F.lit(e.layer).alias("layer"), "id", F.lit(rank).alias("rank"), F.lit(t).alias("target"), "value"))
                    most += n.get(e.layer, 0)
        if not parts:
            return gone
        lost = union_all(parts)
        if several:
            # another target may still hold the same id
            open_rows = lost.filter(F.col("rank").isin(several)).select("layer", "id", "rank").distinct()
            dead = gone.select(F.col("layer").alias("target"), F.col("id").alias("value"))
            alive = held.join(open_rows, ["layer", "id", "rank"], "left_semi").join(dead, ["target", "value"], "left_anti").select("layer", "id", "rank").distinct()
            lost = lost.join(alive, ["layer", "id", "rank"], "left_anti")
        least = lost.repartition(_tasks(spark, most), "layer", "id").groupBy("layer", "id").agg(F.min(F.struct("rank", "target", "value")).alias("c"))
        new = least.join(gone.select("layer", "id"), ["layer", "id"], "left_anti")
        frontier = new.select("layer", "id", F.lit(depth).alias("depth"), F.col("c.target").alias("cause_layer"), F.col("c.value").alias("cause_id")).checkpoint()
    raise RuntimeError(f"cascade not settled after {MAX_ROUNDS} rounds")


def cleared(layers: Mapping[str, DataFrame], edges: Sequence[Edge], gone: DataFrame, key: str = "id") -> DataFrame:
    """layer, id, column, value: optional references of remaining rows whose every holder is gone."""
    ensure_checkpoint_dir(gone.sparkSession)
    optional = [e for e in edges if not e.required and e.layer in layers]
    n, lost, parts = _sizes(layers, optional), _by_layer(gone), []
    for e in optional:
        targets = [t for t in e.targets if t in layers]
        dead = {t: _present(layers, gone, t, key, lost[t], n.get(t, 0)).checkpoint() for t in targets if t in lost}
        if not dead:
            continue
        own, rows = n.get(e.layer, 0), _values(layers, e, key)
        hit = union_all([_joined(rows, d, "value", "left_semi", own, lost[t]) for t, d in dead.items()]).distinct()
        if e.layer in lost:
            hit = _joined(hit, gone.filter(F.col("layer") == e.layer).select("id"), "id", "left_anti", own, lost[e.layer])
        hit = hit.checkpoint()
        n_hit = hit.count()
        # a hit row's reference stays where another target, or another row of its id, still has a holder
        held = [_joined(rows, _layer_ids(layers, t, key), "value", "left_semi", own, n.get(t, 0)) for t in targets]
        alive = union_all([_joined(h, dead[t], "value", "left_anti", own, lost[t]) if t in dead else h for t, h in zip(targets, held, strict=True)]).select("id")
        alive = _joined(alive, hit.select("id").distinct(), "id", "left_semi", own, n_hit).distinct()
        parts.append(_joined(hit, alive, "id", "left_anti", n_hit, n_hit).select(F.lit(e.layer).alias("layer"), "id", F.lit(e.column).alias("column"), "value"))
    if not parts:
        text = F.lit(None).cast("string")
        return gone.limit(0).select("layer", "id", text.alias("column"), text.alias("value"))
    return union_all(parts)


def _without_references(layers: Mapping[str, DataFrame], lost: DataFrame, key: str) -> dict[str, DataFrame]:
    """layers with the references (layer, id, column) of lost set to null; layers that lose none stay as they are."""
    out = dict(layers)
    hit = {r["layer"]: sorted(r["columns"]) for r in lost.groupBy("layer").agg(F.collect_set("column").alias("columns")).collect()}
    for name, columns in hit.items():
        df = out[name]
        own = lost.filter(F.col("layer") == name).groupBy(F.col("id").alias("__id")).agg(F.collect_set("column").alias("__lost"))
        joined = df.join(own, F.col(key).cast("string") == F.col("__id"), "left")
        out[name] = joined.withColumns({c: F.when(F.coalesce(F.array_contains("__lost", c), F.lit(False)), None).otherwise(F.col(c)).cast(df.schema[c].dataType) for c in columns}).select(*df.columns)
    return out


def remove_cascade(layers: Mapping[str, DataFrame], edges: Sequence[Edge], seeds: DataFrame, code: str, key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(layers without the gone rows and with optional references to them cleared, findings). Layers without a change are the same objects."""
    gone = cascade(layers, edges, seeds, key)
    acted = F.when(F.col("depth") == 0, F.lit(code)).otherwise(F.lit("required-reference-dependent-removed"))
    removed = findings(gone, "action", acted, F.col("layer"), F.col("id"), F.concat_ws(" ", "cause_layer", "cause_id"))
    names = {r["layer"] for r in gone.select("layer").distinct().collect()}
    if not names:
        return dict(layers), removed
    clear = cleared(layers, edges, gone, key).checkpoint()
    out = _without_references(layers, clear, key)
    for name in names & set(out):
        ids = gone.filter(F.col("layer") == name).select(F.col("id").alias("__gone"))
        out[name] = out[name].join(ids, F.col(key).cast("string") == F.col("__gone"), "left_anti")
    nulled = findings(clear, "action", "optional-dependent-reference-cleared", F.col("layer"), F.col("id"), F.col("column"), before=F.create_map("column", "value"), after=F.create_map(F.col("column"), F.lit(None).cast("string")))
    return out, removed.unionByName(nulled)


def repair_unresolved(layers: Mapping[str, DataFrame], edges: Sequence[Edge], key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(repaired layers, findings): rows with an unresolved required reference go with their dependants; optional ones are cleared."""
    ensure_checkpoint_dir(next(iter(layers.values())).sparkSession)
    lost = unresolved(layers, edges, key).checkpoint()
    optional = lost.filter("NOT required")
    nulled = findings(optional, "action", "reference-optional-unresolved-cleared", F.col("layer"), F.col("id"), F.col("column"), before=F.create_map("column", "value"))
    out = _without_references(layers, optional, key)
    out, removed = remove_cascade(out, edges, lost.filter("required").select("layer", "id").distinct(), "reference-required-unresolved-removed", key)
    return out, nulled.unionByName(removed)


def resolved_by_id(layers: Mapping[str, DataFrame], edges: Sequence[Edge], key: str = "id") -> DataFrame:
    """layer, id, column, value, target, how: the row that each filled reference means to a reader.

    how is `declared` where exactly one declared target holds the id, else `global` where exactly one layer at all
    does, else null with no target.
    """
    keys = ["layer", "id", "column", "value"]
    refs = _references(layers, edges, key).select(*keys).distinct()
    own = resolved(layers, edges, "one", key).select("layer", "id", "column", F.col("target_id").alias("value"), F.col("target").alias("own"))
    every = _ids(layers, key).groupBy("value").agg(F.count("*").alias("n"), F.min("target").alias("only")).filter("n = 1").select("value", "only")
    found = refs.join(own, keys, "left").join(every, "value", "left")
    how = F.when(F.col("own").isNotNull(), "declared").when(F.col("only").isNotNull(), "global")
    return found.select(*keys, F.coalesce("own", "only").alias("target"), how.alias("how"))
