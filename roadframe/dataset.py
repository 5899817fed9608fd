"""A whole map: its layers, the ordered repair steps, and segmentation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import incremental, integrity, sections, segment, topology
from .operators.components import ensure_checkpoint_dir
from .operators.conform import check_fields, findings, repair_text, union_all
from .operators.merge import collisions, global_ids, merge_layer
from .schema import Schema
from .sources.shapefile import load_layers

#: Columns of links and nodes as the topology operators name them.
LINK = {"from_node_id": "from_id", "to_node_id": "to_id", "r_link_id": "r_id", "l_link_id": "l_id"}


@dataclass(frozen=True)
class MapDataset:
    """Layer tables of one version; absent names those known to be empty, by_section tells that keys carry their section."""

    schema: Schema
    layers: dict[str, DataFrame]
    absent: frozenset[str] = frozenset()
    by_section: bool = False

    def with_layer(self, name: str, df: DataFrame) -> MapDataset:
        return replace(self, layers=self.layers | {name: df})

    def links(self) -> DataFrame:
        df = self.layers[self.schema.role("link").name]
        return df.withColumnsRenamed({k: v for k, v in LINK.items() if k in df.columns})

    def with_links(self, links: DataFrame) -> MapDataset:
        return self.with_layer(self.schema.role("link").name, links.withColumnsRenamed({v: k for k, v in LINK.items()}))

    def nodes(self) -> DataFrame:
        df = self.layers[self.schema.role("node").name]
        p = F.try_element_at("coords", F.lit(1))
        group = F.col("group_id") if "group_id" in df.columns else F.lit(None).cast("string")
        return df.withColumns({c: p[c] for c in "xyz"}).withColumn("group_key", group)


Step = Callable[[MapDataset, Config], tuple[MapDataset, DataFrame]]


def _none(ds: MapDataset) -> DataFrame:
    links = ds.links()
    return findings(links.filter(F.lit(False)), "warning", "", "", F.col("id"), "")


def _remove(ds: MapDataset, config: Config, check: str, code: str, layer: str, ids: DataFrame) -> tuple[MapDataset, DataFrame]:
    """Remove the ids with their dependants, or only report them."""
    if not config.repairs(check):
        return ds, findings(ids, "warning", code, layer, F.col("id"), "")
    layers, found = integrity.remove_cascade(ds.layers, integrity.schema_edges(ds.schema), ids.select(F.lit(layer).alias("layer"), "id"), f"{code}-removed")
    return replace(ds, layers=layers), found


def _update(ds: MapDataset, config: Config, check: str, changed: tuple[DataFrame, DataFrame]) -> tuple[MapDataset, DataFrame]:
    """Take over changed links, or report the changes as warnings."""
    links, found = changed
    if config.repairs(check):
        return ds.with_links(links), found
    plain = F.regexp_replace("code", "-(assigned|cleared|redirected|repaired|filled)$", "")
    return ds, found.withColumns({"kind": F.lit("warning"), "code": plain})


def short_links(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    return _remove(ds, config, "link_too_short", "link-too-short", ds.schema.role("link").name, topology.too_short(ds.links(), config.link_min_length_m))


def isolated_links(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    return _remove(ds, config, "link_endpoint_isolated", "link-endpoint-isolated", ds.schema.role("link").name, topology.isolated_links(ds.links(), ds.nodes()))


def endpoints(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    return _update(ds, config, "link_endpoint_unresolved", topology.assign_endpoints(ds.links(), ds.nodes(), config.node_match_tolerance_m, ds.schema.role("link").name, ds.by_section))


def longitudinal(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    return _update(ds, config, "link_side_reference_longitudinal", topology.clear_longitudinal(ds.links(), ds.schema.role("link").name))


def nonreciprocal(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    return _update(ds, config, "link_side_reference_nonreciprocal", topology.redirect_nonreciprocal(ds.links(), ds.schema.role("link").name))


def orientation(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    links, nodes = ds.links(), ds.nodes()
    judged = topology.orientation(links, nodes, topology.orientation_groups(links, nodes), config.node_match_tolerance_m)
    oriented, found = topology.orient(links, judged, ds.schema.role("link").name)
    if not config.reports("link_endpoint_misaligned"):
        found = found.filter("code <> 'link-endpoint-misaligned'")
    return _update(ds, config, "link_orientation_reversed", (oriented, found))


def unused_nodes(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    return _remove(ds, config, "node_unreferenced", "node-unreferenced", ds.schema.role("node").name, topology.unreferenced_nodes(ds.nodes(), ds.links()))


def references(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    edges = integrity.schema_edges(ds.schema)
    if config.repairs("reference_unresolved"):
        layers, found = integrity.repair_unresolved(ds.layers, edges)
        return replace(ds, layers=layers), found
    lost = integrity.unresolved(ds.layers, edges)
    return ds, findings(lost, "warning", "reference-unresolved", F.col("layer"), F.col("id"), F.col("column"))


def reciprocals(ds: MapDataset, config: Config) -> tuple[MapDataset, DataFrame]:
    parts = [_none(ds)]
    for name, column, inverse in ds.schema.reciprocal:
        rows, found = topology.fill_reciprocal(ds.layers[name], [(column, inverse)], name)
        parts.append(found if config.reports("reciprocal_reference_conflict") else found.filter("code <> 'reciprocal-reference-conflict'"))
        if config.repairs("reciprocal_reference_missing"):
            ds = ds.with_layer(name, rows)
    return ds, union_all(parts)


#: The checks that govern the steps, in the order in which the steps run.
STEPS: tuple[tuple[str, Step], ...] = (
    ("link_too_short", short_links),
    ("link_endpoint_isolated", isolated_links),
    ("link_endpoint_unresolved", endpoints),
    ("reference_unresolved", references),
    ("link_side_reference_longitudinal", longitudinal),
    ("link_side_reference_nonreciprocal", nonreciprocal),
    ("link_orientation_reversed", orientation),
    ("node_unreferenced", unused_nodes),
    ("reciprocal_reference_missing", reciprocals),
)


def _settled(ds: MapDataset, before: MapDataset | None = None) -> MapDataset:
    """Cut the lineage of the layers that changed, since each step rewrites keys that the next joins on."""
    same = {} if before is None else before.layers
    return replace(ds, layers={k: v if v is same.get(k) or k in ds.absent else v.checkpoint() for k, v in ds.layers.items()})


def repair(ds: MapDataset, config: Config | None = None, steps: Sequence[tuple[str, Step]] = STEPS) -> tuple[MapDataset, DataFrame]:
    """Run the switched-on steps in order; each sees the previous one's result. A step without an action changes nothing."""
    config = config or Config()
    ensure_checkpoint_dir(next(iter(ds.layers.values())).sparkSession)
    parts = [_none(ds)]
    for check, step in steps:
        if config.reports(check):
            after, found = step(ds, config)
            found = found.checkpoint()
            parts.append(found)
            if not found.filter("kind = 'action'").isEmpty():
                ds = _settled(after, ds)
    return ds, union_all(parts)


def remaining(ds: MapDataset, config: Config | None = None) -> DataFrame:
    """References that are still unresolved after the repairs; asked for only where references are repaired."""
    config = config or Config()
    if not config.repairs("reference_unresolved"):
        return _none(ds)
    lost = integrity.unresolved(ds.layers, integrity.schema_edges(ds.schema))
    return findings(lost, "warning", "reference-unresolved", F.col("layer"), F.col("id"), F.col("column"))


def prepare(ds: MapDataset, config: Config | None = None) -> tuple[MapDataset, DataFrame]:
    """Merge each layer's rows by id, find ids shared by layers, repair texts and check fields."""
    config = config or Config()
    parts, layers = [_none(ds)], dict(ds.layers)
    for layer in ds.schema.layers:
        if layer.name in ds.absent:
            continue
        rows, merged = merge_layer(ds.layers[layer.name], layer.name, config=config)
        rows, texts = repair_text(rows, layer, config)
        # rules look at keys as they were delivered
        own = rows.withColumn("__own", F.col("id"))
        own = sections.local(own, sections.keys_of(layer, ds.schema)) if ds.by_section else own
        parts += [merged, texts, check_fields(own, layer, config, feature_id="__own", raw=False)]
        layers[layer.name] = rows
    if config.reports("global_id_collision"):
        parts.append(collisions(global_ids(layers)))
    return replace(ds, layers=layers), union_all(parts)


def load_map(spark: SparkSession, root: str, coordinate: str, config: Config | None = None, keep_unknown: bool = False, by_section: bool = False) -> tuple[MapDataset, DataFrame]:
    """Read, merge, check and repair one coordinate product of a delivery.

    by_section keeps its sections apart: ids, references and group keys carry the section (see operators.sections), in
    the dataset, in findings and in what segmented() makes of it; delivered() gives the layers under their own ids.
    """
    ensure_checkpoint_dir(spark)
    schema, layers, read = load_layers(spark, root, coordinate, config, keep_unknown=keep_unknown)
    if by_section:
        layers = sections.qualified_layers(layers, schema)
    absent = frozenset(n for n, df in layers.items() if df.isEmpty())
    ds, checked = prepare(MapDataset(schema, layers, absent, by_section), config)
    ds, repaired = repair(_settled(ds), config)
    return ds, union_all([read.checkpoint(), checked.checkpoint(), repaired, remaining(ds, config).checkpoint()])


def delivered(ds: MapDataset) -> dict[str, DataFrame]:
    """The layers of a dataset that was loaded by section, under the ids of their files."""
    return sections.local_layers(ds.layers, ds.schema)


def _segmented(ds: MapDataset, config: Config | None, only: DataFrame | None = None) -> dict[str, DataFrame]:
    marker = ds.schema.role("lane_line")
    rule = next(r for r in ds.schema.filters if r.name == "uturn_marker")
    links = segment.classified(ds.layers[ds.schema.role("link").name], ds.schema).withColumnsRenamed(LINK)
    if "lane_no" not in links.columns:
        links = links.withColumn("lane_no", F.lit(None).cast("long"))
    declared = not links.filter("is_uturn").isEmpty()
    parts = [links, ds.nodes(), ds.layers[marker.name].filter(segment.matches(rule))]
    if only is not None:
        parts = [incremental.within(df, only) for df in parts]
    return segment.segment(*parts, config, ds.by_section, declared)


def segmented(ds: MapDataset, config: Config | None = None) -> dict[str, DataFrame]:
    """All segmentation stages of a dataset; call again after edits."""
    return _segmented(ds, config)


def resegmented(ds: MapDataset, stages: dict[str, DataFrame], edited: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """The stages of a dataset after edits, from those before them: only sections with an edited row are computed again.

    ds was loaded by section and has the edits; edited has the ids of the rows that they changed. Rows keep their ord,
    so the result is that of segmented(), numbers included.
    """
    if not ds.by_section:
        raise ValueError("only a dataset that was loaded by section falls into parts")
    links = ds.layers[ds.schema.role("link").name]
    declared = not segment.classified(links, ds.schema).filter("is_uturn").isEmpty()
    if "uturns" in stages and declared != (not stages["uturns"].filter("size(markers) = 0").isEmpty()):
        # the first declared U-turn, or the loss of the last, concerns all sections
        return segmented(ds, config)
    dirty = incremental.sections_of(edited)
    fresh = _segmented(ds, config, dirty)
    return incremental.merged(stages, fresh, dirty, links)
