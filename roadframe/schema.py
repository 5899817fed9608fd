"""Declared, versioned layer schemas.

A layer is described by one line of notation, read by layer(): fields separated by blanks, each
`Name:kind` with kind tN (text of up to N characters), i (integer) or f (decimal number), then any of
`!` required, `*` closed code list, `~Alias` other column name, `->LAYER|LAYER` reference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: A point of a geometry, and what every layer table carries beside its fields.
POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
COORDS = T.ArrayType(POINT)
POSITION = [T.StructField("ord", T.LongType()), T.StructField("section", T.StringType()), T.StructField("source_path", T.StringType()), T.StructField("source_row", T.LongType())]
GEOMETRY = [T.StructField("geom_kind", T.StringType()), T.StructField("coords", COORDS)]
#: Interior rings, which layers of polygons have.
HOLES = T.StructField("holes", T.ArrayType(COORDS))


def snake_case(name: str) -> str:
    """FromNodeID -> from_node_id, R_LinkID -> r_link_id."""
    if name.upper() == "ID":
        return "id"
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", split)
    return re.sub(r"_+", "_", split).lower()


@dataclass(frozen=True)
class Field:
    """One declared column."""

    name: str
    kind: str
    required: bool = False
    max_length: int | None = None
    codes: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        return snake_case(self.name)

    @property
    def spark_type(self) -> T.DataType:
        return {"integer": T.LongType(), "float": T.DoubleType()}.get(self.kind, T.StringType())


@dataclass(frozen=True)
class RoleFilter:
    """Rows of a role's layer with one of the values in any of the columns, or a number of at least `least`."""

    name: str
    role: str
    columns: tuple[str, ...]
    values: tuple[str, ...] = ()
    least: float | None = None


@dataclass(frozen=True)
class Layer:
    """One layer: its file, geometry kinds and fields."""

    name: str
    role: str
    kinds: tuple[str, ...]
    required: bool
    fields: tuple[Field, ...]
    files: tuple[str, ...] = ()

    @property
    def references(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.targets)

    def field_for(self, column: str) -> Field:
        return next(f for f in self.fields if f.column == column)

    def struct(self) -> T.StructType:
        """The table of this layer after typing."""
        own = [T.StructField(f.column, f.spark_type) for f in self.fields]
        return T.StructType(POSITION + own + GEOMETRY + ([HOLES] if "polygon" in self.kinds else []))


@dataclass(frozen=True)
class Schema:
    """A version: layers in load order, role filters and keys, and reciprocal references (layer, column, inverse column)."""

    version: str
    layers: tuple[Layer, ...]
    filters: tuple[RoleFilter, ...] = ()
    role_keys: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    reciprocal: tuple[tuple[str, str, str], ...] = ()
    by_name: dict[str, Layer] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {x.name: x for x in self.layers})
        for x in self.layers:
            seen = [f.column for f in x.fields]
            if len(set(seen)) != len(seen):
                raise ValueError(f"{x.name}: two fields give one column")
            for f in x.references:
                if missing := set(f.targets) - set(self.by_name):
                    raise ValueError(f"{x.name}.{f.name}: unknown target {sorted(missing)}")
        for rule in self.filters:
            for c in rule.columns:
                self.role(rule.role).field_for(c)
        for name, a, b in self.reciprocal:
            self.by_name[name].field_for(a), self.by_name[name].field_for(b)

    def role(self, role: str) -> Layer:
        """The one layer of a role; an error for none or several."""
        found = [x for x in self.layers if x.role == role]
        if len(found) != 1:
            raise ValueError(f"role {role!r} has {len(found)} layers")
        return found[0]

    def files(self) -> dict[str, tuple[str, bool]]:
        """Upper-case file name -> (layer, whether it is an alias)."""
        return {f.upper(): (x.name, i > 0) for x in self.layers for i, f in enumerate(x.files)}


_FIELD = re.compile(r"(?P<name>\w+):(?P<kind>t\d+|i|f)(?P<required>!?)(?P<coded>\*?)(?P<rest>\S*)$")


def parse_fields(notation: str, codes: dict[str, str]) -> tuple[Field, ...]:
    found = []
    for part in notation.split():
        m = _FIELD.match(part)
        if m is None:
            raise ValueError(f"cannot read field {part!r}")
        rest, _, targets = m["rest"].partition("->")
        head, *more = targets.split("~")
        aliases = [a for a in rest.split("~") if a] + more
        kind = "text" if m["kind"][0] == "t" else "integer" if m["kind"] == "i" else "float"
        keys = tuple(codes[m["name"]].split()) if m["coded"] else ()
        found.append(Field(m["name"], "reference" if head else kind, bool(m["required"]), int(m["kind"][1:]) if kind == "text" else None, keys, tuple(aliases), tuple(head.split("|")) if head else ()))
    return tuple(found)


def layer(name: str, kinds: str, role: str, common: str, own: str, codes: dict[str, str] | None = None, *, required: bool = False, aliases: tuple[str, ...] = ()) -> Layer:
    kind = {"P": "point", "L": "line", "G": "polygon"}
    return Layer(name, role, tuple(kind[k] for k in kinds), required, parse_fields(f"{common} {own}", codes or {}), tuple(f"{n}.shp" for n in (name, *aliases)))
