"""Options: the mode of each check, and thresholds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

#: Every check with its default mode.
DEFAULT_MODES = {
    "layer_required_missing": "warn",
    "layer_unknown": "warn",
    "shp_sidecar_missing": "warn",
    "dbf_column_case_duplicate": "warn",
    "manual_column_missing": "warn",
    "manual_column_unknown": "warn",
    "manual_field_required_missing": "warn",
    "manual_field_length_exceeded": "warn",
    "manual_field_type_invalid": "warn",
    "manual_field_code_invalid": "warn",
    "manual_hist_type_invalid": "warn",
    "geometry_missing": "warn",
    "geometry_invalid": "warn",
    "text_utf8_dbf_row_mismatch": "warn",
    "text_utf8_decode_replacement": "warn",
    "text_mojibake": "repair",
    "text_replacement_char": "warn",
    "feature_id_missing": "warn",
    "feature_id_duplicate_identical": "warn",
    "feature_id_duplicate_conflicting": "repair",
    "global_id_collision": "warn",
    "reference_unresolved": "repair",
    "reciprocal_reference_missing": "repair",
    "reciprocal_reference_conflict": "warn",
    "link_too_short": "repair",
    "link_endpoint_isolated": "repair",
    "link_endpoint_unresolved": "repair",
    "link_endpoint_misaligned": "warn",
    "link_orientation_reversed": "repair",
    "node_unreferenced": "repair",
    "link_side_reference_longitudinal": "repair",
    "link_side_reference_nonreciprocal": "repair",
}
#: Checks that know no repair: those whose default only warns.
WARN_ONLY = frozenset(name for name, mode in DEFAULT_MODES.items() if mode == "warn")
STAGES = ("uturns", "lateral_groups", "node_groups", "junctions", "connections", "references", "edges")


@dataclass(frozen=True)
class Config:
    """Modes are "off", "warn" or "repair"; a mapping given for modes overrides the defaults by name."""

    modes: Mapping[str, str | None] = field(default_factory=dict)
    node_match_tolerance_m: float = 0.5
    link_min_length_m: float = 0.2
    multipart_snap_tolerance_m: float = 0.1
    utf8_invalid_ratio_max: float = 0.5
    z_intersection_tol_m: float = 1.0
    merge_distance_m: float = 15.0
    opposite_dot_min: float = 0.85
    tangent_lookback_m: float = 1.0
    stages: tuple[str, ...] = STAGES
    report_required_numbers: bool = False

    def __post_init__(self) -> None:
        if unknown := set(self.modes) - set(DEFAULT_MODES):
            raise ValueError(f"unknown checks: {sorted(unknown)}")
        for name, mode in self.modes.items():
            if mode not in (None, "off", "warn", "repair"):
                raise ValueError(f"{name}: mode {mode!r}")
            if mode == "repair" and name in WARN_ONLY:
                raise ValueError(f"{name} can only warn")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.endswith("_m") and value < 0 or f.name in ("tangent_lookback_m", "merge_distance_m") and value <= 0:
                raise ValueError(f"{f.name} = {value}")
        if not 0 <= self.utf8_invalid_ratio_max <= 1 or not -1 <= self.opposite_dot_min <= 1:
            raise ValueError("ratio out of range")
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"unknown stages: {sorted(unknown)}")

    def mode(self, name: str) -> str:
        return self.modes.get(name, DEFAULT_MODES[name]) or "off"

    def reports(self, name: str) -> bool:
        return self.mode(name) != "off"

    def repairs(self, name: str) -> bool:
        return self.mode(name) == "repair"
