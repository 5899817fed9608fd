"""Field checks on streams; the checks keep no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Config
from ..operators.conform import check_fields
from ..schema import Layer


def stream_findings(rows: DataFrame, layer: Layer, config: Config | None = None) -> DataFrame:
    """Findings of a streaming layer table, for any sink in append mode."""
    return check_fields(rows, layer, config)
