"""The registered queries of the call-telemetry operators and their DuckDB oracles."""

from __future__ import annotations

from .queries import extras, live, records, series, totals, upkeep  # noqa: F401
from .queries.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "d1_hourly_series"
