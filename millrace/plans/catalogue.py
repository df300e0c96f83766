"""Every query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import aggregates, functions, graphs, joins, metrics, policies, records, sequences, telemetry

MODULES = (aggregates, sequences, joins, functions, graphs, metrics, telemetry, records, policies)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
