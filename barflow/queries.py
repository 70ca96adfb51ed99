"""Registry of the library's queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from barflow.plans import indicators, modelling, monitoring, pipelines, quality, stream_rules, streams, tables

_MODULES = [indicators, stream_rules, quality, modelling, monitoring, pipelines, streams, tables]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
