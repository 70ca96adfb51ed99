"""The queries of the numbered operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from barflow.llm import decontamination, fixity, langid, language_model, mixing, near_dedup, packing, pseudonyms, quality_model, quality_rules, repair, secrets, spelling

_MODULES = [fixity, mixing, langid, language_model, pseudonyms, secrets, quality_model, decontamination, near_dedup, quality_rules, packing, spelling, repair]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
