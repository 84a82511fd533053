"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name -> module; each has ``query(spark, sf_dir)`` and perhaps ``SQL``.
QUERIES = {
    "op3_decontamination": "decontaminate",
    "op4_mixing": "mixing",
    "op6_quality_rules": "quality_rules",
    "op1_lm_scoring": "lm_scoring",
    "op2_language_id": "language_id",
    "op5_license_scan": "licenses",
    "op7_substring_dedup": "substring_dedup",
    "op8_url_filters": "url_filters",
    "op9_quality_classifier": "quality_classifier",
    "op10_jaccard_join": "jaccard_join",
}


def _modules() -> dict:
    return {name: import_module(f"siltstone.llm.{m}") for name, m in QUERIES.items()}


def queries() -> dict:
    return {name: m.query for name, m in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _modules().items() if hasattr(m, "SQL")}
