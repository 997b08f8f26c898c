"""The queries of this subpackage and, where SQL can express them, the SQL of their results."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ann", "katz", "toxicity", "jaccard", "neardup", "suffixes", "bpe", "licenses", "warc", "packing")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"leafgraph.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"leafgraph.llm.{m}"), "ORACLE", {}).items()}
