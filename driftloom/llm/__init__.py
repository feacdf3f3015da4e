"""Corpus operators for training data: thirteen operators and the queries that apply them.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import importlib

_MODULES = ("langid", "bpe", "quality_rules", "simhash", "near_copies", "decontaminate", "pii", "quality_classifier", "html_text", "sharding", "suffix_dedup", "neighbours", "lexical", "whitening")


def _loaded():
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict:
    """opN_<name> -> callable(spark, sf_dir)."""
    return {k: q for m in _loaded() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """opN_<name> -> DuckDB SQL, where SQL can express the operator."""
    return {k: q for m in _loaded() for k, q in m.ORACLES.items()}
