"""The registered queries of the catalogue and their DuckDB SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
