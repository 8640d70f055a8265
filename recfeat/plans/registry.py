"""All registered queries of the recommendation pipeline and their SQL."""

from __future__ import annotations

from . import evaluation, features, files

_ALL = features.QUERIES | files.QUERIES | evaluation.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
