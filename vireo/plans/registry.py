"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from . import evaluation, models, neighbors, ratings, responses, scans

_MODULES = [evaluation, ratings, neighbors, responses, models, scans]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
