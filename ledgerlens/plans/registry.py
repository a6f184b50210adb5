"""The queries of the analytics engine and their SQL."""

from __future__ import annotations

from . import analyse, prepare, series, streams

ALL = prepare.QUERIES | analyse.QUERIES | series.QUERIES | streams.QUERIES
NO_SQL = analyse.NO_SQL | series.NO_SQL


def queries() -> dict:
    return dict(ALL)


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in ALL.items() if k not in NO_SQL}
