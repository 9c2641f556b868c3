"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "snapshot_value_counts"


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}" + "::DOUBLE" * isinstance(v, float)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


from . import q_detectors, q_evaluation, q_foreign_keys, q_joins, q_metrics, q_profile, q_snapshot, q_sources, q_structure  # noqa: E402, F401
