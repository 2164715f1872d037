"""The query registry: a name, a plan over (spark, sf_dir), and the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """sql with the views it names, and those they name, as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name in text and name not in need:
                add(body)
                need.append(name)

    add(sql)
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in need)
    if not views:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    """Register f(views) under name."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = _with_views(sql)
        return f

    return put
