"""Registration of queries with their SQL for an independent engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans.views_sql import VIEWS
from tidelog.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The statement with the definitions of the views that it uses, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                need.add(name)
                add(VIEWS[name])

    add(sql)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in need]
    head = sql.strip()
    if not parts:
        return head
    if head[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(parts)}, {head[15:]}"
    if head[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {head[5:]}"
    return f"WITH {', '.join(parts)} {head}"


def query(sql: str | None = None):
    """Register a function of Views under its name."""

    def keep(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return keep
