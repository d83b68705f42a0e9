"""Registry of runnable queries and, where SQL can say the same, their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from showgrid.plans.bind import DUCK_DEPENDENCIES, Tables, duck_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL that is too slow on whole tables of size; the tests run it on the smallest ones.
SMALL_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, small: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional equivalent SQL text."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            (SMALL_ORACLES if small else ORACLES)[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix the view definitions that ``sql`` mentions (F, S, W, L, Q, SC)."""
    views = duck_views()
    needed = [v for v in views if re.search(rf"(?<![\w.']){v}(?![\w.'(])", sql)]
    for v in list(needed):
        needed = DUCK_DEPENDENCIES.get(v, []) + needed
    ordered = [v for v in views if v in needed]
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{v} as ({views[v]})" for v in ordered)
    body = sql.strip()
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        return f"with {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"with {ctes}\n{body}"


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name](Tables(spark, folder))
