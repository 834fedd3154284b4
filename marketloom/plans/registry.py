"""Query catalog: name → (Spark function over a Market, SQL text or None)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import bounded_tasks
from ..sources.tables import Market
from .oracle import build

CATALOG: dict[str, tuple[Callable[[Market], DataFrame], str | None]] = {}
ABOUT: dict[str, str] = {}
#: Queries whose tasks are held to a bounded size (`bounded_tasks`).
BOUNDED: set[str] = set()


def query(name: str, sql: str | None = None, bounded: bool = False):
    def register(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = (fn, sql)
        ABOUT[name] = (fn.__doc__ or "").strip().split("\n")[0]
        if bounded:
            BOUNDED.add(name)
        return fn

    return register


def spark_queries() -> dict:
    def bind(name, fn):
        def run(spark, folder):
            m = Market(spark, folder)
            return fn(Market(bounded_tasks(spark, m.table("lineitem").count()), folder) if name in BOUNDED else m)

        return run

    return {name: bind(name, fn) for name, (fn, _) in CATALOG.items()}


def sql_texts() -> dict[str, str]:
    return {name: build(sql) for name, (_, sql) in CATALOG.items() if sql}
