"""Registry of named queries and of the SQL each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from hoopflow.plans import views
from hoopflow.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = dict(views.oracle_ctes())

_WORD = re.compile(r"\b[A-Za-z_]\w*\b")


class Source:
    """Hands views of one scale directory to a query: ``src("fx_tracking")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return views.spark_view(self.spark, self.sf_dir, name, lambda: self.tasks)

    @cached_property
    def tasks(self) -> int:
        return views.event_tasks(self.spark, self.sf_dir)


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix the named sub-queries that ``sql`` mentions, dependencies first."""
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for w in _WORD.findall(text):
            if w in CTES and w not in order and w not in open_:
                open_.add(w)
                visit(CTES[w])
                if w not in order:
                    order.append(w)

    visit(sql)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Source], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(Source(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return wrap


def R(expr: str) -> str:
    """Oracle text of the 4-digit rounding used by ``geometry.r4``."""
    return f"(floor(({expr})*10000 + 0.5e0)/10000)"
