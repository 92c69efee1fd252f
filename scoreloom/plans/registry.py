"""Named queries over the given tables, each with the SQL that a second engine can check it with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans.fixtures import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the derived views it names, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in SQL_VIEWS and name not in needed:
                visit(SQL_VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} as ({SQL_VIEWS[name]})" for name in needed)
    return f"with {views} select * from ({sql}) __q"


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return build

    return register
