"""Registered queries and their SQL equivalents.

``adapters`` are small tables derived from the given ones, in SQL that Spark and DuckDB both read, so a query and its equivalent start
from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ADAPTERS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "a2_outage_hours"


def adapter(name: str, sql: str) -> None:
    ADAPTERS[name] = sql


class Data:
    """Tables and adapters of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in ADAPTERS:
            sql = ADAPTERS[name]
            used = {w: getattr(self, w) for w in uses(sql)}
            return self.spark.sql(re.sub(r"\b(" + "|".join(used) + r")\b(?!\.)(?=[\s,)]|$)", r"{\1}", sql), **used)
        raise AttributeError(name)


def uses(sql: str) -> list[str]:
    """Tables and adapters that stand after FROM or JOIN."""
    return list(dict.fromkeys(w for w in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql) if w in TABLES or w in ADAPTERS))


def with_adapters(sql: str) -> str:
    """The SQL with the adapters that it uses as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for w in uses(text):
            if w in ADAPTERS and w not in order:
                add(ADAPTERS[w])
                order.append(w)

    add(sql)
    if not order:
        return sql
    head = ",\n".join(f"{w} AS ({ADAPTERS[w]})" for w in order)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^WITH(\s+RECURSIVE)?\s+", "", body)
        return f"WITH {'RECURSIVE ' * recursive}{head},\n{body}"
    return f"WITH {head}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register a function of ``Data`` under ``name``, with equivalent SQL if there is any."""

    def register(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if oracle:
            ORACLE[name] = with_adapters(oracle)
        return fn

    return register
