"""Registered queries: a Spark plan and its DuckDB twin under one key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.workload.oracle import sql as with_tables

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None) -> Callable[[Plan], Plan]:
    """Register ``plan`` under its function name."""

    def add(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"duplicate query {plan.__name__}")
        QUERIES[plan.__name__] = Query(plan, None if sql is None else with_tables(sql), covers)
        return plan

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 4, divisor: float | None = None) -> DataFrame:
    """Round measures for comparison: double sums depend on the order of rows."""
    scale = (lambda c: F.col(c) / F.lit(divisor)) if divisor else F.col
    return df.withColumns({c: F.round(scale(c), digits) for c in cols or ("value",)})


def as_text(df: DataFrame, *cols: str) -> DataFrame:
    """Dates and timestamps as ISO text, which both engines print alike."""
    kind = dict(df.dtypes)
    fmt = {c: "yyyy-MM-dd" if kind[c] == "date" else "yyyy-MM-dd HH:mm:ss" for c in cols}
    return df.withColumns({c: F.date_format(c, f) for c, f in fmt.items()})
