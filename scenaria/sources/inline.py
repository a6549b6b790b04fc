"""Literal tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longer (and empty) literal tables enter the plan as an Arrow table instead of SQL text, with the same result.
MAX_SQL_ROWS = 1_000


def sql_literal(v: object) -> str:
    """A Python scalar as SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A literal table as part of the plan.

    It becomes a ``LocalRelation``: Spark knows its exact size (so it is joined
    by broadcast without a hint) and can fold it at planning time.
    """
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    if not rows or len(rows) > MAX_SQL_ROWS:
        text = [[None if r[k] is None else str(r[k]) for r in rows] for k in range(len(fields))]
        table = pa.table([pa.array(c, pa.string()) for c in text], [n for n, _ in fields])
        return spark.createDataFrame(table).select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in fields])
    names = ", ".join(f"`{n}`" for n, _ in fields)
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def variable_table(spark: SparkSession, variables: Sequence[Sequence[str]], outflows: Sequence[str] = ()) -> DataFrame:
    """A variable dimension with display order and outflow flag."""
    rows = [(*v, i + 1, v[0] in set(outflows)) for i, v in enumerate(variables)]
    return inline_table(
        spark, "Variable string, Legend string, Color string, ord int, is_outflow boolean", rows
    )
