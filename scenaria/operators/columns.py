"""Column-wise projections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to several columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def categories_to_text(df: DataFrame) -> DataFrame:
    """Every non-numeric, non-temporal column as string."""
    keep = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.StringType)
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, keep)]
    return map_columns(df, cols, lambda c: c.cast("string")) if cols else df


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project to ``{new: old}``."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def swap(df: DataFrame, *pairs: tuple[str, str], where: Column | None = None) -> DataFrame:
    """Exchange column pairs in one projection, for all rows or where a condition holds."""
    take: dict[str, Column] = {}
    for a, b in pairs:
        ca, cb = F.col(a), F.col(b)
        take[a] = cb if where is None else F.when(where, cb).otherwise(ca)
        take[b] = ca if where is None else F.when(where, ca).otherwise(cb)
    return df.select(*[take[c].alias(c) if c in take else F.col(c) for c in df.columns])
