"""Grouped aggregates, totals and allocations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.functions import discount_factor, strict_sum, symmetric_limit


def grouped_sum(df: DataFrame, keys: Sequence[str], value: str = "value", strict: bool = True, out: str | None = None) -> DataFrame:
    agg = strict_sum(value) if strict else F.sum(value)
    return df.groupBy(*keys).agg(agg.alias(out or value))


def grouped_mean(df: DataFrame, keys: Sequence[str], value: str = "value", out: str | None = None) -> DataFrame:
    c = F.col(value)
    mean = F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
    return df.groupBy(*keys).agg(mean.alias(out or value))


def collapse(df: DataFrame, col: str, label: Column, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Relabel a category and sum again over the coarser categories."""
    return grouped_sum(df.withColumn(col, label), keys, value)


def with_totals(
    df: DataFrame,
    keys: Sequence[str],
    member: str | Sequence[str],
    label: str = "Total",
    value: str = "value",
) -> DataFrame:
    """Members and their total in one table.

    The rows are reduced to one per (keys, member) first, so the row expansion
    of the grouping sets only touches the small aggregate. ``member`` columns
    hold ``label`` in total rows; a NULL member stays NULL and is not mistaken
    for the total.
    """
    members = [member] if isinstance(member, str) else list(member)
    keys = list(keys)
    fine = df.groupBy(*keys, *members).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"), F.count(F.lit(1)).alias("__all"))
    sets = fine.groupingSets([[*keys, *members], keys], *keys, *members)
    out = sets.agg(
        F.grouping_id().alias("__g"),
        F.when(F.sum("__n") == F.sum("__all"), F.sum("__s")).alias(value),
    )
    return out.select(
        *keys,
        *[F.when(F.col("__g") == 0, F.col(m)).otherwise(F.lit(label)).alias(m) for m in members],
        value,
    )


def with_weighted_totals(
    df: DataFrame,
    keys: Sequence[str],
    member: str,
    x: str,
    w: str,
    label: str = "Total",
    out: str = "value",
) -> DataFrame:
    """Weighted mean per member and over all members. Numerator and denominator
    are carried up; means are never averaged."""
    keys, wx = list(keys), F.col(w) * F.col(x)
    fine = df.groupBy(*keys, member).agg(
        F.sum(wx).alias("__num"),
        F.sum(w).alias("__den"),
        (F.count(F.lit(1)) - F.count(wx)).alias("__nul_x"),
        (F.count(F.lit(1)) - F.count(w)).alias("__nul_w"),
    )
    sets = fine.groupingSets([[*keys, member], keys], *keys, member)
    res = sets.agg(
        F.grouping_id().alias("__g"),
        F.when(
            (F.sum("__nul_x") == 0) & (F.sum("__nul_w") == 0),
            F.try_divide(F.sum("__num"), F.sum("__den")),
        ).alias(out),
    )
    return res.select(*keys, F.when(F.col("__g") == 0, F.col(member)).otherwise(F.lit(label)).alias(member), out)


def discounted_sum(df: DataFrame, keys: Sequence[str], value: str = "value", year: str = "YEAR", base: int = 2020, rate: float = 0.05, scale: float = 1.0) -> DataFrame:
    """Present value: ``sum(value * (1-rate)^(year-base)) * scale``."""
    pv = strict_sum(F.col(value) * discount_factor(year, base, rate)) * F.lit(scale)
    return df.groupBy(*keys).agg(pv.alias(value))


def allocate_to_ends(df: DataFrame, shared: Column, keys: Sequence[str], n0: str = "N0", n1: str = "N1", value: str = "value", out: str = "N") -> DataFrame:
    """Charge a link's value to its nodes: half to each end where ``shared``,
    all of it to the first end otherwise. One pass, one shuffle."""
    half = F.col(value) / 2
    ends = F.when(
        shared,
        F.array(F.struct(F.col(n0).alias("n"), half.alias("v")), F.struct(F.col(n1).alias("n"), half.alias("v"))),
    ).when(
        ~shared,
        F.array(F.struct(F.col(n0).alias("n"), F.col(value).alias("v"))),
    )
    rows = df.select(*keys, F.explode(ends).alias("__e"))
    return rows.groupBy(F.col("__e.n").alias(out), *keys).agg(strict_sum("__e.v").alias(value))


def extents(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Minimum, maximum and the symmetric limit of a measure."""
    aggs = [F.min(value).alias("lo"), F.max(value).alias("hi"), symmetric_limit(value).alias("limit")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def is_unused(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: is the column NULL everywhere?"""
    return df.agg(*[F.bool_and(F.col(c).isNull()).alias(c) for c in cols])


def decade_sum(df: DataFrame, keys: Sequence[str], value: str = "value", year: str = "YEAR", first: int = 2021, last: int = 2050, out: str = "Y10") -> DataFrame:
    """Sum per decade ``first..first+9``; labels are ``2021-30`` and so on."""
    start = (F.floor((F.col(year) - F.lit(first)) / 10) * 10 + F.lit(first)).cast("int")
    label = F.concat(start.cast("string"), F.lit("-"), F.substring((start + 9).cast("string"), 3, 2))
    rows = df.filter(F.col(year).between(first, last)).withColumn(out, label)
    return rows.groupBy(*keys, out).agg(strict_sum(value).alias(value))
