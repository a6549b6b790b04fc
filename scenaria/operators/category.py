"""Ordered categories and dimension attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.operators.joins import natural_join
from scenaria.sources.inline import inline_table, sql_literal


def category_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in the level list; NULL outside of it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.array_position(F.expr("array(" + ", ".join(sql_literal(x) for x in levels) + ")"), c), F.lit(0)).cast("int")


def as_category(df: DataFrame, col: str, levels: Sequence[str], ord_col: str | None = None, reverse: bool = False) -> DataFrame:
    """Close the domain of a column: values outside become NULL. ``ord_col``
    adds the position for ordering the output."""
    levels = list(reversed(levels)) if reverse else list(levels)
    rank = category_rank(col, levels)
    if ord_col:
        df = df.withColumn(ord_col, rank)
    return df.withColumn(col, F.when(rank.isNotNull(), F.col(col)))


def attach_dimension(df: DataFrame, dimension: DataFrame | Sequence[Sequence], key: str) -> DataFrame:
    """Add legend, colour and display order of a variable dimension.

    ``dimension`` is a table or a literal list of (Variable, Legend, Color).
    """
    if not isinstance(dimension, DataFrame):
        rows = [(r[0], r[1], r[2], i + 1) for i, r in enumerate(dimension)]
        dimension = inline_table(df.sparkSession, f"{key} string, legend string, color string, ord int", rows)
    return natural_join(df, dimension, "left", on=[key])


def with_scenario_category(df: DataFrame, scenarios: DataFrame, key: str = "Sc") -> DataFrame:
    """Add ``cat1``/``cat2`` of the scenario matrix. A scenario that the matrix
    does not name keeps its rows but loses its label, as a value outside of a
    closed category domain does."""
    cat = scenarios.select(
        F.col("Scenario").alias("__sc"),
        F.col("scen_dpol").alias("cat1"),
        F.col("scen_tpol").alias("cat2"),
    )
    out = df.join(cat, F.col(key) == F.col("__sc"), "left")
    return out.withColumn(key, F.col("__sc")).drop("__sc")


def classify(df: DataFrame, col: str, rules: Mapping[str, Column]) -> DataFrame:
    """Ordered conditional labels; NULL where nothing applies."""
    out = None
    for label, cond in rules.items():
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return df.withColumn(col, out)


def display_order(df: DataFrame, *by: str, descending: bool = False) -> DataFrame:
    """Sort an output table, e.g. by its category positions. Only for results
    that are shown or written in order: it is a full sort."""
    cols = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in by]
    return df.orderBy(*cols)
