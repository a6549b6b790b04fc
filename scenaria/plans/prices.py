"""Marginal electricity prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import detect, first_match, recode, weighted_mean
from scenaria.operators import duration_curve, natural_join, with_weighted_totals

EXACT_COUNTRY_OF_NODE = [("KR", "KOR"), ("MN", "MNG")]


def price_table(price: DataFrame, demand: DataFrame, buses: Sequence[str] = ("AC", "AC2"), demand_bus: str = "AC2") -> DataFrame:
    """Price and demand per scenario, node, bus and slice.

    Both buses are read in one scan and weighted with the same demand; this is
    the one join of two fact tables, on (Sc, N, T).
    """
    p = price.filter((F.col("MT") != "ANN") & F.col("I").isin(list(buses)))
    p = p.select("Sc", "N", F.col("MT").alias("T"), "I", F.col("value").alias("price"))
    d = demand.filter(F.col("I") == demand_bus).select("Sc", "N", F.col("MT").alias("T"), F.col("value").alias("dmd"))
    return natural_join(p, d, on=["Sc", "N", "T"])


def slice_price(table: DataFrame, labels: Mapping[str, str], node_pattern: str = "JP-") -> DataFrame:
    """Demand-weighted price per slice of one country."""
    rows = table.filter(detect("N", node_pattern))
    out = rows.groupBy("Sc", "I", "T").agg(weighted_mean("price", "dmd").alias("value"))
    return out.withColumn("Sc", recode("Sc", labels))


def country_price(table: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Demand-weighted price per country and overall. Single-node countries are
    matched by their whole name."""
    country = F.coalesce(
        first_match("N", vocab.COUNTRY_OF_NODE[:2]),
        first_match("N", EXACT_COUNTRY_OF_NODE, exact=True),
    )
    rows = table.withColumn("Sr", country)
    out = with_weighted_totals(rows, ["Sc", "I"], "Sr", "price", "dmd")
    return out.withColumn("Sc", recode("Sc", labels))


def node_price(table: DataFrame, labels: Mapping[str, str], node_pattern: str = "JP-", bus: str = "AC") -> DataFrame:
    rows = table.filter(detect("N", node_pattern) & (F.col("I") == bus))
    out = rows.groupBy("Sc", F.col("N").alias("Sr")).agg(weighted_mean("price", "dmd").alias("value"))
    return out.withColumn("Sc", recode("Sc", labels))


def price_curve(slice_prices: DataFrame, bus: str = "AC") -> DataFrame:
    """Price-duration curve; equal prices keep slice order."""
    rows = slice_prices.filter(F.col("I") == bus).withColumnRenamed("T", "St")
    return duration_curve(rows, ["Sc", "I"], "value", ["St"]).select("Sc", "I", "T", "St", "value")


def with_policy_facets(df: DataFrame, key: str = "Sc") -> DataFrame:
    """Budget and grid facet from the scenario label, first match wins."""
    cpol = first_match(key, [("500C", "500C"), ("1000C", "1000C")])
    tpol = first_match(key, [("w/ grid", "w/ grid"), ("w/o grid", "w/o grid")])
    return df.withColumns({"cpol": cpol, "tpol": tpol})
