"""Model inputs: demand and emission caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import first_match, recode, strict_sum, to_number
from scenaria.operators import complete_series, grouped_sum
from scenaria.plans.panel import labelled

CARRIER_LABEL = {"AC2": "Electricity", "H2": "Hydrogen"}


def demand_by_carrier(demand: DataFrame, labels: Mapping[str, str], keep: Sequence[str], years: Sequence[int], carriers: Mapping[str, str] = CARRIER_LABEL) -> DataFrame:
    """Demand per carrier, scenario and year; every listed pair is present per carrier."""
    rows = labelled(demand.filter(F.col("I").isin(list(carriers))), labels, keep)
    total = grouped_sum(rows.select("I", "Sc", to_number("Y").alias("Y"), "value"), ["I", "Y", "Sc"])
    domain = [(s, y) for s in keep for y in years]
    dense = complete_series(total, ["I"], ["Sc", "Y"], domain, fill=0.0)
    return dense.withColumn("I", recode("I", carriers))


def demand_by_country(demand: DataFrame, labels: Mapping[str, str], keep: Sequence[str], carrier: str, years: Sequence[int] | None = None) -> DataFrame:
    """Demand of one carrier per country; ``years`` supplies missing years with zero."""
    rows = labelled(demand.filter(F.col("I") == carrier), labels, keep)
    rows = rows.select(first_match("N", vocab.COUNTRY_OF_NODE).alias("Sr"), "I", to_number("Y").alias("Y"), "Sc", "value")
    total = grouped_sum(rows, ["Sr", "I", "Y", "Sc"])
    return total if years is None else complete_series(total, ["Sr", "I", "Sc"], "Y", list(years), fill=0.0)


def emission_cap(cap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Emission cap per year, optionally by scenario (``Sc``) or country (``MQ``)."""
    return cap.groupBy(to_number("Y").alias("Y"), *by).agg(strict_sum("value").alias("value"))
