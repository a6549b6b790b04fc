"""Hourly and daily electricity balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import (
    date_of_day,
    day_of_hour,
    hour_window,
    recode,
    scaled,
    sign_flip,
    slice_hour,
    timestamp_of_hour,
)
from scenaria.operators import complete_sum, grouped_sum, union_rows, with_scenario_category
from scenaria.plans.mix import names

ZONE_HOURS = 9


def hourly_balance(
    hourly: DataFrame,
    variables: Sequence[Sequence[str]],
    scenarios: DataFrame,
    slices: Sequence[str] | DataFrame | None = None,
    merge: Mapping[str, str] | None = None,
    offset: int = ZONE_HOURS,
) -> DataFrame:
    """Dense hourly panel: every scenario, variable and region in every slice."""
    rows = hourly.withColumn("Sv", recode("Sv", merge)) if merge else hourly
    rows = rows.filter(F.col("Sv").isin(names(variables)))
    dense = complete_sum(rows, ["Sc", "Sv", "Sr", "St"], domains={"St": slices})
    return with_scenario_category(dense.withColumn("T", slice_hour("St", offset)), scenarios)


def daily_balance(hourly: DataFrame, baseline: str | None = "NoPOL") -> DataFrame:
    """Sum per day; scenarios without a category drop out with the baseline."""
    out = grouped_sum(hourly.withColumn("D", day_of_hour("T")), ["Sc", "Sv", "Sr", "D", "cat1", "cat2"])
    return out.filter(F.col("cat1") != baseline) if baseline else out


def daily_view(
    daily: DataFrame,
    region: str,
    year: int,
    scenarios: Sequence[str] | None = None,
    outflows: Sequence[str] = tuple(vocab.HOURLY_OUTFLOWS),
    trade_only_in: str | None = None,
) -> DataFrame:
    """Signed daily balance of one region in GWh, with calendar dates.

    ``trade_only_in`` hides the trade rows of the other scenarios.
    """
    rows = daily.filter((F.col("Sr") == region) & (F.col("value") != 0))
    if scenarios is not None:
        rows = rows.filter(F.col("Sc").isin(list(scenarios)))
    if trade_only_in is not None:
        rows = rows.filter((F.col("Sc") == trade_only_in) | (F.col("Sv") != "Trd_Sec_Ene_Ele"))
    return rows.withColumns(
        {"value": scaled(sign_flip("Sv", "value", outflows), 1000), "D": date_of_day("D", year)}
    )


def hourly_window(
    hourly: DataFrame,
    region: str,
    year: int,
    window: tuple[str | date, str | date],
    scenarios: Sequence[str] | None = None,
    outflows: Sequence[str] = tuple(vocab.HOURLY_OUTFLOWS),
    shift: int = 23,
) -> DataFrame:
    """Signed hourly balance of one region in a date range, in GW."""
    first, last = hour_window(*window)
    rows = hourly.filter((F.col("Sr") == region) & F.col("T").between(first, last) & (F.col("value") != 0))
    if scenarios is not None:
        rows = rows.filter(F.col("Sc").isin(list(scenarios)))
    return rows.withColumns(
        {"value": scaled(sign_flip("Sv", "value", outflows), 1000), "T": timestamp_of_hour("T", year, shift)}
    )


def demand_line(
    hourly: DataFrame,
    region: str,
    year: int,
    window: tuple[str | date, str | date],
    scenarios: Sequence[str],
    variable: str = "Fin_Ene_Ele",
    offset: int = ZONE_HOURS,
    shift: int = 23,
) -> DataFrame:
    """Demand of the same window, for drawing over the balance."""
    first, last = hour_window(*window)
    rows = hourly.filter((F.col("Sv") == variable) & (F.col("Sr") == region) & F.col("Sc").isin(list(scenarios)))
    rows = rows.withColumn("T", slice_hour("St", offset)).filter(F.col("T").between(first, last))
    return rows.select("Sc", "Sv", "Sr", timestamp_of_hour("T", year, shift).alias("T"), scaled("value", 1000).alias("value"))


def window_with_overlay(view: DataFrame, line: DataFrame) -> DataFrame:
    """Stacked balance and its overlay in one table, tagged by layer."""
    cols = ["Sc", "Sv", "Sr", "T", "value"]
    return union_rows(
        view.select(*cols, F.lit("bar").alias("layer")),
        line.select(*cols, F.lit("line").alias("layer")),
    )


def variable_presence(daily: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Row count and days of the named variables."""
    rows = daily.filter(F.col("Sv").isin(list(variables)))
    return rows.groupBy("Sv").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("D").alias("n_days"))


def facet_counts(hourly: DataFrame) -> DataFrame:
    """Distinct categories and whether the second one is unused."""
    return hourly.agg(
        F.countDistinct("cat1").alias("ncat1"),
        F.countDistinct("cat2").alias("ncat2"),
        F.bool_and(F.col("cat2").isNull()).alias("cat2_unused"),
    )


# Named report views ----------------------------------------------------------


def dispatch_hourly_summary(hourly: DataFrame, window: tuple[str, str], region: str, year: int) -> DataFrame:
    return hourly_window(hourly, region, year, window)


def dispatch_hourly_scenario(hourly: DataFrame, window: tuple[str, str], region: str, year: int, scenario: str) -> DataFrame:
    return hourly_window(hourly, region, year, window, [scenario])


def dispatch_daily_summary(daily: DataFrame, region: str, year: int) -> DataFrame:
    return daily_view(daily, region, year)


def dispatch_daily_scenario(daily: DataFrame, region: str, year: int, scenario: str) -> DataFrame:
    return daily_view(daily, region, year, [scenario])
