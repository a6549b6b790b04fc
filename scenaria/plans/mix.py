"""Generation mix: totals, shares, contrasts and regional views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import detect, recode, scaled, sign_flip, strict_sum
from scenaria.operators import (
    as_category,
    contrast,
    grouped_sum,
    pivot_wider,
    share_of_total,
    with_scenario_category,
)

KEYS = ["Sc", "Sv", "Sr", "Y5"]


def names(variables: Sequence[Sequence[str]]) -> list[str]:
    return [v[0] for v in variables]


def generation_mix(
    panel: DataFrame,
    variables: Sequence[Sequence[str]],
    scenarios: DataFrame,
    merge: Mapping[str, str] | Column = vocab.PUMPED_HYDRO_AS_HYDRO,
    merge_first: bool = False,
) -> DataFrame:
    """Sum per technology with scenario categories.

    ``merge`` joins technologies before the sum; with ``merge_first`` the
    technology filter applies to the merged names.
    """
    label = merge if isinstance(merge, Column) else recode("Sv", merge)
    wanted = F.col("Sv").isin(names(variables))
    rows = panel.withColumn("Sv", label).filter(wanted) if merge_first else panel.filter(wanted).withColumn("Sv", label)
    return with_scenario_category(grouped_sum(rows, KEYS), scenarios)


def fossil_and_renewable_groups() -> Column:
    """Technology label with fossil, wind and solar joined up."""
    sv = F.col("Sv")
    return (
        F.when(sv.isin("Sec_Ene_Ele_Coa_wo_CCS", "Sec_Ene_Ele_Oil", "Sec_Ene_Ele_Gas_wo_CCS"), "Sec_Ene_Ele_Fos_wo_CCS")
        .when(sv.isin("Sec_Ene_Ele_Coa_w_CCS", "Sec_Ene_Ele_Gas_w_CCS"), "Sec_Ene_Ele_Fos_w_CCS")
        .when(detect(sv, "Sec_Ene_Ele_Win"), "Sec_Ene_Ele_Win")
        .when(detect(sv, "Sec_Ene_Ele_Solar"), "Sec_Ene_Ele_Solar")
        .otherwise(recode(sv, vocab.PUMPED_HYDRO_AS_HYDRO))
    )


def without_losses(mix: DataFrame) -> DataFrame:
    return mix.filter(~F.col("Sv").isin(vocab.ANNUAL_OUTFLOWS))


def regional_view(
    mix: DataFrame,
    regions: Sequence[str],
    scenarios: Sequence[str],
    variables: Sequence[Sequence[str]],
    region_labels: Mapping[str, str] | None = None,
    outflows: Sequence[str] = tuple(vocab.ANNUAL_OUTFLOWS),
    year: int | None = None,
    divisor: float = 1e9,
) -> DataFrame:
    """Signed mix of named regions in display units, with display order."""
    rows = mix.filter(F.col("Sr").isin(list(regions)) & F.col("Sc").isin(list(scenarios)))
    if year is not None:
        rows = rows.filter(F.col("Y5") == year)
    signed = rows.withColumns(
        {
            "value": scaled(sign_flip("Sv", "value", outflows), divisor),
            "Sr": recode("Sr", region_labels or {}),
        }
    )
    return as_category(signed, "Sv", names(variables), ord_col="ord", reverse=True)


def technology_share(mix: DataFrame, regions: Sequence[str], scenarios: Sequence[str], year: int | None = None) -> DataFrame:
    """Percent of the region's generation, for one year or for every bin."""
    rows = without_losses(mix).filter(F.col("Sr").isin(list(regions)) & F.col("Sc").isin(list(scenarios)))
    if year is not None:
        return share_of_total(rows.filter(F.col("Y5") == year), ["Sc", "Sr"])
    return share_of_total(rows, ["Sc", "Sr", "Y5"])


def share_table(share: DataFrame, technologies: Sequence[str], parts: Sequence[str] = tuple(vocab.WIND_AND_SOLAR), out: str = "Sec_Ene_Ele_WinSol") -> DataFrame:
    """Shares as columns plus the sum of some of them."""
    wide = pivot_wider(share, ["Sc", "Sr", "Y5"], "Sv", "share", list(technologies), fill=0.0)
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return wide.withColumn(out, total)


def generation_total(mix: DataFrame, regions: Sequence[str], scenarios: Sequence[str], year: int) -> DataFrame:
    rows = without_losses(mix).filter(
        F.col("Sr").isin(list(regions)) & F.col("Sc").isin(list(scenarios)) & (F.col("Y5") == year)
    )
    return grouped_sum(rows, ["Sc", "Sr"])


def grid_effect(mix: DataFrame, region_pattern: str, year: int, outflows: Sequence[str] = tuple(vocab.ANNUAL_OUTFLOWS)) -> DataFrame:
    """Change of the mix due to the grid: ``w/ grid`` minus ``w/o grid``."""
    rows = mix.filter(detect("Sr", region_pattern) & (F.col("Y5") == year))
    signed = rows.withColumn("value", sign_flip("Sv", "value", outflows))
    return contrast(signed, ["cat1", "Sv", "Sr", "Y5"], "cat2", "w/ grid", "w/o grid", fill=0.0)


def subnational_mix(
    mix: DataFrame,
    region_pattern: str,
    scenarios: Sequence[str],
    year: int,
    region_labels: Mapping[str, str] | None = None,
    region_order: Sequence[str] | None = None,
) -> DataFrame:
    rows = without_losses(mix).filter(
        (F.col("Y5") == year) & detect("Sr", region_pattern) & F.col("Sc").isin(list(scenarios))
    )
    rows = rows.withColumn("value", sign_flip("Sv", "value", vocab.ANNUAL_OUTFLOWS))
    rows = rows.withColumn("Sr", recode("Sr", region_labels or {}))
    return as_category(rows, "Sr", region_order, ord_col="ord") if region_order else rows


def trade_volume(hourly: DataFrame, region_pattern: str | None = None, variable: str = "Trd_Sec_Ene_Ele") -> DataFrame:
    """Import and export volume from the sign of hourly trade."""
    rows = hourly.filter((F.col("Sv") == variable) & (F.col("value") != 0))
    if region_pattern:
        rows = rows.filter(detect("Sr", region_pattern))
    kind = F.when(F.col("value") >= 0, "import").when(F.col("value") < 0, "export")
    return rows.groupBy("Sc", kind.alias("Sv"), "Sr").agg(strict_sum("value").alias("value"))


def annual_summary(mix: DataFrame, region: str) -> DataFrame:
    """Signed mix of one region over all scenarios and bins, in TWh."""
    rows = mix.filter(F.col("Sr") == region)
    return rows.withColumn("value", scaled(sign_flip("Sv", "value", vocab.ANNUAL_OUTFLOWS), 1e6))
