"""Scenario matrix and the annual and hourly panels everything else reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import recode, year_bin
from scenaria.operators import densify, grouped_mean, semi_join


def codes_of(labels: Mapping[str, str], keep: Sequence[str]) -> list[str]:
    """Raw scenario codes behind the wanted labels, so that the scan can be
    filtered before the relabelling."""
    return [c for c, lab in labels.items() if lab in keep] + [k for k in keep if k not in labels]


def scenario_matrix(scenarios: DataFrame, labels: Mapping[str, str], feasible: bool = True) -> DataFrame:
    """Feasible scenarios with display labels, or the infeasible ones as they are."""
    if not feasible:
        return scenarios.filter(F.col("Status") == "Infeasible")
    return scenarios.filter(F.col("Status") != "Infeasible").withColumns(
        {
            "Scenario": recode("Scenario", labels),
            "scen_tpol": recode("scen_tpol", vocab.SCENARIO_GRID_LABEL),
        }
    )


def of_codes(df: DataFrame, labels: Mapping[str, str], keep: Sequence[str], col: str = "Sc") -> DataFrame:
    """Rows of the wanted scenarios under their raw codes (reaches the scan).
    Sums and means are made per code and relabelled after, so that two codes
    with one label stay two rows."""
    return df.filter(F.col(col).isin(codes_of(labels, keep)))


def labelled(df: DataFrame, labels: Mapping[str, str], keep: Sequence[str], col: str = "Sc") -> DataFrame:
    """Filter on raw codes (reaches the scan), then relabel."""
    return of_codes(df, labels, keep, col).withColumn(col, recode(col, labels))


def annual_panel(annual: DataFrame, labels: Mapping[str, str], keep: Sequence[str], bins: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Mean per five-year bin, every series present in every bin.

    ``bins`` names the bins of the horizon, as a list or a one-column set;
    without it they are read from the panel, which then is computed for its
    domain as well.
    """
    rows = labelled(annual, labels, keep).withColumn("Y5", year_bin("Sy"))
    means = grouped_mean(rows, ["Sc", "Sv", "Sr", "Y5"])
    return densify(means, ["Sc", "Sv", "Sr"], "Y5", domain=bins)


def hourly_panel(hourly: DataFrame, labels: Mapping[str, str], keep: Sequence[str], scenarios: DataFrame) -> DataFrame:
    """Hourly rows of the wanted scenarios, as far as they are feasible."""
    return semi_join(labelled(hourly, labels, keep), scenarios, {"Sc": "Scenario"})
