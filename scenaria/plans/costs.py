"""System cost, its increment over the baseline, and GDP."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import detect, discount_factor, first_match, lookup, percent_of, recode, same_prefix, strict_sum, strip_bus
from scenaria.operators import (
    allocate_to_ends,
    carry_backward,
    complete_series,
    decade_sum,
    delta_vs_baseline,
    discounted_sum,
    grouped_sum,
    interpolate,
    natural_join,
    pivot_longer,
    split_link,
    union_rows,
    with_totals,
)


def stack_symbols(**tables: DataFrame) -> DataFrame:
    """Cost symbols read from separate files as one table, tagged ``symbol``."""
    return union_rows(*[df.withColumn("symbol", F.lit(name)) for name, df in tables.items()])


def asset_cost(symbols: DataFrame) -> DataFrame:
    """Generation and storage cost by class; unmapped technologies keep a NULL class.

    ``symbols`` holds gen_inv, sto_inv, gen_fom, sto_fom and gen_vom rows
    (symbol, Sc, N, R, SE0, YEAR, value). The class is a column, so all symbols
    share one pass and one grouped sum.
    """
    symbol = F.col("symbol")
    cost_class = (
        F.when(symbol == "gen_inv", lookup("R", vocab.GENERATOR_COST_CLASS))
        .when(symbol == "sto_inv", "CAPEX (battery)")
        .when(symbol.isin("gen_fom", "sto_fom"), "OPEX")
        .when(symbol == "gen_vom", "Fuel")
    )
    rows = symbols.filter(F.col("SE0") == "ALL").withColumn("Sv", cost_class)
    return grouped_sum(rows, ["Sc", "N", "Sv", "YEAR"])


def link_cost_class() -> Column:
    """Investment class of a link from its buses and the scope of its ends."""
    ac, home = detect("L", vocab.AC_LINK), same_prefix("N0", "N1")
    return (
        F.when(ac & home, "CAPEX (domestic interconnection)")
        .when(ac & ~home, "CAPEX (international interconnection)")
        .when(detect("L", vocab.BATTERY_LINK), "CAPEX (battery)")
        .when(detect("L", vocab.HYDROGEN_LINK), "CAPEX (hydrogen)")
        .when(detect("L", vocab.OTHER_LINK), "CAPEX (other)")
    )


def link_cost(symbols: DataFrame) -> DataFrame:
    """Link cost by node and class: domestic links are charged to their first
    end, cross-border links half to each end. ``symbols`` holds lnk_inv,
    lnk_fom and lnk_vom rows (symbol, Sc, L, YEAR, value)."""
    symbol = F.col("symbol")
    ends = split_link(symbols, "L").withColumns({"N0": strip_bus("N0"), "N1": strip_bus("N1")})
    cost_class = (
        F.when(symbol == "lnk_inv", link_cost_class()).when(symbol == "lnk_fom", "OPEX").when(symbol == "lnk_vom", "Fuel")
    )
    return allocate_to_ends(ends.withColumn("Sv", cost_class), ~same_prefix("N0", "N1"), ["Sc", "Sv", "YEAR"])


def annual_increment(
    asset: DataFrame,
    link: DataFrame,
    first: int = 2020,
    last: int = 2050,
    step: int = 5,
    baseline: str = "NoPOL",
    scenarios: Sequence[str] | None = None,
) -> DataFrame:
    """Yearly cost by country and class minus the baseline scenario.

    Model years are completed with zero, then spread to single years: a year
    takes the value of the next model year.
    """
    rows = union_rows(asset, link).filter(F.col("YEAR") >= first)
    rows = rows.withColumn("Sr2", first_match("N", vocab.COUNTRY_OF_NODE))
    keys = ["Sr2", "Sc", "Sv"]
    total = grouped_sum(rows, [*keys, "YEAR"])
    model_years = complete_series(total, keys, "YEAR", list(range(first, last + 1, step)), fill=0.0)
    yearly = complete_series(model_years, keys, "YEAR", F.sequence(F.lit(first), F.lit(last)))
    filled = carry_backward(yearly, keys, "YEAR")
    return delta_vs_baseline(filled, ["Sr2", "Sv", "YEAR"], baseline=baseline, scenarios=scenarios)


def increment_npv(increment: DataFrame, labels: Mapping[str, str], base: int = 2020) -> DataFrame:
    """Discounted sum of the increment."""
    return discounted_sum(increment, ["Sc", "Sv", "Sr2"], base=base).withColumn("Sc", recode("Sc", labels))


def cost_with_total(npv: DataFrame, label: str = "Total") -> DataFrame:
    """Country rows and the regional total, by class."""
    return with_totals(npv, ["Sc", "Sv"], "Sr2", label)


def cost_all_classes(with_total: DataFrame) -> DataFrame:
    return grouped_sum(with_total, ["Sc", "Sr2"])


def interpolated_gdp(gdp: DataFrame, first: int, last: int, keep_outside: bool = True, regions: Mapping[str, str] = vocab.COUNTRY_OF_GDP_REGION) -> DataFrame:
    """Yearly GDP per country from the wide series.

    Source years outside of ``first..last`` stay in the result unless
    ``keep_outside`` is off.
    """
    years = [c for c in gdp.columns if c.isdigit()]
    named = gdp.filter(F.col("Region").isNotNull()).select(recode("Region", regions).alias("Sr2"), *years)
    long = pivot_longer(named, ["Sr2"], years, "YEAR", "GDP", "int")
    grid = complete_series(long, ["Sr2"], "YEAR", F.sequence(F.lit(first), F.lit(last)), value="GDP")
    filled = interpolate(grid, ["Sr2"], "YEAR", "GDP")
    return filled if keep_outside else filled.filter(F.col("YEAR").between(first, last))


def discounted_gdp(
    yearly: DataFrame,
    base: int = vocab.DISCOUNT_BASE_YEAR,
    unit: float = vocab.GDP_UNIT,
    deflator: float = vocab.GDP_DEFLATOR,
    total: str | None = "Total",
) -> DataFrame:
    """Discounted, deflated GDP by country and in total."""
    scale = unit * deflator
    pv = discounted_sum(yearly, ["Sr2"], "GDP", base=base, scale=scale)
    return with_totals(pv, [], "Sr2", total, "GDP") if total else pv


def cost_class_collapsed(c: str = "Sv") -> Column:
    return (
        F.when(detect(c, "fossil"), "CAPEX (fossil)").when(detect(c, "solar|wind"), "CAPEX (solar/wind)").otherwise(F.col(c))
    )


def cost_pct_gdp(with_total: DataFrame, gdp: DataFrame, collapse: bool = True) -> DataFrame:
    """Cost by class as a percentage of GDP, with collapsed class names.

    Rows are relabelled, not summed: two source classes may share a name.
    """
    joined = natural_join(with_total, gdp, on=["Sr2"]).withColumn("value", percent_of("value", "GDP"))
    return joined.withColumn("Sv", cost_class_collapsed()) if collapse else joined


def headline_cost(all_classes: DataFrame, gdp: DataFrame, label: str = "Total") -> DataFrame:
    """The regional total, in money and as a percentage of GDP, with the short
    scenario code (the year the grid opens)."""
    rows = natural_join(all_classes.filter(F.col("Sr2") == label), gdp, on=["Sr2"])
    code = first_match("Sc", list(vocab.HEADLINE_CODE.items()), exact=True)
    return rows.withColumns({"value2": percent_of("value", "GDP"), "Sc2": code})


def absolute_to_pct(df: DataFrame, value: str = "value", gdp: str = "GDP", divisor: float = 1e12) -> DataFrame:
    """Secondary axis: trillions back to percent of GDP."""
    tr = F.col(value) / F.lit(divisor)
    return df.withColumns({"trillion": tr, "pct": percent_of(tr * F.lit(divisor), F.col(gdp))})


def cost_per_year(increment: DataFrame, base: int = 2020, label: str = "Total") -> DataFrame:
    """Discounted cost of all classes per scenario, year and country, and over all countries."""
    pv = increment.withColumn("value", F.col("value") * discount_factor("YEAR", base))
    return with_totals(grouped_sum(pv, ["Sc", "YEAR", "Sr2"]), ["Sc", "YEAR"], "Sr2", label)


def cost_per_decade(
    increment: DataFrame,
    yearly_gdp: DataFrame,
    labels: Mapping[str, str],
    first: int = 2021,
    last: int = 2050,
    base: int = 2020,
    unit: float = vocab.GDP_UNIT,
    deflator: float = vocab.GDP_DEFLATOR,
) -> DataFrame:
    """Discounted cost of all countries per decade beside the decade's GDP."""
    everywhere = cost_per_year(increment, base).filter(F.col("Sr2") == "Total")
    cost = decade_sum(everywhere, ["Sc"], first=first, last=last)
    gdp_pv = F.col("GDP") * discount_factor("YEAR", base) * F.lit(unit * deflator)
    gdp = decade_sum(yearly_gdp.withColumn("GDP", gdp_pv), [], "GDP", first=first, last=last)
    out = natural_join(cost.withColumn("Sc", recode("Sc", labels)), gdp, on=["Y10"])
    return out.withColumn("value2", percent_of("value", "GDP"))


def strict_gdp_total(gdp: DataFrame) -> DataFrame:
    """One row: GDP over all countries."""
    return gdp.agg(strict_sum("GDP").alias("GDP"))
