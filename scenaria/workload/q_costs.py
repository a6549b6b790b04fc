"""System cost and GDP.

Money is shown in millions. Amounts that are exact in hundredths are rounded
beyond their last digit, so that no value lies on a rounding boundary.
"""

from __future__ import annotations

from scenaria import vocab
from scenaria.functions import recode
from scenaria.operators import attach_dimension
from scenaria.plans import costs
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.registry import query, rounded

SC = o.recode("Sc", em.LABELS)
CODES = list(em.LABELS)
M = 1e6


def increment_of(spark, d, first=2020):
    asset, link = em.cost_symbols(spark, d)
    return costs.annual_increment(costs.asset_cost(asset), costs.link_cost(link), first=first, baseline=em.BASELINE, scenarios=CODES)


def npv_of(spark, d):
    return costs.increment_npv(increment_of(spark, d), em.LABELS)


def yearly_gdp_of(spark, d):
    return costs.interpolated_gdp(em.gdp(spark, d), 2020, 2050)


def gdp_of(spark, d):
    return costs.discounted_gdp(yearly_gdp_of(spark, d), unit=1.0)


@query("T42 F1 J1 P11 A1 U1", "SELECT Sc, N, Sv, YEAR, round(value / 1e6, 10) AS value FROM fx_asset_cost")
def cost_by_class(spark, d):
    return rounded(costs.asset_cost(em.asset_costs(spark, d)), digits=10, divisor=M)


@query("T43 P18 X4 P25 A7 U1 X3", "SELECT Sc, N, Sv, YEAR, round(value / 1e6, 10) AS value FROM fx_lnk_cost_nodes")
def link_cost_split(spark, d):
    return rounded(costs.link_cost(em.link_costs(spark, d)), digits=10, divisor=M)


@query("T44 R5 R7 R8 W3 W5 P27", "SELECT Sr2, Sv, YEAR, Sc, round(value / 1e6, 10) AS value FROM fx_increment")
def cost_increment_yearly(spark, d):
    return rounded(increment_of(spark, d), digits=10, divisor=M)


@query("T44 A6 X10", "SELECT Sc, Sv, Sr2, round(value / 1e6, 4) AS value FROM fx_npv")
def cost_increment_npv(spark, d):
    return rounded(npv_of(spark, d), divisor=M)


@query(
    "T44 F6",
    f"""
    SELECT {SC} AS Sc, i.Sv, i.Sr2, round(sum(i.value * pow(0.95, i.YEAR - 2020)) / 1e6, 4) AS value
    FROM fx_increment i
    JOIN (SELECT DISTINCT Sr2, Sv FROM fx_cost_total WHERE YEAR >= 2040) k
      ON k.Sr2 IS NOT DISTINCT FROM i.Sr2 AND k.Sv IS NOT DISTINCT FROM i.Sv
    WHERE i.YEAR >= 2040 GROUP BY ALL""",
)
def cost_npv_from_2040(spark, d):
    """Later window, same discount base; only what has cost in the window is a series."""
    return rounded(costs.increment_npv(increment_of(spark, d, 2040), em.LABELS), divisor=M)


@query("T45 A8", "SELECT Sc, Sv, Sr2, round(value / 1e6, 4) AS value FROM fx_npv_total")
def cost_with_total(spark, d):
    return rounded(costs.cost_with_total(npv_of(spark, d)), divisor=M)


@query("T45 A1", "SELECT Sc, Sr2, round(sum(value) / 1e6, 4) AS value FROM fx_npv_total GROUP BY ALL")
def cost_totals(spark, d):
    return rounded(costs.cost_all_classes(costs.cost_with_total(npv_of(spark, d))), divisor=M)


@query("T46 P5 R2 R6 R9 W4", "SELECT Sr2, YEAR, round(GDP / 1e6, 10) AS \"GDP\" FROM fx_gdp_yearly")
def gdp_interpolated(spark, d):
    return rounded(yearly_gdp_of(spark, d), "GDP", digits=10, divisor=M)


@query("T46 A5 A4 A8 U1", "SELECT Sr2, round(GDP / 1e6, 4) AS \"GDP\" FROM fx_gdp_all")
def gdp_discounted(spark, d):
    return rounded(gdp_of(spark, d), "GDP", divisor=M)


def _window_gdp(extra: str) -> str:
    pv = "round(sum(GDP * pow(0.95, YEAR - 2020)) * 91.9 / 102.9 / 1e6, 4) AS \"GDP\""
    return f"""
    WITH y AS (SELECT * FROM fx_gdp_yearly WHERE YEAR <= 2040 {extra})
    SELECT Sr2, {pv} FROM y GROUP BY Sr2 UNION ALL SELECT 'Total', {pv} FROM y"""


@query("T46 Q6", _window_gdp("OR YEAR % 5 = 0"))
def gdp_window_keep_outside(spark, d):
    """Source years after the window stay in the sum."""
    yearly = costs.interpolated_gdp(em.gdp(spark, d), 2020, 2040)
    return rounded(costs.discounted_gdp(yearly, unit=1.0), "GDP", divisor=M)


@query("T46 Q6", _window_gdp(""))
def gdp_window_only(spark, d):
    yearly = costs.interpolated_gdp(em.gdp(spark, d), 2020, 2040, keep_outside=False)
    return rounded(costs.discounted_gdp(yearly, unit=1.0), "GDP", divisor=M)


@query("A4", "SELECT round(sum(GDP) / 1e6, 4) AS \"GDP\" FROM fx_gdp_pv")
def gdp_total(spark, d):
    yearly = costs.discounted_gdp(yearly_gdp_of(spark, d), unit=1.0, total=None)
    return rounded(costs.strict_gdp_total(yearly), "GDP", divisor=M)


_CLASS = "CASE WHEN n.Sv LIKE '%fossil%' THEN 'CAPEX (fossil)' WHEN n.Sv LIKE '%solar%' OR n.Sv LIKE '%wind%' THEN 'CAPEX (solar/wind)' ELSE n.Sv END"


@query(
    "T47 J6 P25 P15",
    f"""
    SELECT n.Sc, {_CLASS} AS Sv, n.Sr2, round(100.0 * n.value / nullif(g.GDP, 0), 6) AS value, round(g.GDP / 1e6, 4) AS "GDP"
    FROM fx_npv_total n LEFT JOIN fx_gdp_all g ON g.Sr2 = n.Sr2""",
)
def cost_pct_gdp(spark, d):
    out = costs.cost_pct_gdp(costs.cost_with_total(npv_of(spark, d)), gdp_of(spark, d))
    return rounded(rounded(out, digits=6), "GDP", divisor=M)


_SHOWN_CLASS = {v.Variable: v for v in vocab.COST_COLLAPSED}


@query(
    "T47 P15 P17 D1 J1",
    f"""
    WITH c AS (SELECT n.Sc, {_CLASS} AS Sv, n.Sr2, round(100.0 * n.value / nullif(g.GDP, 0), 6) AS value, round(g.GDP / 1e6, 4) AS "GDP"
               FROM fx_npv_total n LEFT JOIN fx_gdp_all g ON g.Sr2 = n.Sr2)
    SELECT c.*, {o.lookup('Sv', {k: v.Legend for k, v in _SHOWN_CLASS.items()})} AS legend,
           {o.lookup('Sv', {k: v.Color for k, v in _SHOWN_CLASS.items()})} AS color,
           CAST(list_position([{', '.join(o.lit(k) for k in _SHOWN_CLASS)}], Sv) AS INTEGER) AS ord
    FROM c""",
)
def cost_pct_gdp_legend(spark, d):
    """The collapsed cost classes with legend, colour and display order."""
    out = costs.cost_pct_gdp(costs.cost_with_total(npv_of(spark, d)), gdp_of(spark, d))
    return attach_dimension(rounded(rounded(out, digits=6), "GDP", divisor=M), vocab.COST_COLLAPSED, "Sv")


_HEAD = """
    WITH t AS (SELECT Sc, sum(value) AS value FROM fx_npv_total WHERE Sr2 = 'Total' GROUP BY Sc),
    h AS (SELECT t.Sc, 'Total' AS Sr2, t.value, g.GDP FROM t LEFT JOIN fx_gdp_all g ON g.Sr2 = 'Total')"""


@query(
    "T48 J6 F1 P7",
    f"""{_HEAD}
    SELECT Sc, Sr2, round(value / 1e6, 4) AS value, round(GDP / 1e6, 4) AS "GDP", round(100.0 * value / GDP, 6) AS value2,
           CASE Sc WHEN 'w/o grid' THEN 'w/o grid' WHEN 'w/ grid' THEN '2040' END AS Sc2
    FROM h""",
)
def headline_cost(spark, d):
    total = costs.cost_all_classes(costs.cost_with_total(npv_of(spark, d)))
    out = costs.headline_cost(total, gdp_of(spark, d))
    return rounded(rounded(out, "value2", digits=6), "value", "GDP", divisor=M)


@query(
    "P30",
    f"""{_HEAD}
    SELECT Sc, round(value / 1e9, 6) AS trillion, round(100.0 * value / GDP, 6) AS pct FROM h""",
)
def cost_axis_pct(spark, d):
    total = costs.cost_all_classes(costs.cost_with_total(npv_of(spark, d)))
    head = costs.headline_cost(total, gdp_of(spark, d))
    axis = costs.absolute_to_pct(head, divisor=1e9)
    return rounded(axis.select("Sc", "trillion", "pct"), "trillion", "pct", digits=6)


_DEC = "CASE WHEN YEAR <= 2030 THEN '2021-30' WHEN YEAR <= 2040 THEN '2031-40' ELSE '2041-50' END"


@query(
    "T49 A8",
    f"""
    WITH c AS (SELECT {SC} AS Sc, CAST(YEAR AS INTEGER) AS YEAR, Sr2, sum(value * pow(0.95, YEAR - 2020)) AS value
               FROM fx_increment GROUP BY ALL)
    SELECT Sc, YEAR, Sr2, round(value / 1e6, 4) AS value FROM c
    UNION ALL SELECT Sc, YEAR, 'Total', round(sum(value) / 1e6, 4) FROM c GROUP BY Sc, YEAR""",
)
def cost_per_year(spark, d):
    yearly = costs.cost_per_year(increment_of(spark, d))
    return rounded(yearly.withColumn("Sc", recode("Sc", em.LABELS)), divisor=M)


@query(
    "T49 J1",
    f"""
    WITH c AS (SELECT {SC} AS Sc, {_DEC} AS Y10, sum(value * pow(0.95, YEAR - 2020)) AS value
               FROM fx_increment WHERE YEAR BETWEEN 2021 AND 2050 GROUP BY ALL),
    g AS (SELECT {_DEC} AS Y10, sum(GDP * pow(0.95, YEAR - 2020)) * 91.9 / 102.9 AS GDP
          FROM fx_gdp_yearly WHERE YEAR BETWEEN 2021 AND 2050 GROUP BY ALL)
    SELECT Sc, Y10, round(c.value / 1e6, 4) AS value, round(g.GDP / 1e6, 4) AS "GDP", round(100.0 * c.value / g.GDP, 6) AS value2
    FROM c LEFT JOIN g USING (Y10)""",
)
def cost_per_decade(spark, d):
    out = costs.cost_per_decade(increment_of(spark, d), yearly_gdp_of(spark, d), em.LABELS, unit=1.0)
    return rounded(rounded(out, "value2", digits=6), "value", "GDP", divisor=M)
