"""Marginal prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenaria.functions import recode
from scenaria.operators import rank_rows
from scenaria.plans import prices
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.registry import query, rounded

SC = o.recode("Sc", em.LABELS)
MEAN = f"({o.ssum('dmd * price')} / nullif({o.ssum('dmd')}, 0))"


def mcoe_of(spark, d):
    return prices.price_table(em.prices(spark, d), em.demand(spark, d))


@query("T39 F11 J7 P11 U1", "SELECT Sc, N, I, T, price, dmd FROM fx_mcoe")
def price_table(spark, d):
    return mcoe_of(spark, d)


@query(
    "T40 A3 Q1",
    f"SELECT {SC} AS Sc, I, T, round({MEAN}, 8) AS value FROM fx_mcoe WHERE N LIKE '%JP-%' GROUP BY ALL",
)
def weighted_price_slice(spark, d):
    return rounded(prices.slice_price(mcoe_of(spark, d), em.LABELS), digits=8)


_COUNTRY = "CASE WHEN N LIKE '%JP-%' THEN 'JPN' WHEN N LIKE '%CN-%' THEN 'CHN' WHEN N = 'KR' THEN 'KOR' WHEN N = 'MN' THEN 'MNG' END"


@query(
    "T40 A3 A8 P20",
    f"""
    SELECT {SC} AS Sc, I, {_COUNTRY} AS Sr, round({MEAN}, 8) AS value FROM fx_mcoe GROUP BY ALL
    UNION ALL SELECT {SC}, I, 'Total', round({MEAN}, 8) FROM fx_mcoe GROUP BY ALL""",
)
def weighted_price_totals(spark, d):
    return rounded(prices.country_price(mcoe_of(spark, d), em.LABELS), digits=8)


@query(
    "T40 A3",
    f"SELECT {SC} AS Sc, N AS Sr, round({MEAN}, 8) AS value FROM fx_mcoe WHERE N LIKE '%JP-%' AND I = 'AC' GROUP BY ALL",
)
def node_price(spark, d):
    return rounded(prices.node_price(mcoe_of(spark, d), em.LABELS), digits=8)


_SLICE = f"SELECT {SC} AS Sc, I, T AS St, round({MEAN}, 8) AS value FROM fx_mcoe WHERE N LIKE '%JP-%' AND I = 'AC' GROUP BY ALL"


@query(
    "T41 W2 O2 Q17",
    f"""
    SELECT Sc, I, CAST(row_number() OVER (PARTITION BY Sc, I ORDER BY value DESC NULLS LAST, St) AS INTEGER) AS T, St, value
    FROM ({_SLICE})""",
)
def price_duration_curve(spark, d):
    return prices.price_curve(rounded(prices.slice_price(mcoe_of(spark, d), em.LABELS), digits=8))


@query(
    "T41 W2 unbounded groups",
    f"""
    SELECT {SC} AS Sc, value, row_number() OVER (PARTITION BY Sc ORDER BY value DESC, l_orderkey, l_linenumber, l_partkey) AS T
    FROM (SELECT Sc, l_extendedprice AS value, l_orderkey, l_linenumber, l_partkey FROM fx_lines)""",
)
def price_curve_every_line(spark, d):
    """The curve over raw rows: groups have no bound, so ranks are distributed."""
    rows = em.lines(spark, d).select("Sc", F.col("l_extendedprice").alias("value"), "l_orderkey", "l_linenumber", "l_partkey")
    ranked = rank_rows(rows, ["Sc"], "value", ["l_orderkey", "l_linenumber", "l_partkey"])
    return ranked.select(recode("Sc", em.LABELS).alias("Sc"), "value", "T")


@query(
    "P26",
    f"""
    SELECT Sc, I, T, value,
      CASE WHEN Sc LIKE '%500C%' THEN '500C' WHEN Sc LIKE '%1000C%' THEN '1000C' END AS cpol,
      CASE WHEN Sc LIKE '%w/ grid%' THEN 'w/ grid' WHEN Sc LIKE '%w/o grid%' THEN 'w/o grid' END AS tpol
    FROM (SELECT {o.recode('Sc', {'3-MEDIUM': '1000C w/ grid', '5-LOW': '500C w/o grid'})} AS Sc, I, T, round({MEAN}, 8) AS value
          FROM fx_mcoe WHERE N LIKE '%JP-%' GROUP BY ALL)""",
)
def policy_facets(spark, d):
    labels = {"3-MEDIUM": "1000C w/ grid", "5-LOW": "500C w/o grid"}
    return prices.with_policy_facets(rounded(prices.slice_price(mcoe_of(spark, d), labels), digits=8))
