"""Hourly and daily balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import hour_window, month_day
from scenaria.operators import is_unused
from scenaria.plans import balance
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.q_mix import scenario_table
from scenaria.workload.registry import as_text, query, rounded

YEAR = 2024
WINDOW = ("2024-01-08", "2024-01-14")
FIRST, LAST = hour_window(*WINDOW)
STAMP = f"strftime(TIMESTAMP '{YEAR}-01-01 00:00:00' + to_hours(CAST(T + 23 AS INTEGER)), '%Y-%m-%d %H:%M:%S')"
DAY = f"strftime(DATE '{YEAR}-01-01' + (D - 1), '%Y-%m-%d')"
SIGNED = o.flip("Sv", "value", vocab.HOURLY_OUTFLOWS)


def balance_of(spark, d):
    return balance.hourly_balance(em.hourly(spark, d), vocab.HOURLY, scenario_table(spark, d))


def daily_of(spark, d):
    return balance.daily_balance(balance_of(spark, d))


@query("T35 F3 R4 X21 P16 J9 Q19", "SELECT Sc, Sv, Sr, St, round(value, 4) AS value, CAST(T AS INTEGER) AS T, cat1, cat2 FROM fx_hr")
def hourly_balance_dense(spark, d):
    return rounded(balance_of(spark, d))


@query("T36 X9 A16 F1", "SELECT Sc, Sv, Sr, D, cat1, cat2, round(value, 4) AS value FROM fx_da")
def daily_balance(spark, d):
    return rounded(daily_of(spark, d))


@query(
    "T37 D5 F1 P8 X13 X20",
    f"""
    SELECT Sc, Sv, Sr, {DAY} AS D, cat1, cat2, round({SIGNED} / 1000, 6) AS value,
           strftime(DATE '{YEAR}-01-01' + (D - 1), '%b %d') AS label
    FROM fx_da WHERE Sr = 'JPN' AND value <> 0""",
)
def daily_dated_view(spark, d):
    view = balance.dispatch_daily_summary(daily_of(spark, d), "JPN", YEAR)
    return as_text(rounded(view, digits=6).withColumn("label", month_day("D")), "D")


@query(
    "D6",
    f"""
    SELECT Sc, Sv, Sr, {DAY} AS D, cat1, cat2, round({SIGNED} / 1000, 6) AS value
    FROM fx_da WHERE Sr = 'KR' AND Sc = 'w/ grid' AND value <> 0""",
)
def dispatch_daily_scenario(spark, d):
    return as_text(rounded(balance.dispatch_daily_scenario(daily_of(spark, d), "KR", YEAR, "w/ grid"), digits=6), "D")


@query(
    "T37 F5",
    f"""
    SELECT Sc, Sv, Sr, {DAY} AS D, cat1, cat2, round({SIGNED} / 1000, 6) AS value
    FROM fx_da WHERE Sr = 'JPN' AND value <> 0 AND (Sc = 'w/ grid' OR Sv <> 'Trd_Sec_Ene_Ele')""",
)
def daily_view_trade_hidden(spark, d):
    return as_text(rounded(balance.daily_view(daily_of(spark, d), "JPN", YEAR, trade_only_in="w/ grid"), digits=6), "D")


@query(
    "T38 F7 D2 D3 P8 X14",
    f"""
    SELECT Sc, Sv, Sr, St, cat1, cat2, {STAMP} AS T, round({SIGNED} / 1000, 6) AS value
    FROM fx_hr WHERE Sr = 'JPN' AND T BETWEEN {FIRST} AND {LAST} AND value <> 0""",
)
def hour_window_view(spark, d):
    return as_text(rounded(balance.dispatch_hourly_summary(balance_of(spark, d), WINDOW, "JPN", YEAR), digits=6), "T")


@query(
    "D4 D8",
    f"""
    SELECT Sc, Sv, Sr, St, cat1, cat2, {STAMP} AS T, round({SIGNED} / 1000, 6) AS value
    FROM fx_hr WHERE Sr = 'JPN' AND Sc = 'w/ grid' AND T BETWEEN {FIRST} AND {LAST} AND value <> 0""",
)
def dispatch_hourly_scenario(spark, d):
    return as_text(rounded(balance.dispatch_hourly_scenario(balance_of(spark, d), WINDOW, "JPN", YEAR, "w/ grid"), digits=6), "T")


@query(
    "T38 F7 U1 P11",
    f"""
    SELECT Sc, Sv, Sr, {STAMP} AS T, round({SIGNED} / 1000, 6) AS value, 'bar' AS layer
    FROM fx_hr WHERE Sr = 'JPN' AND T BETWEEN {FIRST} AND {LAST} AND value <> 0
    UNION ALL
    SELECT Sc, Sv, Sr, {STAMP}, round(value / 1000, 6), 'line'
    FROM (SELECT *, {o.slice_hour('St', 9)} AS T FROM fx_hourly) WHERE Sv = 'Fin_Ene_Ele' AND Sr = 'JPN' AND T BETWEEN {FIRST} AND {LAST}""",
)
def window_with_overlay(spark, d):
    bars = balance.hourly_window(balance_of(spark, d), "JPN", YEAR, WINDOW)
    line = balance.demand_line(em.hourly(spark, d), "JPN", YEAR, WINDOW, em.EVENT_SCENARIO)
    return as_text(rounded(balance.window_with_overlay(bars, line), digits=6), "T")


_ROLES = {
    "Sec_Ene_Ele_inc_Cur_Solar_Cen": "Solar",
    "Sec_Ene_Ele_inc_Cur_Win_Ons": "Wind",
    "Sec_Ene_Ele_Sto_Dis_LiB": "Discharge",
    "Trd_Sec_Ene_Ele": "Transmission",
}


@query(
    "T35 P6 A15 R4",
    f"""
    WITH roles AS (SELECT Sc, {o.recode('Sv', _ROLES)} AS Sv, Sr, St, sum(value) AS value FROM fx_hourly GROUP BY ALL),
    kept AS (SELECT * FROM roles WHERE Sv IN ('Solar', 'Wind', 'Discharge', 'Transmission'))
    SELECT g.Sc, g.Sv, g.Sr, g.St, round(coalesce(k.value, 0), 4) AS value, CAST({o.slice_hour('g.St', 9)} AS INTEGER) AS T,
           s.scen_dpol AS cat1, s.scen_tpol AS cat2
    FROM (SELECT * FROM (SELECT DISTINCT Sc FROM kept), (SELECT DISTINCT Sv FROM kept), (SELECT DISTINCT Sr FROM kept),
                        (SELECT DISTINCT St FROM kept)) g
    LEFT JOIN kept k ON k.Sc = g.Sc AND k.Sv = g.Sv AND k.Sr = g.Sr AND k.St = g.St
    LEFT JOIN fx_scen_mat s ON s.Scenario = g.Sc""",
)
def hourly_role_balance(spark, d):
    out = balance.hourly_balance(
        em.hourly(spark, d), vocab.HOURLY_BY_ROLE, scenario_table(spark, d), merge={**vocab.HOURLY_TO_ROLE, **_ROLES}
    )
    return rounded(out)


@query(
    "T35 given slices S2",
    f"""
    SELECT k.Sc, k.Sv, k.Sr, g.St, round(coalesce(h.value, 0), 4) AS value, CAST({o.slice_hour('g.St', 9)} AS INTEGER) AS T,
           s.scen_dpol AS cat1, s.scen_tpol AS cat2
    FROM (SELECT * FROM (SELECT DISTINCT Sc FROM fx_hourly), (SELECT DISTINCT Sv FROM fx_hourly),
                        (SELECT DISTINCT Sr FROM fx_hourly)) k
    CROSS JOIN (SELECT DISTINCT 'D' || lpad(CAST(dayofyear(ts) AS VARCHAR), 3, '0') || 'H' || lpad(CAST(x AS VARCHAR), 2, '0') AS St
                FROM events CROSS JOIN (SELECT unnest(range(0, 24)) AS x)) g
    LEFT JOIN fx_hourly h ON h.Sc = k.Sc AND h.Sv = k.Sv AND h.Sr = k.Sr AND h.St = g.St
    LEFT JOIN fx_scen_mat s ON s.Scenario = k.Sc""",
)
def hourly_balance_slice_set(spark, d):
    """The slice domain comes from its own table: all hours of all days seen."""
    days = em.table(spark, d, "events").select(F.dayofyear("ts").alias("day")).distinct()
    hours = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    slices = hours.select(F.concat(F.lit("D"), pad("day", 3), F.lit("H"), pad("h", 2)).alias("St"))
    return rounded(balance.hourly_balance(em.hourly(spark, d), vocab.HOURLY, scenario_table(spark, d), slices))


@query("T54 F2", "SELECT Sv, count(*) AS n_rows, count(DISTINCT D) AS n_days FROM fx_da WHERE Sv IN ('Trd_Sec_Ene_Ele', 'Sec_Ene_Ele_Sto_Cha_Gro_PHS') GROUP BY Sv")
def variable_presence(spark, d):
    return balance.variable_presence(daily_of(spark, d), ["Trd_Sec_Ene_Ele", "Sec_Ene_Ele_Sto_Cha_Gro_PHS"])


@query(
    "A12 A13 U3",
    "SELECT count(DISTINCT cat1) AS ncat1, count(DISTINCT cat2) AS ncat2, bool_and(cat2 IS NULL) AS cat2_unused FROM fx_hr",
)
def facet_counts(spark, d):
    return balance.facet_counts(balance_of(spark, d))


@query("A13", "SELECT bool_and(scen_dpol IS NULL) AS scen_dpol, bool_and(scen_tpol IS NULL) AS scen_tpol FROM fx_scen_mat")
def unused_dimension(spark, d):
    return is_unused(scenario_table(spark, d), ["scen_dpol", "scen_tpol"])
