"""Flows, net trade and corridor use."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import recode
from scenaria.operators import country_net_flow, directed_flow, shared
from scenaria.plans import trade
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.q_capacity import corridors_of
from scenaria.workload.q_mix import annual_panel_of, scenario_table
from scenaria.workload.registry import as_text, query, rounded

Y = em.PLOT_YEAR
NAMES = {"CHN": "China", "JPN": "Japan", "KOR": "Korea", "MNG": "Mongolia"}


def signed_of(spark, d, value="snd", flows=None):
    flows = em.flows(spark, d, Y) if flows is None else flows
    return trade.flow_of_links(flows, Y, F.col("L").rlike(vocab.AC_LINK), value)


def _labelled(df):
    return df.withColumn("Sc", recode("Sc", em.LABELS))


def heat_of(spark, d):
    return trade.corridor_heat(_labelled(signed_of(spark, d)), Y)


@query("T22 F2 F9 X2 X12 U1 A1 P12 F10", "SELECT Sc, Sy, St, N0, N1, round(value, 4) AS value FROM fx_signed")
def canonical_flow(spark, d):
    return rounded(signed_of(spark, d))


@query(
    "T23",
    f"""
    SELECT Sc, Sy, St, CASE WHEN v < 0 THEN N1 ELSE N0 END AS N0, CASE WHEN v < 0 THEN N0 ELSE N1 END AS N1, round(v, 4) AS value
    FROM (SELECT Sc, YEAR AS Sy, T AS St, N0, N1, sum(CASE WHEN N0 = split_part(L, '-AC_', 1) THEN rec ELSE -rec END) AS v
          FROM fx_flow WHERE YEAR = {Y} GROUP BY ALL) WHERE v <> 0""",
)
def canonical_flow_received(spark, d):
    return rounded(signed_of(spark, d, "rec"))


@query(
    "T22 F2",
    f"""
    SELECT Sc, Sy, St, N0, N1, round(value, 4) AS value FROM fx_signed
    WHERE (N0 = 'CN-01' AND N1 = 'KR') OR (N0 = 'KR' AND N1 = 'JP-00') OR (N0 = 'CN-06' AND N1 = 'MN')""",
)
def canonical_flow_named_links(spark, d):
    links = ["CN-01-AC_KR-AC", "KR-AC_JP-00-AC", "CN-06-AC_MN-AC"]
    return rounded(trade.flow_of_links(em.flows(spark, d, Y), Y, links, "snd"))


@query("T24 F10 P12 A1 P11", "SELECT Sc, Sy, St, N, Sv, round(value, 4) AS value FROM fx_trade")
def directed_node_flow(spark, d):
    return rounded(trade.trade_by_node(signed_of(spark, d)))


@query(
    "T24 §1.5 receive side as argument",
    f"""
    SELECT Sc, Sy, St, N, Sv, round(sum(v), 4) AS value FROM (
      SELECT Sc, YEAR AS Sy, T AS St, N0 AS N, 'export' AS Sv, snd AS v FROM fx_flow WHERE YEAR = {Y}
      UNION ALL SELECT Sc, YEAR, T, N1, 'import', rec FROM fx_flow WHERE YEAR = {Y}) WHERE v <> 0 GROUP BY ALL""",
)
def node_flow_with_losses(spark, d):
    flows = shared(em.flows(spark, d, Y))  # sent and received amounts come from one pass
    return rounded(trade.trade_by_node(signed_of(spark, d, "snd", flows), signed_of(spark, d, "rec", flows)))


@query(
    "T25 R1 P20",
    "SELECT Sc, Sy, St, Sr, import, export, import - export AS value FROM fx_net",
)
def country_net_slices(spark, d):
    return country_net_flow(trade.trade_by_node(signed_of(spark, d)), trade.country_of())


@query("T25 P20 A1 R1 F10 U2", "SELECT Sc, Sr, Sv, round(value, 4) AS value FROM fx_yearly")
def net_trade(spark, d):
    return rounded(trade.yearly_trade(signed_of(spark, d)))


@query(
    "T26 R1 P4 R10",
    """
    SELECT Sc, Sr, round(max(value) FILTER (Sv = 'export') + max(value) FILTER (Sv = 'import'), 4) AS value
    FROM fx_yearly GROUP BY Sc, Sr""",
)
def net_balance(spark, d):
    return rounded(trade.net_balance(trade.yearly_trade(signed_of(spark, d))))


@query(
    "T53 R1 X12 P5",
    f"""
    SELECT Sc, {o.recode('Sr', NAMES)} AS Sr, round(-max(value) FILTER (Sv = 'export'), 4) AS export,
           round(max(value) FILTER (Sv = 'import'), 4) AS import FROM fx_yearly GROUP BY Sc, Sr""",
)
def import_export_pairs(spark, d):
    return rounded(trade.import_export_pairs(trade.yearly_trade(signed_of(spark, d)), NAMES), "export", "import")


@query("T27 F2 P20 P14 A1", "SELECT Sc, Sr, round(dmd, 4) AS dmd FROM fx_demand")
def demand_equivalent(spark, d):
    return rounded(trade.electricity_demand(em.demand(spark, d)), "dmd")


@query(
    "T28 J1 Q2 P13",
    """
    SELECT y.Sc, y.Sr, y.Sv, round(y.value / 1e6, 8) AS value, round(d.dmd / 1e6, 8) AS dmd,
           round(100.0 * y.value / nullif(d.dmd, 0), 4) AS rate
    FROM fx_yearly y LEFT JOIN fx_demand d ON d.Sc = y.Sc AND d.Sr IS NOT DISTINCT FROM y.Sr""",
)
def trade_vs_demand(spark, d):
    """The countries without a code match each other by a NULL-safe key."""
    out = trade.trade_vs_demand(trade.yearly_trade(signed_of(spark, d)), trade.electricity_demand(em.demand(spark, d)))
    return rounded(rounded(out, "value", "dmd", digits=8), "rate")


_HEAT = f"""
    SELECT g.Sc, g.Sv, g.St, coalesce(f.value, 0) AS value,
           TIMESTAMP '{Y}-01-01 00:00:00' + to_hours(CAST({o.slice_hour('g.St')} + 8 AS INTEGER)) AS T
    FROM (SELECT * FROM (SELECT DISTINCT Sc FROM cf), (SELECT DISTINCT Sv FROM cf), (SELECT DISTINCT St FROM cf)) g
    LEFT JOIN cf f ON f.Sc = g.Sc AND f.Sv IS NOT DISTINCT FROM g.Sv AND f.St = g.St"""
_CF = f"""
    WITH cf AS (SELECT {o.recode('Sc', em.LABELS)} AS Sc, {o.end_rules(vocab.FLOW_CORRIDORS)} AS Sv, St, sum(value) AS value
                FROM fx_signed GROUP BY ALL), heat AS ({_HEAT})"""


@query(
    "T29 P21 A1 R4 X21 X14 X15 X16 J9",
    f"""{_CF}
    SELECT Sc, Sv, St, round(value, 4) AS value, strftime(T, '%Y-%m-%d %H:%M:%S') AS T,
           strftime(T + INTERVAL 9 HOUR, '%Y-%m-%d') AS D, CAST(hour(T) AS INTEGER) AS H
    FROM heat""",
)
def flow_heatmap(spark, d):
    return as_text(rounded(heat_of(spark, d)), "T", "D")


@query(
    "T29 J5",
    f"""{_CF}
    SELECT h.Sc, h.Sv, h.St, strftime(h.T, '%Y-%m-%d %H:%M:%S') AS T, strftime(h.T + INTERVAL 9 HOUR, '%Y-%m-%d') AS D, CAST(hour(h.T) AS INTEGER) AS H,
           round(c.value, 4) AS vfs, round(100.0 * h.value / nullif(c.value, 0), 4) AS value
    FROM heat h LEFT JOIN fx_corridor c
      ON c.Sc = h.Sc AND c.Sv = h.Sv AND c.Y5 = {em.BIN_YEAR} AND c.Sv NOT LIKE '%domestic%'""",
)
def flow_utilisation(spark, d):
    out = trade.utilisation(heat_of(spark, d), corridors_of(spark, d), em.BIN_YEAR)
    return as_text(rounded(out, "value", "vfs"), "T", "D")


@query(
    "T30 A10 A1",
    f"""{_CF}
    SELECT Sc, Sv, round(avg(abs(value)), 4) AS mean_abs, round(sum(value), 4) AS total FROM heat GROUP BY ALL""",
)
def flow_mean_abs(spark, d):
    return rounded(trade.corridor_use(heat_of(spark, d)), "mean_abs", "total")


@query(
    "T31 A11",
    f"""{_CF}
    SELECT Sc, Sv, round(min(value) / 1000, 6) AS lo, round(max(value) / 1000, 6) AS hi,
           round(greatest(abs(max(value)), abs(min(value))) / 1000, 6) AS "limit"
    FROM heat WHERE Sv = 'Korea/Japan' GROUP BY ALL""",
)
def symmetric_range(spark, d):
    return rounded(trade.corridor_range(heat_of(spark, d), "Korea/Japan"), "lo", "hi", "limit", digits=6)


_INSIDE = f"""
    SELECT Sc, Sy, CASE WHEN v < 0 THEN N1 ELSE N0 END AS N0, CASE WHEN v < 0 THEN N0 ELSE N1 END AS N1, v AS value
    FROM (SELECT Sc, YEAR AS Sy, N0, N1, sum(CASE WHEN N0 = split_part(L, '-AC_', 1) THEN snd ELSE -snd END) AS v
          FROM fx_flow WHERE YEAR = {Y} AND N0 LIKE '%JP-%' AND N1 LIKE '%JP-%' GROUP BY ALL) WHERE v <> 0"""
_POINTS = """a.centroid_x AS centroid_x0, a.centroid_y AS centroid_y0, b.centroid_x AS centroid_x1, b.centroid_y AS centroid_y1"""


def link_flow_of(spark, d):
    flows = em.flows(spark, d, Y).withColumnRenamed("snd", "value")
    return trade.annual_link_flow(_labelled(flows), Y, em.node_attributes(spark, d), scenario_table(spark, d))


@query(
    "T32 S3 F4 F9 A1 P12 J2 P16",
    f"""
    SELECT s.Scenario AS Sc, f.Sy, f.N0, f.N1, f.value, {_POINTS}, s.scen_dpol AS cat1, s.scen_tpol AS cat2
    FROM ({_INSIDE}) f LEFT JOIN fx_geo a ON a.Sr = f.N0 LEFT JOIN fx_geo b ON b.Sr = f.N1
    LEFT JOIN fx_scen_mat s ON s.Scenario = {o.recode('f.Sc', em.LABELS)}""",
)
def annual_flow_coords(spark, d):
    return link_flow_of(spark, d)


@query(
    "T33 T32 P12 F10",
    f"""
    SELECT Sc, CASE WHEN v < 0 THEN N1 ELSE N0 END AS N0, CASE WHEN v < 0 THEN N0 ELSE N1 END AS N1, v AS value,
           CASE WHEN v < 0 THEN b.centroid_x ELSE a.centroid_x END AS centroid_x0,
           CASE WHEN v < 0 THEN b.centroid_y ELSE a.centroid_y END AS centroid_y0,
           CASE WHEN v < 0 THEN a.centroid_x ELSE b.centroid_x END AS centroid_x1,
           CASE WHEN v < 0 THEN a.centroid_y ELSE b.centroid_y END AS centroid_y1
    FROM (SELECT s.Scenario AS Sc, N0, N1, sum(value) AS v FROM ({_INSIDE}) f
          LEFT JOIN fx_scen_mat s ON s.Scenario = {o.recode('f.Sc', em.LABELS)} GROUP BY ALL)
    LEFT JOIN fx_geo a ON a.Sr = N0 LEFT JOIN fx_geo b ON b.Sr = N1 WHERE v <> 0""",
)
def flow_reoriented_coords(spark, d):
    return trade.annual_flow_arrows(link_flow_of(spark, d))


@query(
    "T32 J1",
    f"""
    SELECT s.Scenario AS Sc, p.Sv, p.Sr, p.Y5, round(p.value, 4) AS value, g.centroid_x, g.centroid_y,
           s.scen_dpol AS cat1, s.scen_tpol AS cat2
    FROM fx_panel p LEFT JOIN fx_geo g ON g.Sr = p.Sr LEFT JOIN fx_scen_mat s ON s.Scenario = p.Sc
    WHERE p.Sv = 'Trd_Sec_Ene_Ele' AND p.Sr LIKE '%JP-%' AND p.Y5 = {em.BIN_YEAR}""",
)
def node_energy_balance(spark, d):
    nodes = em.node_attributes(spark, d)
    return rounded(trade.node_energy_balance(annual_panel_of(spark, d), nodes, scenario_table(spark, d), em.BIN_YEAR))


@query("T24 F10", "SELECT Sc, Sy, St, N0, N1, round(value, 4) AS value FROM fx_directed")
def gross_directed_flow(spark, d):
    return rounded(directed_flow(signed_of(spark, d)))
