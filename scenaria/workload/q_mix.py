"""Scenario matrix, panels and generation mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.operators import attach_dimension, display_order, pivot_longer, pivot_wider
from scenaria.plans import mix, panel
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.registry import query, rounded

ALL = list(em.LABELS.values())
SHOWN = ["w/o grid", "w/ grid"]
REGIONS = ["JPN", "CHN", "KR", "MN", "NEA"]
REGION_LABELS = {"KR": "KOR", "MN": "MNG"}
TECH = mix.names(vocab.ANNUAL)
NO_LOSS = f"Sv NOT IN {o.in_list(vocab.ANNUAL_OUTFLOWS)}"
ROWS = f"Sr IN {o.in_list(REGIONS)} AND Sc IN {o.in_list(SHOWN)}"


def scenario_table(spark, d):
    return panel.scenario_matrix(em.scenarios(spark, d), em.LABELS)


def annual_panel_of(spark, d):
    return panel.annual_panel(em.annual(spark, d), em.LABELS, ALL, em.year_bins(spark, d))


def mix_of(spark, d):
    return mix.generation_mix(annual_panel_of(spark, d), vocab.ANNUAL, scenario_table(spark, d))


@query("T1 F1 P5", "SELECT Scenario, Status, scen_dpol, scen_tpol FROM fx_scen_mat")
def scenario_matrix(spark, d):
    return scenario_table(spark, d)


@query("T1 F1", "SELECT Scenario, Status, scen_dpol, scen_tpol FROM fx_scen WHERE Status = 'Infeasible'")
def scenario_infeasible(spark, d):
    return panel.scenario_matrix(em.scenarios(spark, d), em.LABELS, feasible=False)


@query(
    "T3 F2 F3 J8",
    "SELECT Sc, Sv, Sr, St, value FROM fx_hourly WHERE Sc IN ('w/o grid', 'w/ grid')"
    " AND Sc IN (SELECT Scenario FROM fx_scen_mat)",
)
def semi_join_scenarios(spark, d):
    return panel.hourly_panel(em.hourly(spark, d), {}, SHOWN, scenario_table(spark, d))


@query("T2 A2 R3 R11 X8", "SELECT Sc, Sv, Sr, Y5, round(value, 4) AS value FROM fx_panel")
def annual_panel_dense(spark, d):
    """Bins as observed in the panel itself."""
    return rounded(panel.annual_panel(em.annual(spark, d), em.LABELS, ALL))


@query(
    "T2 R3",
    f"SELECT Sc, Sv, Sr, Y5, round(value, 4) AS value FROM fx_panel WHERE Sc IN {o.in_list(SHOWN)}",
)
def annual_panel_given_bins(spark, d):
    """Known horizon: no second look at the data for the bins."""
    return rounded(panel.annual_panel(em.annual(spark, d), em.LABELS, SHOWN, bins=[1995, 2000, 2005]))


@query(
    "T2 R3",
    f"""
    SELECT p.Sc, p.Sv, p.Sr, p.Y5, round(p.value, 4) AS value FROM fx_panel p
    LEFT JOIN fx_means m ON m.Sc = p.Sc AND m.Sv = p.Sv AND m.Sr = p.Sr AND m.Y5 = p.Y5
    WHERE p.Sc IN {o.in_list(SHOWN)} AND (p.Y5 IN (1995, 2000) OR m.Sc IS NOT NULL)""",
)
def annual_panel_outside_bins(spark, d):
    """A horizon shorter than the data: later bins stay where a series has them."""
    return rounded(panel.annual_panel(em.annual(spark, d), em.LABELS, SHOWN, bins=[1995, 2000]))


@query("T4 F3 P5 A1 P16", "SELECT Sc, Sv, Sr, Y5, round(value, 4) AS value, cat1, cat2 FROM fx_mix")
def generation_mix(spark, d):
    return rounded(mix_of(spark, d))


@query(
    "P17 D1 S7 S8 J1",
    f"""
    SELECT m.Sc, m.Sv, m.Sr, m.Y5, round(m.value, 4) AS value, m.cat1, m.cat2,
           {o.lookup('m.Sv', {v.Variable: v.Legend for v in vocab.ANNUAL})} AS legend,
           {o.lookup('m.Sv', {v.Variable: v.Color for v in vocab.ANNUAL})} AS color,
           CAST(list_position([{', '.join(o.lit(t) for t in TECH)}], m.Sv) AS INTEGER) AS ord
    FROM fx_mix m""",
)
def legend_lookup(spark, d):
    return rounded(attach_dimension(mix_of(spark, d), vocab.ANNUAL, "Sv"))


@query(
    "T5 P8 P13 P15 O3",
    f"""
    SELECT Sc, Sv, {o.recode('Sr', REGION_LABELS)} AS Sr, Y5, cat1, cat2,
           round({o.flip('Sv', 'value', vocab.ANNUAL_OUTFLOWS)} / 1000, 4) AS value,
           CAST(list_position([{', '.join(o.lit(t) for t in reversed(TECH))}], Sv) AS INTEGER) AS ord
    FROM fx_mix WHERE {ROWS}""",
)
def signed_regional_view(spark, d):
    return rounded(
        mix.regional_view(mix_of(spark, d), REGIONS, SHOWN, vocab.ANNUAL, REGION_LABELS, divisor=1e3)
    )


@query(
    "T6 W1 P14",
    f"""
    SELECT Sc, Sv, Sr, Y5, cat1, cat2, round(value, 4) AS value,
           round(100.0 * value / nullif(sum(value) OVER (PARTITION BY Sc, Sr), 0), 4) AS share
    FROM fx_mix WHERE {ROWS} AND {NO_LOSS} AND Y5 = {em.BIN_YEAR}""",
)
def generation_share(spark, d):
    return rounded(mix.technology_share(mix_of(spark, d), REGIONS, SHOWN, em.BIN_YEAR), "value", "share")


_SHARE_COLS = ", ".join(
    f"round(coalesce(sum(share) FILTER (Sv = {o.lit(t)}), 0), 4) AS \"{t}\"" for t in TECH if t not in vocab.ANNUAL_OUTFLOWS
)


@query(
    "T6 R1 R12 W1",
    f"""
    SELECT Sc, Sr, Y5, {_SHARE_COLS},
           round(coalesce(sum(share) FILTER (Sv IN {o.in_list(vocab.WIND_AND_SOLAR)}), 0), 4) AS "Sec_Ene_Ele_WinSol"
    FROM (SELECT *, 100.0 * value / nullif(sum(value) OVER (PARTITION BY Sc, Sr, Y5), 0) AS share
          FROM fx_mix WHERE Sr = 'JPN' AND Sc IN {o.in_list(SHOWN)} AND {NO_LOSS}) GROUP BY Sc, Sr, Y5""",
)
def share_table(spark, d):
    tech = [t for t in TECH if t not in vocab.ANNUAL_OUTFLOWS]
    wide = mix.share_table(mix.technology_share(mix_of(spark, d), ["JPN"], SHOWN), tech)
    return rounded(wide, *tech, "Sec_Ene_Ele_WinSol")


@query(
    "T7 A1",
    f"""
    SELECT Sc, Sr, round(sum(value), 4) AS value FROM fx_mix
    WHERE {ROWS} AND {NO_LOSS} AND Y5 = {em.BIN_YEAR} GROUP BY Sc, Sr""",
)
def generation_total(spark, d):
    return rounded(mix.generation_total(mix_of(spark, d), REGIONS, SHOWN, em.BIN_YEAR))


@query(
    "T8 R10",
    f"""
    SELECT cat1, Sv, Sr, Y5, round(coalesce(sum(v) FILTER (cat2 = 'w/ grid'), 0)
           - coalesce(sum(v) FILTER (cat2 = 'w/o grid'), 0), 4) AS value
    FROM (SELECT *, {o.flip('Sv', 'value', vocab.ANNUAL_OUTFLOWS)} AS v FROM fx_mix
          WHERE Sr LIKE 'JP-%' AND Y5 = {em.BIN_YEAR}) GROUP BY cat1, Sv, Sr, Y5""",
)
def scenario_contrast(spark, d):
    return rounded(mix.grid_effect(mix_of(spark, d), "JP-", em.BIN_YEAR))


_GROUPS = {"JP-00": "North", "JP-05": "East", "JP-10": "Centre"}
_ORDER = ["North", "East", "Centre", "JP-15"]


@query(
    "T9 F4 P8 P5 P15",
    f"""
    SELECT Sc, Sv, Y5, cat1, cat2, round(value, 4) AS value,
           CASE WHEN r IN {o.in_list(_ORDER)} THEN r END AS Sr,
           CAST(coalesce(list_position([{', '.join(o.lit(x) for x in _ORDER)}], r), 0) AS INTEGER) AS ord
    FROM (SELECT *, {o.recode('Sr', _GROUPS)} AS r FROM fx_mix
          WHERE Y5 = {em.BIN_YEAR} AND Sr LIKE 'JP-%' AND Sc IN {o.in_list(SHOWN)} AND {NO_LOSS})""",
)
def subnational_mix(spark, d):
    out = mix.subnational_mix(mix_of(spark, d), "JP-", SHOWN, em.BIN_YEAR, _GROUPS, _ORDER)
    return rounded(out).na.fill({"ord": 0})


@query(
    "P6 A15 T4",
    f"""
    SELECT s.Scenario AS Sc, p.Sv, p.Sr, p.Y5, round(p.value, 4) AS value, s.scen_dpol AS cat1, s.scen_tpol AS cat2
    FROM (SELECT Sc, {o.recode('Sv', vocab.SMALL_SOURCES_AS_OTHER)} AS Sv, Sr, Y5, sum(value) AS value
          FROM fx_panel GROUP BY ALL) p
    LEFT JOIN fx_scen_mat s ON s.Scenario = p.Sc
    WHERE p.Sv IN {o.in_list(mix.names(vocab.ANNUAL_WITH_OTHER))}""",
)
def collapsed_mix(spark, d):
    return rounded(
        mix.generation_mix(
            annual_panel_of(spark, d),
            vocab.ANNUAL_WITH_OTHER,
            scenario_table(spark, d),
            merge=vocab.SMALL_SOURCES_AS_OTHER,
            merge_first=True,
        )
    )


_FOSSIL_SQL = """CASE WHEN Sv IN ('Sec_Ene_Ele_Coa_wo_CCS', 'Sec_Ene_Ele_Oil', 'Sec_Ene_Ele_Gas_wo_CCS')
      THEN 'Sec_Ene_Ele_Fos_wo_CCS'
    WHEN Sv IN ('Sec_Ene_Ele_Coa_w_CCS', 'Sec_Ene_Ele_Gas_w_CCS') THEN 'Sec_Ene_Ele_Fos_w_CCS'
    WHEN Sv LIKE '%Sec\\_Ene\\_Ele\\_Win%' ESCAPE '\\' THEN 'Sec_Ene_Ele_Win'
    WHEN Sv LIKE '%Sec\\_Ene\\_Ele\\_Solar%' ESCAPE '\\' THEN 'Sec_Ene_Ele_Solar' ELSE Sv END"""


def fossil_mix_of(spark, d):
    return mix.generation_mix(
        mix.without_losses(annual_panel_of(spark, d)),
        vocab.ANNUAL,
        scenario_table(spark, d),
        merge=mix.fossil_and_renewable_groups(),
    )


@query(
    "P7 T4 A15",
    f"""
    SELECT Sc, {_FOSSIL_SQL} AS Sv, Sr, Y5, cat1, cat2, round(sum(value), 4) AS value
    FROM fx_mix WHERE {NO_LOSS} GROUP BY ALL""",
)
def fossil_grouped_mix(spark, d):
    return rounded(fossil_mix_of(spark, d))


@query(
    "D7",
    f"""
    SELECT Sc, Sv, Sr, Y5, cat1, cat2, round({o.flip('Sv', 'value', vocab.ANNUAL_OUTFLOWS)} / 1e6, 8) AS value
    FROM fx_mix WHERE Sr = 'JPN'""",
)
def genmix_summary(spark, d):
    return rounded(mix.annual_summary(mix_of(spark, d), "JPN"), digits=8)


@query(
    "T10 F1 P7 A14",
    """
    SELECT Sc, CASE WHEN value > 0 THEN 'import' ELSE 'export' END AS Sv, Sr, round(sum(value), 4) AS value
    FROM fx_hourly WHERE Sv = 'Trd_Sec_Ene_Ele' AND value <> 0 GROUP BY ALL""",
)
def import_export_from_sign(spark, d):
    return rounded(mix.trade_volume(em.hourly(spark, d)))


@query(
    "R1 R2 Q16",
    f"""
    SELECT g.Sc, g.Sr, g.Y5, g.Sv, round(coalesce(sum(m.value), 0), 4) AS value FROM (
      SELECT k.Sc, k.Sr, k.Y5, n.Sv FROM (SELECT DISTINCT Sc, Sr, Y5 FROM fx_mix) k
      CROSS JOIN (SELECT unnest({vocab.WIND_AND_SOLAR}) AS Sv) n) g
    LEFT JOIN fx_mix m ON m.Sc IS NOT DISTINCT FROM g.Sc AND m.Sr = g.Sr AND m.Y5 = g.Y5 AND m.Sv = g.Sv
    GROUP BY ALL""",
)
def wide_and_back(spark, d):
    m = mix_of(spark, d)
    ids = ["Sc", "Sr", "Y5"]
    wide = pivot_wider(m, ids, "Sv", "value", vocab.WIND_AND_SOLAR, fill=0.0)
    return rounded(pivot_longer(wide, ids, vocab.WIND_AND_SOLAR, "Sv", "value"))


@query(
    "A12 U3",
    "SELECT count(DISTINCT Sv) AS n_sv, count(DISTINCT Sr) AS n_sr, count(DISTINCT Sc) AS n_sc,"
    " count(DISTINCT cat2) AS n_cat2 FROM fx_mix",
)
def domain_sizes(spark, d):
    m = mix_of(spark, d)
    return m.agg(*[F.countDistinct(c).alias(f"n_{c.lower()}") for c in ("Sv", "Sr", "Sc", "cat2")])


@query(
    "O1 O2 O3 P15",
    f"""
    SELECT Sc, Sv, Sr, Y5, cat1, cat2, round({o.flip('Sv', 'value', vocab.ANNUAL_OUTFLOWS)} / 1000, 4) AS value,
           CAST(list_position([{', '.join(o.lit(t) for t in reversed(TECH))}], Sv) AS INTEGER) AS ord
    FROM fx_mix WHERE Sr = 'NEA' AND Sc IN {o.in_list(SHOWN)} ORDER BY Sc, Y5, ord""",
)
def mix_in_display_order(spark, d):
    view = mix.regional_view(mix_of(spark, d), ["NEA"], SHOWN, vocab.ANNUAL, divisor=1e3)
    return display_order(rounded(view), "Sc", "Y5", "ord")
