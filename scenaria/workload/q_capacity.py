"""Link, generator and storage capacities."""

from __future__ import annotations

from scenaria import vocab
from scenaria.operators import as_category, attach_dimension
from scenaria.plans import capacity
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.q_mix import ALL, SHOWN, scenario_table
from scenaria.workload.registry import query, rounded

SCOPE = "CASE WHEN Sv LIKE '%domestic%' THEN 'domestic' WHEN Sv IS NOT NULL THEN 'international' END"
LINK_GROUPS = {"JP-05 / JP-10": "Other", "JP-10 / JP-15": "Other", "JP-15 / JP-20": "Other"}
NAMED = "replace(replace(PW_LNK, '-AC', ''), '_', ' / ')"
SC = o.recode("Sc", em.LABELS)


def link_cap_of(spark, d):
    return capacity.link_capacity(em.link_capacity(spark, d))


def corridors_of(spark, d):
    return capacity.corridor_capacity(link_cap_of(spark, d), em.LABELS, ALL)


@query("T11 F4 X8 A2 P10", "SELECT Sc, PW_LNK, Y5, round(value, 4) AS value FROM fx_lnk_cap")
def link_capacity_bins(spark, d):
    return rounded(link_cap_of(spark, d))


@query("T12 P18 P21 A1 A9 P22 P5", f"SELECT Sc, Sv, Y5, round(value, 4) AS value, {SCOPE} AS Flag FROM fx_corridor")
def corridor_capacity(spark, d):
    return rounded(corridors_of(spark, d))


@query(
    "T12 P15 O3",
    f"""
    SELECT Sc, Sv, Y5, round(value, 4) AS value, {SCOPE} AS Flag,
           CAST(list_position([{', '.join(o.lit(c) for c in vocab.CORRIDOR_ORDER)}], Sv) AS INTEGER) AS ord
    FROM fx_corridor""",
)
def corridor_display_order(spark, d):
    return rounded(as_category(corridors_of(spark, d), "Sv", vocab.CORRIDOR_ORDER, ord_col="ord"))


@query(
    "T17 P17 D1 J1",
    f"""
    SELECT Sc, Sr, Sv, Sy, value, {o.lookup('Sv', {v.Variable: v.Legend for v in vocab.CAPACITY})} AS legend,
           {o.lookup('Sv', {v.Variable: v.Color for v in vocab.CAPACITY})} AS color,
           CAST(list_position([{', '.join(o.lit(v.Variable) for v in vocab.CAPACITY)}], Sv) AS INTEGER) AS ord
    FROM fx_gen_cap""",
)
def generator_capacity_legend(spark, d):
    return attach_dimension(capacity.generator_capacity(em.gen_capacity(spark, d)), vocab.CAPACITY, "Sv")


@query(
    "T12 P21 P22",
    f"""
    SELECT Sc, Sv, Y5, round(value, 4) AS value,
           CASE WHEN Sv LIKE '%-%' THEN 'international' WHEN Sv IS NOT NULL THEN 'domestic' END AS Flag
    FROM (SELECT {SC} AS Sc, {o.end_rules(vocab.CAPACITY_CORRIDORS_SHORT)} AS Sv, Y5, sum(value) AS value
          FROM fx_lnk_cap GROUP BY ALL) WHERE Sc IN {o.in_list(SHOWN)}""",
)
def corridor_capacity_short(spark, d):
    return rounded(
        capacity.corridor_capacity(
            link_cap_of(spark, d), em.LABELS, SHOWN, vocab.CAPACITY_CORRIDORS_SHORT, capacity.short_scope()
        )
    )


@query(
    "T12 J1 P16",
    f"""
    SELECT c.Sc, c.Sv, c.Y5, round(c.value, 4) AS value, {SCOPE} AS Flag, s.scen_dpol AS cat1, s.scen_tpol AS cat2
    FROM fx_corridor c LEFT JOIN fx_scen_mat s ON s.Scenario = c.Sc""",
)
def corridor_with_category(spark, d):
    return rounded(
        capacity.corridor_capacity(link_cap_of(spark, d), em.LABELS, ALL, scenarios=scenario_table(spark, d))
    )


_GIVEN = [*SHOWN, "outlook"]


@query(
    "T13 F1 R6",
    f"""
    SELECT k.Sv, k.Y5, k.Flag, s.Sc, round(coalesce(c.value, 0), 4) AS value
    FROM (SELECT DISTINCT Sv, Y5, 'international' AS Flag FROM fx_corridor
          WHERE Sv NOT LIKE '%domestic%' AND Sc IN {o.in_list(SHOWN)}) k
    CROSS JOIN (SELECT unnest({_GIVEN}) AS Sc) s
    LEFT JOIN fx_corridor c ON c.Sv = k.Sv AND c.Y5 = k.Y5 AND c.Sc = s.Sc""",
)
def corridor_complete(spark, d):
    corridors = capacity.corridor_capacity(link_cap_of(spark, d), em.LABELS, SHOWN)
    return rounded(capacity.corridor_complete(corridors, _GIVEN))


@query(
    "T14 P18 F4 P19 P5 P6 A1",
    f"""
    SELECT {SC} AS Sc, {o.recode(NAMED, LINK_GROUPS)} AS Sv, Y5, round(sum(value), 4) AS value
    FROM fx_lnk_cap WHERE N1 LIKE '%JP-%' AND Y5 >= 2000 GROUP BY ALL""",
)
def readable_links_other(spark, d):
    return rounded(capacity.domestic_links(link_cap_of(spark, d), em.LABELS, ALL, LINK_GROUPS, first_year=2000))


@query(
    "T15 R10",
    f"""
    SELECT {NAMED} AS Sv, Y5, round(max(value) FILTER ({SC} = 'w/ grid') - max(value) FILTER ({SC} = 'w/o grid'), 4) AS value
    FROM fx_lnk_cap WHERE N1 LIKE '%JP-%' AND PW_LNK NOT LIKE '%KR%' AND {SC} IN ('w/ grid', 'w/o grid') GROUP BY ALL""",
)
def link_delta(spark, d):
    return rounded(capacity.link_difference(link_cap_of(spark, d), em.LABELS, "w/ grid", "w/o grid", first_year=1990))


_ENDS = f"""
    SELECT {SC} AS Sc, replace(N0, '-AC', '') AS N0, replace(N1, '-AC', '') AS N1, Y5, value / 1000 AS value
    FROM fx_lnk_cap WHERE N1 LIKE '%JP-%' AND Y5 = {em.BIN_YEAR} AND {SC} IN {o.in_list(SHOWN)}"""


@query(
    "T16 P18 X4 J2 P13",
    f"""
    SELECT l.Sc, l.N0, l.N1, l.Y5, round(l.value, 6) AS value, a.centroid_x AS x0, a.centroid_y AS y0,
           b.centroid_x AS x1, b.centroid_y AS y1
    FROM ({_ENDS}) l LEFT JOIN fx_geo a ON a.Sr = l.N0 LEFT JOIN fx_geo b ON b.Sr = l.N1""",
)
def link_with_endpoints(spark, d):
    nodes = em.node_attributes(spark, d)
    return rounded(
        capacity.links_with_coordinates(link_cap_of(spark, d), nodes, em.LABELS, SHOWN, em.BIN_YEAR), digits=6
    )


@query(
    "A11 T16",
    f"""
    SELECT round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(greatest(abs(max(value)), abs(min(value))), 6) AS "limit"
    FROM ({_ENDS})""",
)
def link_width_range(spark, d):
    nodes = em.node_attributes(spark, d)
    links = capacity.links_with_coordinates(link_cap_of(spark, d), nodes, em.LABELS, SHOWN, em.BIN_YEAR)
    return rounded(capacity.link_width_range(links), "lo", "hi", "limit", digits=6)


@query("T17 J4 F8 P4", "SELECT Sc, Sr, Sv, Sy, value FROM fx_gen_cap")
def generator_capacity(spark, d):
    return capacity.generator_capacity(em.gen_capacity(spark, d))


@query(
    "J4 F4 F8", "SELECT Sc, Sr, Sv, Sy, value FROM fx_gen_cap WHERE Sr LIKE '%JP-%'"
)
def generator_capacity_one_country(spark, d):
    return capacity.generator_capacity(em.gen_capacity(spark, d), "JP-")


@query("T18 F4 P18 P24 P23", "SELECT Sc, Sr, Sv, Sy, value FROM fx_inner WHERE Sr LIKE 'JP-%'")
def bus_asset_class(spark, d):
    return capacity.intra_node_power(em.link_capacity(spark, d), em.SITE_PATTERN)


@query("T18 F12", "SELECT Sc, Sr, Sv, Sy, value FROM fx_inner WHERE Sv NOT IN ('Cap_Ele_H2_GT', 'Cap_Ele_H2_FC', 'Cap_Hyd_Sto_H2S_Pow')")
def self_link_power(spark, d):
    """Links whose ends are the same node once the bus suffix is off."""
    return capacity.intra_node_power(em.link_capacity(spark, d), em.SITE_PATTERN, node_pattern=None, self_links=True)


@query("T19 J4 F8 P20 X8 A2", "SELECT Sc, Sr, Sr2, Sv, Y5, round(value, 4) AS value FROM fx_sto_binned")
def storage_capacity(spark, d):
    return rounded(capacity.storage_capacity(em.sto_capacity(spark, d), em.LABELS, ALL))


@query(
    "T20 U1 P10 P20 A2",
    f"""
    SELECT {SC} AS Sc, Sr, {o.country('Sr')} AS Sr2, Sv, {o.year_bin('Sy')} AS Y5, round(avg(value), 4) AS value
    FROM (SELECT Sc, Sr, Sv, Sy, value FROM fx_gen_cap UNION ALL SELECT Sc, Sr, Sv, Sy, value FROM fx_inner
          UNION ALL SELECT Sc, Sr, Sv, Sy, value FROM fx_sto_cap) WHERE {SC} IN {o.in_list(SHOWN)} GROUP BY ALL""",
)
def union_by_name(spark, d):
    return rounded(
        capacity.technology_capacity(
            em.gen_capacity(spark, d),
            em.link_capacity(spark, d),
            em.sto_capacity(spark, d),
            em.LABELS,
            SHOWN,
            em.SITE_PATTERN,
        )
    )


_STORE = f"FROM fx_sto_binned WHERE Sv IN {o.in_list(vocab.STORAGE_LABEL)} AND Y5 = {em.BIN_YEAR}"


@query(
    "T21 A8 A1 P5 F1",
    f"""
    SELECT Sc, Sr2, 'Li-ion battery' AS Sv, Y5, round(sum(value), 4) AS value {_STORE} AND Sv = 'Cap_Ele_Sto_LiB_Ene'
    GROUP BY Sc, Sr2, Sv, Y5
    UNION ALL
    SELECT Sc, 'Total', 'Li-ion battery', Y5, round(sum(value), 4) {_STORE} AND Sv = 'Cap_Ele_Sto_LiB_Ene'
    GROUP BY Sc, Sv, Y5""",
)
def storage_with_total(spark, d):
    storage = capacity.storage_capacity(em.sto_capacity(spark, d), em.LABELS, ALL)
    return rounded(capacity.storage_by_country(storage, em.BIN_YEAR))


@query(
    "T21 A1",
    f"SELECT Sc, Sr, {o.recode('Sv', vocab.STORAGE_LABEL)} AS Sv, Y5, round(value, 4) AS value {_STORE}",
)
def storage_by_node(spark, d):
    storage = capacity.storage_capacity(em.sto_capacity(spark, d), em.LABELS, ALL)
    return rounded(capacity.storage_by_node(storage, em.BIN_YEAR))


_R = o.lookup("p_type", em.TYPE_RENEWABLE)
_ASKED = {"3-MEDIUM": "installed in w/ grid", "5-LOW": "installed in w/o grid"}


@query(
    "T34 J3 R11 U1 P2 P5 A1",
    f"""
    WITH most AS (SELECT N, {_R} AS R, sum(l_quantity) AS value FROM fx_part_lines WHERE N LIKE '%JP-%' GROUP BY ALL),
    built AS (SELECT Sc, N, {_R} AS R, sum(l_quantity) AS value FROM fx_part_lines JOIN fx_supplier ON l_suppkey = s_suppkey
              WHERE l_returnflag = 'R' AND N0 = N GROUP BY ALL)
    SELECT N, Sv, {o.recode('R', vocab.RENEWABLE_LABEL)} AS R, value FROM (
      SELECT m.N, m.R, s.label AS Sv, coalesce(b.value, 0) AS value
      FROM most m CROSS JOIN (VALUES {', '.join(f"({o.lit(k)}, {o.lit(v)})" for k, v in _ASKED.items())}) s(code, label)
      LEFT JOIN built b ON b.Sc = s.code AND b.N = m.N AND b.R = m.R
      UNION ALL SELECT N, R, 'maximum installable capacity', value FROM most)""",
)
def right_join_fill(spark, d):
    built, most = em.potentials(spark, d)
    return capacity.installed_vs_potential(built, most, _ASKED)
