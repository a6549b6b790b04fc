"""DuckDB side: the model tables as common table expressions.

``sql(body)`` prepends exactly the expressions a statement refers to.
"""

from __future__ import annotations

import re

from scenaria import vocab
from scenaria.workload import emulate as em


def lit(s: object) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def lookup(col: str, mapping: dict, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = {lit(k) if isinstance(k, str) else k} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {otherwise} END)"


def recode(col: str, mapping: dict) -> str:
    return lookup(col, mapping, col)


def pick(values, index: str) -> str:
    return "([" + ", ".join(lit(v) for v in values) + f"])[{index}]"


def found(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(pattern)})"


def rules(col: str, pairs) -> str:
    return "(CASE " + " ".join(f"WHEN {found(col, p)} THEN {lit(v)}" for p, v in pairs) + " END)"


def end_rules(triples, a: str = "N0", b: str = "N1") -> str:
    return "(CASE " + " ".join(f"WHEN {found(a, p)} AND {found(b, q)} THEN {lit(v)}" for p, q, v in triples) + " END)"


def country(col: str) -> str:
    return rules(col, vocab.COUNTRY_OF_NODE)


def year_bin(col: str) -> str:
    return f"CAST(floor(ceil({col} - 2001) / 5.0) * 5 + 2005 AS INTEGER)"


def ssum(col: str) -> str:
    return f"(CASE WHEN count({col}) = count(*) THEN sum({col}) END)"


def savg(col: str) -> str:
    return f"(CASE WHEN count({col}) = count(*) THEN avg({col}) END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flip(col: str, value: str, names) -> str:
    return f"(CASE WHEN {col} IN {in_list(names)} THEN -{value} ELSE {value} END)"


def slice_hour(col: str, offset: int = 0) -> str:
    return (
        f"((TRY_CAST(substr({col}, 2, 3) AS INTEGER) - 1) * 24"
        f" + TRY_CAST(substr({col}, 6, 2) AS INTEGER) + 1 + {offset})"
    )


def strip_bus(col: str) -> str:
    return f"regexp_replace({col}, {lit(vocab.BUS_SUFFIX)}, '')"


def exact(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"


_FROM_LINES = "FROM lineitem JOIN fx_orders ON l_orderkey = o_orderkey"
_BRAND = "CAST(split_part(p_brand, '#', 2) AS INTEGER)"
_SE0 = "CASE WHEN l_linestatus = 'O' THEN 'ALL' ELSE 'SUB' END"
_MONTH = "'m' || lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0')"
_BETWEEN = "CASE WHEN rank0 < rank THEN N0 || '-AC_' || N || '-AC' ELSE N || '-AC_' || N0 || '-AC' END"
_ANY_LINK = (
    "CASE WHEN N0 = N THEN N || '-' || "
    + pick([a for a, _ in em.INNER_BUSES], "l_linenumber")
    + " || '_' || N || '-' || "
    + pick([b for _, b in em.INNER_BUSES], "l_linenumber")
    + f" ELSE {_BETWEEN} END"
)


def _horizon(year: str, first: int = 2020) -> str:
    return f"CAST(({year} - {em.FIRST_YEAR}) * 5 + {first} AS INTEGER)"


CTES = {
    "fx_nations": f"""
        SELECT n_nationkey, n_regionkey,
          CASE n_regionkey WHEN 2 THEN 'KR' WHEN 3 THEN 'MN'
               ELSE {lookup('n_regionkey', em.NODE_PREFIX)} || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS N,
          CAST(CASE n_regionkey WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 0 THEN 200 WHEN 3 THEN 300 WHEN 4 THEN 400 END
               + CASE WHEN n_regionkey IN (2, 3) THEN 0 ELSE n_nationkey END AS INTEGER) AS rank
        FROM nation""",
    "fx_geo": """
        SELECT N AS Sr, min(n_nationkey) * 1.5::DOUBLE + 100 AS centroid_x,
               min(n_nationkey) * 0.75::DOUBLE + 20 AS centroid_y
        FROM fx_nations GROUP BY N""",
    "fx_scen": """
        SELECT DISTINCT o_orderpriority AS Scenario,
          CASE WHEN o_orderpriority[1] = '2' THEN 'Infeasible' ELSE 'Optimal' END AS Status,
          CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'demand+' WHEN o_orderpriority[1] = '4' THEN 'NoPOL'
               ELSE 'default' END AS scen_dpol,
          CASE WHEN o_orderpriority[1] IN ('1', '3') THEN 'NEAG' ELSE 'default' END AS scen_tpol
        FROM orders""",
    "fx_scen_mat": f"""
        SELECT {recode('Scenario', em.LABELS)} AS Scenario, Status, scen_dpol,
               {recode('scen_tpol', vocab.SCENARIO_GRID_LABEL)} AS scen_tpol
        FROM fx_scen WHERE Status <> 'Infeasible'""",
    "fx_orders": """
        SELECT o_orderkey, o_orderpriority AS Sc, N, rank, n_regionkey, o_totalprice, o_orderdate
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN fx_nations ON c_nationkey = n_nationkey""",
    "fx_lines": f"""SELECT *, year(l_shipdate) AS yr {_FROM_LINES}""",
    "fx_part_lines": "SELECT * FROM fx_lines JOIN part ON l_partkey = p_partkey",
    "fx_supplier": """
        SELECT s_suppkey, N AS N0, rank AS rank0 FROM supplier JOIN fx_nations ON s_nationkey = n_nationkey""",
    "fx_annual_nodes": f"""
        SELECT Sc, {pick(em.BRAND_VARIABLE, _BRAND)} AS Sv, N, CAST(yr AS INTEGER) AS Sy, sum(l_quantity) AS value
        FROM fx_part_lines GROUP BY ALL""",
    "fx_annual": """
        SELECT Sc, Sv, Sr, Sy, sum(value) AS value FROM (
          SELECT Sc, Sv, N AS Sr, Sy, value FROM fx_annual_nodes
          UNION ALL SELECT Sc, Sv, 'JPN', Sy, value FROM fx_annual_nodes WHERE N LIKE 'JP-%'
          UNION ALL SELECT Sc, Sv, 'CHN', Sy, value FROM fx_annual_nodes WHERE N LIKE 'CN-%'
          UNION ALL SELECT Sc, Sv, 'NEA', Sy, value FROM fx_annual_nodes) GROUP BY ALL""",
    "fx_means": f"""
        SELECT {recode('Sc', em.LABELS)} AS Sc, Sv, Sr, {year_bin('Sy')} AS Y5, {savg('value')} AS value
        FROM fx_annual GROUP BY ALL""",
    "fx_panel": """
        SELECT k.Sc, k.Sv, k.Sr, b.Y5, coalesce(m.value, 0) AS value
        FROM (SELECT DISTINCT Sc, Sv, Sr FROM fx_means) k
        CROSS JOIN (SELECT DISTINCT Y5 FROM fx_means) b
        LEFT JOIN fx_means m ON m.Sc = k.Sc AND m.Sv = k.Sv AND m.Sr = k.Sr AND m.Y5 = b.Y5""",
    "fx_mix": f"""
        SELECT s.Scenario AS Sc, p.Sv, p.Sr, p.Y5, p.value, s.scen_dpol AS cat1, s.scen_tpol AS cat2 FROM (
          SELECT Sc, Sv, Sr, Y5, {ssum('value')} AS value FROM fx_panel
          WHERE Sv IN {in_list(v.Variable for v in vocab.ANNUAL)} GROUP BY ALL) p
        LEFT JOIN fx_scen_mat s ON s.Scenario = p.Sc""",
    "fx_hourly": f"""
        SELECT {pick(em.EVENT_SCENARIO, 'CAST(user_id % 2 + 1 AS INTEGER)')} AS Sc,
               {lookup('event_type', em.EVENT_VARIABLE)} AS Sv,
               {pick(em.EVENT_REGION, 'CAST(user_id % 3 + 1 AS INTEGER)')} AS Sr,
               'D' || lpad(CAST(dayofyear(ts) AS VARCHAR), 3, '0') || 'H' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS St,
               {exact("CASE WHEN event_type = 'error' THEN 25 - value ELSE value END")} AS value
        FROM events GROUP BY ALL""",
    "fx_hr": f"""
        SELECT g.Sc, g.Sv, g.Sr, g.St, coalesce(h.value, 0) AS value, {slice_hour('g.St', 9)} AS T,
               s.scen_dpol AS cat1, s.scen_tpol AS cat2
        FROM (SELECT * FROM (SELECT DISTINCT Sc FROM fx_hourly), (SELECT DISTINCT Sv FROM fx_hourly),
                            (SELECT DISTINCT Sr FROM fx_hourly), (SELECT DISTINCT St FROM fx_hourly)) g
        LEFT JOIN fx_hourly h ON h.Sc = g.Sc AND h.Sv = g.Sv AND h.Sr = g.Sr AND h.St = g.St
        LEFT JOIN fx_scen_mat s ON s.Scenario = g.Sc""",
    "fx_da": """
        SELECT Sc, Sv, Sr, CAST(floor((T - 1) / 24) + 1 AS INTEGER) AS D, cat1, cat2, sum(value) AS value
        FROM fx_hr WHERE cat1 <> 'NoPOL' GROUP BY ALL""",
    "fx_flow": f"""
        SELECT Sc, N0, N AS N1, {_BETWEEN} AS L,
               'D' || lpad(CAST(dayofyear(l_shipdate) AS VARCHAR), 3, '0') || 'H'
                 || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS T,
               CAST(yr AS INTEGER) AS YEAR, sum(l_quantity) AS snd, {exact('l_quantity * (1 - l_discount)')} AS rec
        FROM fx_lines JOIN fx_supplier ON l_suppkey = s_suppkey WHERE N0 <> N GROUP BY ALL""",
    "fx_signed": f"""
        SELECT Sc, Sy, St, CASE WHEN value < 0 THEN N1 ELSE N0 END AS N0, CASE WHEN value < 0 THEN N0 ELSE N1 END AS N1, value
        FROM (SELECT Sc, YEAR AS Sy, T AS St, N0, N1,
                     sum(CASE WHEN N0 = split_part(L, '-AC_', 1) THEN snd ELSE -snd END) AS value
              FROM fx_flow WHERE YEAR = {em.PLOT_YEAR} GROUP BY ALL) WHERE value <> 0""",
    "fx_directed": """
        SELECT Sc, Sy, St, CASE WHEN value < 0 THEN N1 ELSE N0 END AS N0, CASE WHEN value < 0 THEN N0 ELSE N1 END AS N1,
               abs(value) AS value FROM fx_signed""",
    "fx_trade": """
        SELECT Sc, Sy, St, N, Sv, sum(value) AS value FROM (
          SELECT Sc, Sy, St, N0 AS N, 'export' AS Sv, value FROM fx_directed
          UNION ALL SELECT Sc, Sy, St, N1, 'import', value FROM fx_directed) GROUP BY ALL""",
    "fx_net": f"""
        SELECT Sc, Sy, St, {country('N')} AS Sr,
               sum(CASE WHEN Sv = 'import' THEN value ELSE 0 END) AS import,
               sum(CASE WHEN Sv = 'export' THEN value ELSE 0 END) AS export
        FROM fx_trade GROUP BY ALL""",
    "fx_yearly": """
        SELECT Sc, Sr, CASE WHEN import > export THEN 'import' ELSE 'export' END AS Sv, sum(import - export) AS value
        FROM fx_net WHERE import <> export GROUP BY ALL""",
    "fx_lnk": f"""
        SELECT Sc, {_ANY_LINK} AS PW_LNK, CAST(yr AS INTEGER) AS YEAR, sum(l_quantity) AS value
        FROM fx_lines JOIN fx_supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "fx_lnk_cap": f"""
        SELECT Sc, PW_LNK, split_part(PW_LNK, '_', 1) AS N0, split_part(PW_LNK, '_', 2) AS N1,
               {year_bin('YEAR')} AS Y5, {savg('value')} AS value
        FROM fx_lnk WHERE {found('PW_LNK', vocab.AC_LINK)} GROUP BY ALL""",
    "fx_corridor": f"""
        SELECT {recode('Sc', em.LABELS)} AS Sc, {end_rules(vocab.CAPACITY_CORRIDORS)} AS Sv, Y5, {ssum('value')} AS value
        FROM fx_lnk_cap GROUP BY ALL""",
    "fx_lnk_cost": f"""
        SELECT CASE l_returnflag WHEN 'A' THEN 'lnk_inv' WHEN 'N' THEN 'lnk_fom' ELSE 'lnk_vom' END AS symbol,
               Sc, {_ANY_LINK} AS L, {_horizon('yr')} AS YEAR, {exact('l_extendedprice')} AS value
        FROM fx_lines JOIN fx_supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "fx_asset": f"""
        SELECT CASE WHEN l_returnflag = 'A' AND p_type <> 'SMALL' THEN 'gen_inv' WHEN l_returnflag = 'A' THEN 'sto_inv'
                    WHEN l_returnflag = 'N' AND p_type <> 'SMALL' THEN 'gen_fom' WHEN l_returnflag = 'N' THEN 'sto_fom'
                    ELSE 'gen_vom' END AS symbol,
               Sc, N, {pick(em.BRAND_COST_CODE, _BRAND)} AS R, {_SE0} AS SE0, {_horizon('yr')} AS YEAR,
               {exact('l_extendedprice')} AS value
        FROM fx_part_lines GROUP BY ALL""",
    "fx_asset_cost": f"""
        SELECT Sc, N, CASE symbol WHEN 'gen_inv' THEN {lookup('R', vocab.GENERATOR_COST_CLASS)}
                 WHEN 'sto_inv' THEN 'CAPEX (battery)' WHEN 'gen_vom' THEN 'Fuel' ELSE 'OPEX' END AS Sv,
               YEAR, sum(value) AS value
        FROM fx_asset WHERE SE0 = 'ALL' GROUP BY ALL""",
    "fx_lnk_ends": f"""
        SELECT *, CASE symbol WHEN 'lnk_fom' THEN 'OPEX' WHEN 'lnk_vom' THEN 'Fuel' ELSE
            CASE WHEN {found('L', vocab.AC_LINK)} AND N0[1:2] = N1[1:2] THEN 'CAPEX (domestic interconnection)'
                 WHEN {found('L', vocab.AC_LINK)} THEN 'CAPEX (international interconnection)'
                 WHEN {found('L', vocab.BATTERY_LINK)} THEN 'CAPEX (battery)'
                 WHEN {found('L', vocab.HYDROGEN_LINK)} THEN 'CAPEX (hydrogen)'
                 WHEN {found('L', vocab.OTHER_LINK)} THEN 'CAPEX (other)' END END AS Sv
        FROM (SELECT *, {strip_bus("split_part(L, '_', 1)")} AS N0, {strip_bus("split_part(L, '_', 2)")} AS N1
              FROM fx_lnk_cost)""",
    "fx_lnk_cost_nodes": """
        SELECT Sc, N, Sv, YEAR, sum(value) AS value FROM (
          SELECT Sc, N0 AS N, Sv, YEAR, value FROM fx_lnk_ends WHERE N0[1:2] = N1[1:2]
          UNION ALL SELECT Sc, N0, Sv, YEAR, value / 2 FROM fx_lnk_ends WHERE N0[1:2] <> N1[1:2]
          UNION ALL SELECT Sc, N1, Sv, YEAR, value / 2 FROM fx_lnk_ends WHERE N0[1:2] <> N1[1:2]) GROUP BY ALL""",
    "fx_cost_total": f"""
        SELECT {country('N')} AS Sr2, Sc, Sv, YEAR, sum(value) AS value
        FROM (SELECT * FROM fx_asset_cost UNION ALL SELECT * FROM fx_lnk_cost_nodes)
        WHERE YEAR >= 2020 GROUP BY ALL""",
    "fx_cost_keys": "SELECT DISTINCT Sr2, Sc, Sv FROM fx_cost_total",
    "fx_cost_yearly": """
        SELECT k.Sr2, k.Sc, k.Sv, y.YEAR, coalesce(c.value, 0) AS value
        FROM fx_cost_keys k CROSS JOIN (SELECT CAST(unnest(range(2020, 2051)) AS INTEGER) AS YEAR) y
        LEFT JOIN fx_cost_total c
          ON c.Sr2 IS NOT DISTINCT FROM k.Sr2 AND c.Sc = k.Sc AND c.Sv IS NOT DISTINCT FROM k.Sv
         AND c.YEAR = CAST(ceil(y.YEAR / 5.0) * 5 AS INTEGER)""",
    "fx_increment": f"""
        SELECT k.Sr2, k.Sv, k.YEAR, s.Sc, coalesce(v.value, 0) - coalesce(b.value, 0) AS value
        FROM (SELECT DISTINCT Sr2, Sv, YEAR FROM fx_cost_yearly) k
        CROSS JOIN (SELECT unnest({list(em.LABELS)}) AS Sc) s
        LEFT JOIN fx_cost_yearly v ON v.Sr2 IS NOT DISTINCT FROM k.Sr2 AND v.Sv IS NOT DISTINCT FROM k.Sv
          AND v.YEAR = k.YEAR AND v.Sc = s.Sc
        LEFT JOIN fx_cost_yearly b ON b.Sr2 IS NOT DISTINCT FROM k.Sr2 AND b.Sv IS NOT DISTINCT FROM k.Sv
          AND b.YEAR = k.YEAR AND b.Sc = {lit(em.BASELINE)}
        WHERE s.Sc <> {lit(em.BASELINE)}""",
    "fx_npv": f"""
        SELECT {recode('Sc', em.LABELS)} AS Sc, Sv, Sr2, sum(value * pow(0.95, YEAR - 2020)) AS value
        FROM fx_increment GROUP BY ALL""",
    "fx_npv_total": """
        SELECT Sc, Sv, Sr2, value FROM fx_npv
        UNION ALL SELECT Sc, Sv, 'Total', sum(value) FROM fx_npv GROUP BY Sc, Sv""",
    "fx_gdp": f"""
        SELECT {lookup('n_regionkey', {0: 'JPN', 1: 'CHN', 2: 'KOR', 3: 'MNG'})} AS Sr2,
               {_horizon('year(o_orderdate)')} AS YEAR, {exact('o_totalprice')} AS GDP
        FROM fx_orders WHERE n_regionkey <> 4 GROUP BY ALL""",
    "fx_gdp_yearly": """
        SELECT a.Sr2, CAST(a.YEAR + i AS INTEGER) AS YEAR,
               a.GDP + coalesce((b.GDP - a.GDP) * i / 5, 0) AS GDP
        FROM fx_gdp a LEFT JOIN fx_gdp b ON b.Sr2 = a.Sr2 AND b.YEAR = a.YEAR + 5
        CROSS JOIN (SELECT unnest(range(0, 5)) AS i) WHERE a.YEAR + i <= 2050""",
    "fx_gdp_pv": """
        SELECT Sr2, sum(GDP * pow(0.95, YEAR - 2020)) * 91.9 / 102.9 AS GDP FROM fx_gdp_yearly GROUP BY Sr2""",
    "fx_gdp_all": "SELECT * FROM fx_gdp_pv UNION ALL SELECT 'Total', sum(GDP) FROM fx_gdp_pv",
    "fx_gen": f"""
        SELECT {_SE0} AS SE0, {pick(em.BRAND_GENERATOR, _BRAND)} AS PW_GEN, N, CAST(yr AS INTEGER) AS YEAR, Sc,
               sum(l_quantity) AS value FROM fx_part_lines GROUP BY ALL""",
    "fx_sto": f"""
        SELECT {_SE0} AS SE0, {lookup('p_type', em.TYPE_STORAGE, "'CAES'")} AS PW_STO, N, CAST(yr AS INTEGER) AS YEAR, Sc,
               sum(l_quantity) AS value FROM fx_part_lines GROUP BY ALL""",
    "fx_gen_cap": f"""
        SELECT Sc, N AS Sr, {lookup('PW_GEN', vocab.GENERATOR_VARIABLE)} AS Sv, YEAR AS Sy, value
        FROM fx_gen WHERE SE0 = 'ALL' AND PW_GEN IN {in_list(vocab.GENERATOR_VARIABLE)}""",
    "fx_sto_cap": f"""
        SELECT Sc, N AS Sr, {lookup('PW_STO', vocab.STORAGE_VARIABLE)} AS Sv, YEAR AS Sy, value
        FROM fx_sto WHERE SE0 = 'ALL' AND PW_STO IN {in_list(vocab.STORAGE_VARIABLE)}""",
    "fx_inner": f"""
        SELECT Sc, CASE WHEN a = b THEN a END AS Sr, {end_rules(vocab.ASSET_OF_BUSES)} AS Sv, YEAR AS Sy, value FROM (
          SELECT *, nullif(regexp_extract(N0, {lit(em.SITE_PATTERN)}, 1), '') AS a,
                    nullif(regexp_extract(N1, {lit(em.SITE_PATTERN)}, 1), '') AS b
          FROM (SELECT *, split_part(PW_LNK, '_', 1) AS N0, split_part(PW_LNK, '_', 2) AS N1
                FROM fx_lnk WHERE NOT {found('PW_LNK', vocab.AC_LINK)}))""",
    "fx_sto_binned": f"""
        SELECT {recode('Sc', em.LABELS)} AS Sc, Sr, {country('Sr')} AS Sr2, Sv, {year_bin('Sy')} AS Y5, {savg('value')} AS value
        FROM fx_sto_cap GROUP BY ALL""",
    "fx_price": f"""
        SELECT Sc, N, CASE WHEN l_linestatus = 'F' THEN 'AC' ELSE 'AC2' END AS I, {_MONTH} AS MT,
               {exact('l_extendedprice')} / sum(l_quantity) AS value FROM fx_lines GROUP BY ALL""",
    "fx_dmd": f"""
        SELECT Sc, N, CASE WHEN l_linestatus = 'O' THEN 'AC2' ELSE 'H2' END AS I, {_MONTH} AS MT,
               sum(l_quantity) AS value FROM fx_lines GROUP BY ALL""",
    "fx_mcoe": """
        SELECT p.Sc, p.N, p.I, p.MT AS T, p.value AS price, d.value AS dmd
        FROM fx_price p LEFT JOIN fx_dmd d ON d.Sc = p.Sc AND d.N = p.N AND d.MT = p.MT AND d.I = 'AC2'""",
    "fx_demand": f"""
        SELECT Sc, {country('N')} AS Sr, sum(CASE WHEN I = 'H2' THEN value / 0.68 ELSE value END) AS dmd
        FROM fx_dmd GROUP BY ALL""",
    "fx_ydmd": f"""
        SELECT Sc, N, CASE WHEN l_linestatus = 'O' THEN 'AC2' ELSE 'H2' END AS I, {_horizon('yr', 2005)} AS Y,
               sum(l_quantity) AS value FROM fx_lines GROUP BY ALL""",
    "fx_cap": f"""
        SELECT Sc, {country('N')} AS MQ, {_horizon('yr', 2005)} AS Y, sum(l_quantity) AS value FROM fx_lines GROUP BY ALL""",
}


def sql(body: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in CTES and name not in need:
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in need)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
