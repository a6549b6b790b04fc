"""Model inputs, node map data and scalar functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from scenaria import functions as fn
from scenaria import vocab
from scenaria.functions.timeslice import hour_window_columns
from scenaria.operators import grouped_sum, pivot_longer, split_link
from scenaria.operators.columns import categories_to_text, map_columns, select_renamed
from scenaria.plans import inputs, maps
from scenaria.sources import read_gdp, read_node_attributes, read_parameter, read_scenario_tree, read_scenarios, write_by_key, write_table
from scenaria.workload import emulate as em
from scenaria.workload import oracle as o
from scenaria.workload.q_mix import SHOWN, fossil_mix_of
from scenaria.workload.registry import as_text, query, rounded

KEEP = ["NoPOL", "w/o grid"]
YEARS = list(range(2005, 2051, 5))
SC = o.recode("Sc", em.LABELS)
CARRIER = o.recode("k.I", inputs.CARRIER_LABEL)


@query(
    "T50 P20 A1 R6",
    f"""
    SELECT {CARRIER} AS I, s.Sc, CAST(y.Y AS INTEGER) AS Y, round(coalesce(v.value, 0), 4) AS value
    FROM (SELECT DISTINCT I FROM fx_ydmd) k CROSS JOIN (SELECT unnest({KEEP}) AS Sc) s
    CROSS JOIN (SELECT unnest({YEARS}) AS Y) y
    LEFT JOIN (SELECT I, Y, {SC} AS Sc, sum(value) AS value FROM fx_ydmd GROUP BY ALL) v
      ON v.I = k.I AND v.Sc = s.Sc AND v.Y = y.Y""",
)
def demand_completed(spark, d):
    return rounded(inputs.demand_by_carrier(em.yearly_demand(spark, d), em.LABELS, KEEP, YEARS))


@query(
    "T50 R6",
    f"""
    SELECT k.Sr, 'H2' AS I, k.Sc, CAST(y.Y AS INTEGER) AS Y, round(coalesce(v.value, 0), 4) AS value
    FROM (SELECT DISTINCT {o.country('N')} AS Sr, {SC} AS Sc FROM fx_ydmd WHERE I = 'H2' AND {SC} IN {o.in_list(KEEP)}) k
    CROSS JOIN (SELECT unnest(range(2005, 2051, 5)) AS Y) y
    LEFT JOIN (SELECT {o.country('N')} AS Sr, {SC} AS Sc, Y, sum(value) AS value FROM fx_ydmd WHERE I = 'H2' GROUP BY ALL) v
      ON v.Sr IS NOT DISTINCT FROM k.Sr AND v.Sc = k.Sc AND v.Y = y.Y""",
)
def demand_by_country(spark, d):
    return rounded(inputs.demand_by_country(em.yearly_demand(spark, d), em.LABELS, KEEP, "H2", YEARS))


@query(
    "T50 R6 Q13",
    f"""
    WITH d AS (SELECT {o.country('N')} AS Sr, {SC} AS Sc, CASE WHEN Y <> 2015 THEN Y END AS Y, value
               FROM fx_ydmd WHERE I = 'H2' AND {SC} IN {o.in_list(KEEP)}),
         t AS (SELECT Sr, Sc, CAST(Y AS INTEGER) AS Y, sum(value) AS value FROM d GROUP BY ALL),
         k AS (SELECT DISTINCT Sr, Sc FROM d),
         g AS (SELECT Sr, Sc, CAST(y.Y AS INTEGER) AS Y FROM k CROSS JOIN (SELECT unnest(range(2005, 2051, 5)) AS Y) y
               UNION SELECT Sr, Sc, Y FROM t)
    SELECT g.Sr, 'H2' AS I, g.Sc, g.Y, round(coalesce(t.value, 0), 4) AS value
    FROM g LEFT JOIN t ON t.Sr IS NOT DISTINCT FROM g.Sr AND t.Sc = g.Sc AND t.Y IS NOT DISTINCT FROM g.Y""",
)
def demand_with_unreadable_year(spark, d):
    """A year text that is no number makes a group of its own, without a year."""
    demand = em.yearly_demand(spark, d)
    demand = demand.withColumn("Y", F.when(F.col("Y").cast("string") == "2015", "n/a").otherwise(F.col("Y").cast("string")))
    return rounded(inputs.demand_by_country(demand, em.LABELS, KEEP, "H2", YEARS))


@query("T51 A1", "SELECT Y, round(sum(value), 4) AS value FROM fx_cap WHERE Sc = '5-LOW' GROUP BY Y")
def emission_cap(spark, d):
    caps = em.emission_caps(spark, d).filter(F.col("Sc") == "5-LOW")
    return rounded(inputs.emission_cap(caps))


@query("T51 A1", "SELECT Y, Sc, MQ, round(sum(value), 4) AS value FROM fx_cap GROUP BY Y, Sc, MQ")
def emission_cap_by_country(spark, d):
    return rounded(inputs.emission_cap(em.emission_caps(spark, d), ["Sc", "MQ"]))


_MIX = f"""
    WITH m AS (
      SELECT p.Sc, CASE WHEN p.Sv LIKE '%Ele_Coa_%' OR p.Sv LIKE '%Ele_Oil' OR p.Sv LIKE '%Ele_Gas_%' THEN 'Sec_Ene_Ele_Fos'
                        WHEN p.Sv LIKE '%Ele_Bio_%' THEN 'Sec_Ene_Ele_Bio' WHEN p.Sv LIKE '%Ele_Win_%' THEN 'Sec_Ene_Ele_Win'
                        WHEN p.Sv LIKE '%Ele_Solar_%' THEN 'Sec_Ene_Ele_Solar' ELSE p.Sv END AS Sv,
             p.Sr, p.Y5, p.cat1, p.cat2, sum(p.value) AS value
      FROM fx_mix p WHERE p.Y5 = {em.BIN_YEAR} AND p.Sr LIKE '%JP-%' AND p.Sc IN {o.in_list(SHOWN)}
        AND p.Sv NOT IN {o.in_list(vocab.ANNUAL_OUTFLOWS)} GROUP BY ALL)"""


def node_mix_of(spark, d):
    return maps.node_mix(fossil_mix_of(spark, d), em.node_attributes(spark, d), em.BIN_YEAR, SHOWN)


@query(
    "T52 A15 J1",
    f"""{_MIX}
    SELECT m.Sc, m.Sv, m.Sr, m.Y5, m.cat1, m.cat2, round(m.value, 4) AS value, g.centroid_x, g.centroid_y
    FROM m LEFT JOIN fx_geo g ON g.Sr = m.Sr""",
)
def node_mix(spark, d):
    return rounded(node_mix_of(spark, d))


@query(
    "D9 F1",
    f"""{_MIX}
    SELECT m.Sc, m.Sv, m.Sr, m.Y5, m.cat1, m.cat2, round(m.value, 4) AS value, g.centroid_x, g.centroid_y
    FROM m LEFT JOIN fx_geo g ON g.Sr = m.Sr WHERE m.Sr = 'JP-05' AND m.Sc = 'w/ grid'""",
)
def node_pie_rows(spark, d):
    return rounded(maps.node_slice(node_mix_of(spark, d), "JP-05", "w/ grid"))


@query(
    "P29 T52",
    f"""{_MIX}, t AS (SELECT Sc, Sr, sum(value) AS value FROM m GROUP BY Sc, Sr)
    SELECT t.Sc, t.Sr, round(t.value, 4) AS value,
      round(g.centroid_x - (t.value / 160000.0 - 0.1), 6) AS xmin, round(g.centroid_x + (t.value / 160000.0 - 0.1), 6) AS xmax,
      round(g.centroid_y - (t.value / 160000.0 - 0.1), 6) AS ymin, round(g.centroid_y + (t.value / 160000.0 - 0.1), 6) AS ymax
    FROM t LEFT JOIN fx_geo g ON g.Sr = t.Sr""",
)
def node_symbol_box(spark, d):
    mixed = node_mix_of(spark, d).drop("centroid_x", "centroid_y")
    out = maps.symbol_boxes(mixed, em.node_attributes(spark, d), divisor=160000)
    return rounded(rounded(out), "xmin", "xmax", "ymin", "ymax", digits=6)


@query(
    "P28",
    """
    SELECT Sr, round(CASE WHEN Sr = 'JP-10' THEN centroid_x + 0.55 ELSE centroid_x END, 6) AS centroid_x,
           round(CASE WHEN Sr = 'JP-10' THEN centroid_y - 0.35 ELSE centroid_y END, 6) AS centroid_y FROM fx_geo""",
)
def adjusted_centroids(spark, d):
    moved = maps.adjusted_centroids(em.node_attributes(spark, d), {"JP-10": (0.55, -0.35)})
    return rounded(moved, "centroid_x", "centroid_y", digits=6)


_AC = o.lit(vocab.LINK_ORIGIN)


@query(
    "X1 X2 X3 X4 X5 P18 P19 P24",
    f"""
    SELECT DISTINCT PW_LNK, split_part(PW_LNK, '_', 1) AS N0, split_part(PW_LNK, '_', 2) AS N1,
      {o.found('PW_LNK', vocab.AC_LINK)} AS is_ac,
      CASE WHEN {o.found('PW_LNK', vocab.LINK_ORIGIN)} THEN regexp_extract(PW_LNK, {_AC}, 1) END AS origin,
      {o.strip_bus("split_part(PW_LNK, '_', 1)")} AS S0, {o.strip_bus("split_part(PW_LNK, '_', 2)")} AS S1,
      replace(replace(PW_LNK, '-AC', ''), '_', ' / ') AS label,
      replace(replace(replace(PW_LNK, '-AC', ''), '_', ' / '), '/', 'to') AS to_label,
      substr(PW_LNK, 1, 2) AS prefix, {o.country('PW_LNK')} AS country
    FROM fx_lnk""",
)
def scalar_strings(spark, d):
    links = em.link_capacity(spark, d).select("PW_LNK").distinct()
    return split_link(links, "PW_LNK").withColumns(
        {
            "is_ac": fn.detect("PW_LNK", vocab.AC_LINK),
            "origin": fn.capture("PW_LNK", vocab.LINK_ORIGIN),
            "S0": fn.strip_bus("N0"),
            "S1": fn.strip_bus("N1"),
            "label": fn.link_label("PW_LNK"),
            "to_label": F.regexp_replace(fn.link_label("PW_LNK"), "/", "to"),
            "prefix": fn.sub("PW_LNK", 1, 2),
            "country": fn.first_match("PW_LNK", vocab.COUNTRY_OF_NODE),
        }
    )


@query(
    "X6 X7 X8 X9 X10 X11 X13 X14 X15 X16 X17 X18 X19 X20 X21 D2 Q11 Q13",
    f"""
    WITH s AS (SELECT DISTINCT 'D' || lpad(CAST(dayofyear(ts) AS VARCHAR), 3, '0') || 'H' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS St,
                      CAST(ts AS DATE) AS day, CAST(year(ts) AS INTEGER) AS yr FROM events)
    SELECT St, strftime(day, '%Y-%m-%d') AS day, CAST({o.slice_hour('St')} AS INTEGER) AS h, CAST({o.slice_hour('St', 9)} AS INTEGER) AS h9,
      CAST(floor(({o.slice_hour('St', 9)} - 1) / 24) + 1 AS INTEGER) AS d9,
      strftime(DATE '2050-01-01' + CAST(floor(({o.slice_hour('St', 9)} - 1) / 24) AS INTEGER), '%Y-%m-%d') AS day9,
      strftime(TIMESTAMP '2050-01-01 00:00:00' + to_hours(CAST({o.slice_hour('St')} + 8 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS stamp,
      strftime(day, '%b %d') AS label, strftime(date_trunc('year', day), '%Y-%m-%d') AS jan1,
      CAST((day - date_trunc('year', day)::DATE) * 24 + 1 AS INTEGER) AS first_hour,
      CAST((day - date_trunc('year', day)::DATE) * 24 + 24 AS INTEGER) AS last_hour,
      {o.year_bin('yr')} AS bin, round(pow(0.95, yr - 2020), 10) AS discount,
      coalesce(TRY_CAST(substr(St, 1, 4) AS INTEGER), -1) AS unreadable, CAST(abs(1 - {o.slice_hour('St')}) AS INTEGER) AS back
    FROM s""",
)
def scalar_dates(spark, d):
    e = em.table(spark, d, "events")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    st = F.concat(F.lit("D"), pad(F.dayofyear("ts"), 3), F.lit("H"), pad(F.hour("ts"), 2))
    s = e.select(st.alias("St"), F.to_date("ts").alias("day"), F.year("ts").alias("yr")).distinct()
    first, last = hour_window_columns("day", "day")
    out = s.select(
        "St",
        "day",
        fn.slice_hour("St").alias("h"),
        fn.slice_hour("St", 9).alias("h9"),
        fn.day_of_hour(fn.slice_hour("St", 9)).alias("d9"),
        fn.date_of_day(fn.day_of_hour(fn.slice_hour("St", 9)), 2050).alias("day9"),
        fn.timestamp_of_hour(fn.slice_hour("St"), 2050, 8).alias("stamp"),
        fn.month_day("day").alias("label"),
        F.trunc("day", "year").alias("jan1"),
        first.alias("first_hour"),
        last.alias("last_hour"),
        fn.year_bin("yr").alias("bin"),
        F.round(fn.discount_factor("yr"), 10).alias("discount"),
        F.coalesce(fn.to_number(fn.sub("St", 1, 4)), F.lit(-1)).alias("unreadable"),
        F.abs(1 - fn.slice_hour("St")).alias("back"),
    )
    return as_text(out, "day", "day9", "stamp", "jan1")


@query(
    "S1 P1 P9 D10",
    """
    SELECT lower(l_returnflag) AS Sc, lower(l_linestatus) AS Sv, sum(l_quantity) AS value
    FROM lineitem GROUP BY ALL""",
)
def parameter_table(spark, d):
    """A long parameter table as the readers give it: index columns as text, the symbol as ``value``."""
    rows = read_parameter(spark, f"{d}/lineitem.parquet", "l_quantity", ["l_returnflag", "l_linestatus"])
    named = select_renamed(categories_to_text(rows), {"Sc": "l_returnflag", "Sv": "l_linestatus", "value": "value"})
    return grouped_sum(map_columns(named, ["Sc", "Sv"], F.lower), ["Sc", "Sv"])


@query(
    "S3",
    """
    SELECT 'benchmark' AS Sc, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_absent FROM benchmark
    UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT), count(*) FROM conversations
    UNION ALL SELECT 'documents', count(*), CAST(sum(length(text)) AS BIGINT), count(*) FROM documents""",
)
def scenario_file(spark, d):
    """A collection of files with a common column in one scan, told apart by the name in the path; the symbol, which
    none of them has, is NULL."""
    rows = read_scenarios(spark, d, "score", ["text"], ["documents", "conversations", "benchmark"])
    return rows.groupBy("Sc").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_absent")
    )


# Files in the domain's own layouts: made from the given tables by the writers, then read -----------------


def _files(spark):
    """A new folder that all executors see; a local session without such a setting has one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or 'file://' + tempfile.gettempdir()}/scenaria-files-{uuid.uuid4().hex}"


@query(
    "S4 S9 S3 J8",
    """
    SELECT o_orderpriority AS Sc, CAST(year(o_orderdate) AS INTEGER) AS Sy, o_orderstatus AS N, round(sum(o_totalprice) / 1e6, 4) AS value
    FROM orders WHERE substr(o_orderpriority, 1, 1) <> '2' AND year(o_orderdate) IN (1995, 1997) GROUP BY ALL""",
)
def scenario_tree(spark, d):
    """One folder per scenario and year, of which only those of feasible scenarios and two years are opened."""
    orders = em.table(spark, d, "orders")
    total = orders.groupBy(F.col("o_orderpriority").alias("Sc"), F.year("o_orderdate").alias("Sy"), F.col("o_orderstatus").alias("N"))
    rows = total.agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("dmd"))
    root = write_by_key(rows, _files(spark), "tree", ["Sc", "Sy"])
    feasible = em.scenarios(spark, d).filter(F.col("Status") != "Infeasible")
    return rounded(read_scenario_tree(spark, root, "dmd", ["N"], feasible, [1995, 1997]), divisor=1e6)


@query(
    "S5 S10 R2",
    f"""
    SELECT {o.lookup('Sr2', {v: k for k, v in vocab.COUNTRY_OF_GDP_REGION.items()})} AS Region, YEAR, round(GDP / 1e6, 4) AS "GDP"
    FROM fx_gdp g WHERE YEAR BETWEEN 2020 AND 2050""",
)
def gdp_file(spark, d):
    """A wide CSV file with a line without a region, as published series have at their end."""
    path = write_table(em.gdp(spark, d), _files(spark), "gdp", "csv")
    long = pivot_longer(read_gdp(spark, path), ["Region"], names_to="YEAR", values_to="GDP", names_type="int")
    return rounded(long.filter(F.col("GDP").isNotNull()), "GDP", divisor=1e6)


@query("S6", "SELECT Sr, round(centroid_x, 4) AS centroid_x, round(centroid_y, 4) AS centroid_y, 'Point' AS kind FROM fx_geo")
def node_features(spark, d):
    """Feature collections, several nodes a file, read back with their geometry as text."""
    x, y = F.col("centroid_x"), F.col("centroid_y")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("Sr").alias("N_PSY"), x, y).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"),
    )
    files = em.node_attributes(spark, d).groupBy(F.pmod(F.xxhash64("Sr"), F.lit(4)).alias("file")).agg(F.collect_list(feature).alias("features"))
    path = f"{_files(spark)}/nodes"
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")
    files.select("file", text).write.partitionBy("file").text(path)
    nodes = read_node_attributes(spark, path)
    return rounded(nodes.select("Sr", "centroid_x", "centroid_y", F.get_json_object("geometry", "$.type").alias("kind")), "centroid_x", "centroid_y")
