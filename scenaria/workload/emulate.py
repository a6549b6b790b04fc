"""Model tables derived from the TESTDATA star schema.

Each function reads the whole given tables and reduces them to the key of the
model table it stands for. The large joins (lines with orders, parts and
suppliers) are left to Spark: adaptive execution broadcasts a side only when
its measured size allows and splits skewed partitions otherwise, and every
group-by combines on the map side. What leaves this module is a panel whose
size is bounded by scenarios x variables x nodes x slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import first_match, year_bin
from scenaria.operators import pivot_wider, shared
from scenaria.sources.inline import sql_literal

# How TESTDATA values play the roles of the model ---------------

LABELS = {
    "1-URGENT": "demand+ w/ grid",
    "2-HIGH": "demand+",
    "3-MEDIUM": "w/ grid",
    "4-NOT SPECIFIED": "NoPOL",
    "5-LOW": "w/o grid",
}
INFEASIBLE = "2"
BASELINE = "4-NOT SPECIFIED"
NODE_PREFIX = {0: "JP-", 1: "CN-", 4: "RU-"}
SINGLE_NODE = {2: "KR", 3: "MN"}
NODE_RANK = {1: 0, 2: 1, 0: 2, 3: 3, 4: 4}
GDP_REGION = {0: "Japan", 1: "China", 2: "South Korea", 3: "Mongolia"}
EXTRA_VARIABLES = [
    "Sec_Ene_Ele_Sto_Dis_PHS",
    "Trd_Sec_Ene_Ele",
    "Fin_Ene_Ele",
    "Sec_Ene_Ele_Sto_Dis_LiB",
    "Pri_Ene_Coa",
    "Pri_Ene_Gas",
]
BRAND_VARIABLE = [v.Variable for v in vocab.ANNUAL] + EXTRA_VARIABLES
COST_CODES = [*vocab.GENERATOR_COST_CLASS, "NUC"]
BRAND_COST_CODE = [COST_CODES[i % len(COST_CODES)] for i in range(25)]
GENERATOR_CODES = [*vocab.GENERATOR_VARIABLE, "WAV"]
BRAND_GENERATOR = [GENERATOR_CODES[i % len(GENERATOR_CODES)] for i in range(25)]
TYPE_STORAGE = {"SMALL": "LIBE", "MEDIUM": "PHSE", "LARGE": "H2SE"}
TYPE_RENEWABLE = {
    "ECONOMY": "PVC",
    "LARGE": "PVDC",
    "MEDIUM": "PVDR",
    "PROMO": "WNO",
    "SMALL": "WNB",
    "STANDARD": "WNF",
}
INNER_BUSES = [
    ("AC", "DC"),
    ("AC", "H2"),
    ("AC", "PHS"),
    ("H2-GT", "AC"),
    ("H2-FC", "AC"),
    ("H2", "H2S"),
    ("AC", "AC2"),
]
EVENT_VARIABLE = {
    "click": "Sec_Ene_Ele_inc_Cur_Solar_Cen",
    "view": "Sec_Ene_Ele_inc_Cur_Win_Ons",
    "purchase": "Fin_Ene_Ele",
    "signup": "Sec_Ene_Ele_Sto_Dis_LiB",
    "error": "Trd_Sec_Ene_Ele",
}
EVENT_SCENARIO = ["w/o grid", "w/ grid"]
EVENT_REGION = ["JPN", "JP-KT", "KR"]
FIRST_YEAR = 1995
PLOT_YEAR = 1999
BIN_YEAR = 2000
SITE_PATTERN = "^(JP-[0-9]+|CN-[0-9]+|RU-[0-9]+|KR|MN)-"


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A TESTDATA table with its declared schema, so no job runs to infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column | str) -> Column:
    """Element of a literal list by 1-based position; NULL beyond its end."""
    array = F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")
    return F.try_element_at(array, F.col(index) if isinstance(index, str) else index)


def _by_value(column: str, mapping: dict, otherwise: str | None = None) -> Column:
    cases = " ".join(f"WHEN {sql_literal(k)} THEN {sql_literal(v)}" for k, v in mapping.items())
    return F.expr(f"CASE {column} {cases} ELSE {sql_literal(otherwise)} END")


def _exact_sum(c: Column | str) -> Column:
    """Order-independent sum: decimal inside, double outside."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def horizon(year: Column, first: int = 2020) -> Column:
    return ((year - FIRST_YEAR) * 5 + first).cast("int")


# dimensions ------------------------------------------------------------------


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation key to model node; two regions are single-node countries."""
    n = table(spark, sf_dir, "nation")
    rk, nk = F.col("n_regionkey"), F.col("n_nationkey")
    single = rk.isin(list(SINGLE_NODE))
    node = F.when(single, _by_value("n_regionkey", SINGLE_NODE)).otherwise(
        F.concat(_by_value("n_regionkey", NODE_PREFIX), F.lpad(nk.cast("string"), 2, "0"))
    )
    rank = _by_value("n_regionkey", NODE_RANK) * 100 + F.when(single, 0).otherwise(nk)
    return n.select(nk, rk, node.alias("N"), rank.cast("int").alias("rank"))


def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.min("n_nationkey")
    return (
        nations(spark, sf_dir)
        .groupBy(F.col("N").alias("Sr"))
        .agg((key * 1.5 + 100).alias("centroid_x"), (key * 0.75 + 20).alias("centroid_y"))
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario matrix: one row per order priority."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    first = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderpriority").alias("Scenario"),
        F.when(first == INFEASIBLE, "Infeasible").otherwise("Optimal").alias("Status"),
        F.when(first.isin("1", "2"), "demand+").when(first == "4", "NoPOL").otherwise("default").alias("scen_dpol"),
        F.when(first.isin("1", "3"), "NEAG").otherwise("default").alias("scen_tpol"),
    )


# facts -----------------------------------------------------------------------


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their scenario and the customer's node."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    at = c.join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders")
    return o.join(at, o.o_custkey == at.c_custkey).select(
        "o_orderkey", F.col("o_orderpriority").alias("Sc"), "N", "rank", "n_regionkey", "o_totalprice", "o_orderdate"
    )


def lines(spark: SparkSession, sf_dir: str, part: bool = False, supplier: bool = False) -> DataFrame:
    """Order lines at the customer's node, with only the joins that are needed."""
    o = orders(spark, sf_dir).select("o_orderkey", "Sc", "N", "rank")
    li = table(spark, sf_dir, "lineitem")
    out = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("year", F.year("l_shipdate"))
    if part:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
        out = out.join(p, F.col("l_partkey") == F.col("p_partkey"))
        out = out.withColumn("brand", F.substring_index("p_brand", "#", -1).cast("int"))
    if supplier:
        at = nations(spark, sf_dir).select("n_nationkey", F.col("N").alias("N0"), F.col("rank").alias("rank0"))
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        s = s.join(at, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "N0", "rank0")
        out = out.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return out


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, Sv, Sr, Sy, value) for nodes, countries and the whole region.

    The node panel is laid out by (Sv, Sr) once: the yearly sum, the mean per
    bin and the densifying that follow all group by more than these columns,
    so none of them shuffles again.
    """
    base = (
        lines(spark, sf_dir, part=True)
        .groupBy("Sc", _pick(BRAND_VARIABLE, "brand").alias("Sv"), "N", F.col("year").alias("Sy"))
        .agg(F.sum("l_quantity").alias("value"))
    )
    country = F.when(F.col("N").startswith("JP-"), "JPN").when(F.col("N").startswith("CN-"), "CHN")
    levels = F.array_compact(F.array(F.col("N"), country, F.lit("NEA")))
    return (
        base.select("Sc", "Sv", F.explode(levels).alias("Sr"), "Sy", "value")
        .repartition("Sv", "Sr")
        .groupBy("Sc", "Sv", "Sr", "Sy")
        .agg(F.sum("value").alias("value"))
    )


def year_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the horizon, as a one-column set: reads the ship date only."""
    year = F.year("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(year_bin(year).alias("Y5")).distinct()


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, Sv, Sr, St, value); the trade variable takes both signs."""
    e = table(spark, sf_dir, "events")
    st = F.concat(
        F.lit("D"),
        F.lpad(F.dayofyear("ts").cast("string"), 3, "0"),
        F.lit("H"),
        F.lpad(F.hour("ts").cast("string"), 2, "0"),
    )
    v = F.when(F.col("event_type") == "error", 25 - F.col("value")).otherwise(F.col("value"))
    user = F.col("user_id")
    return e.groupBy(
        _pick(EVENT_SCENARIO, (user % 2 + 1).cast("int")).alias("Sc"),
        _by_value("event_type", EVENT_VARIABLE).alias("Sv"),
        _pick(EVENT_REGION, (user % 3 + 1).cast("int")).alias("Sr"),
        st.alias("St"),
    ).agg(_exact_sum(v).alias("value"))


def hourly_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasible scenario matrix with display labels."""
    from scenaria.plans.panel import scenario_matrix

    return scenario_matrix(scenarios(spark, sf_dir), LABELS)


def _link(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("-AC_"), b, F.lit("-AC"))


def flows(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """(Sc, N0, N1, I0, I1, L, T, YEAR, snd, rec): supplier node to customer node.

    ``year`` selects one model year by a date range, which prunes row groups
    of the scan; a filter on the derived year could not.
    """
    li = lines(spark, sf_dir, supplier=True).filter(F.col("N0") != F.col("N"))
    if year is not None:
        first, after = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
        li = li.filter((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < after))
    st = F.concat(
        F.lit("D"),
        F.lpad(F.dayofyear("l_shipdate").cast("string"), 3, "0"),
        F.lit("H"),
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
    )
    along = F.col("rank0") < F.col("rank")
    link = F.when(along, _link(F.col("N0"), F.col("N"))).otherwise(_link(F.col("N"), F.col("N0")))
    return (
        li.groupBy("Sc", "N0", F.col("N").alias("N1"), link.alias("L"), st.alias("T"), F.col("year").alias("YEAR"))
        .agg(
            F.sum("l_quantity").alias("snd"),
            _exact_sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("rec"),
        )
        .withColumns({"I0": F.lit("AC"), "I1": F.lit("AC")})
    )


def _any_link() -> Column:
    """Link between two nodes, or one of the inner links of a node."""
    between = F.when(F.col("rank0") < F.col("rank"), _link(F.col("N0"), F.col("N"))).otherwise(
        _link(F.col("N"), F.col("N0"))
    )
    b0 = _pick([a for a, _ in INNER_BUSES], "l_linenumber")
    b1 = _pick([b for _, b in INNER_BUSES], "l_linenumber")
    inner = F.concat(F.col("N"), F.lit("-"), b0, F.lit("_"), F.col("N"), F.lit("-"), b1)
    return F.when(F.col("N0") == F.col("N"), inner).otherwise(between)


def link_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, PW_LNK, YEAR, value); the year is text, as in the model files."""
    return (
        lines(spark, sf_dir, supplier=True)
        .groupBy("Sc", _any_link().alias("PW_LNK"), F.col("year").cast("string").alias("YEAR"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def _link_symbol() -> Column:
    """The cost symbol of a link follows the return flag."""
    return _by_value("l_returnflag", {"A": "lnk_inv", "N": "lnk_fom", "R": "lnk_vom"})


def _asset_symbol() -> Column:
    small = F.col("p_type") == "SMALL"
    return (
        F.when((F.col("l_returnflag") == "A") & ~small, "gen_inv")
        .when(F.col("l_returnflag") == "A", "sto_inv")
        .when((F.col("l_returnflag") == "N") & ~small, "gen_fom")
        .when(F.col("l_returnflag") == "N", "sto_fom")
        .otherwise("gen_vom")
    )


def _level() -> Column:
    return _by_value("l_linestatus", {"O": "ALL"}, "SUB")


def link_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, Sc, L, YEAR, value)."""
    return (
        lines(spark, sf_dir, supplier=True)
        .groupBy("Sc", _any_link().alias("L"), horizon(F.col("year")).alias("YEAR"), _link_symbol().alias("symbol"))
        .agg(_exact_sum("l_extendedprice").alias("value"))
    )


def asset_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, Sc, N, R, SE0, YEAR, value) of generators and storages."""
    return (
        lines(spark, sf_dir, part=True)
        .groupBy(
            "Sc",
            "N",
            _pick(BRAND_COST_CODE, "brand").alias("R"),
            _level().alias("SE0"),
            horizon(F.col("year")).alias("YEAR"),
            _asset_symbol().alias("symbol"),
        )
        .agg(_exact_sum("l_extendedprice").alias("value"))
    )


def cost_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """:func:`asset_costs` and :func:`link_costs` from one pass: each joined line becomes a row of
    either kind before the one grouped sum that both read."""
    text = F.lit(None).cast("string")
    asset = F.struct(
        F.lit("asset").alias("kind"), _asset_symbol().alias("symbol"), F.col("N").alias("N"), _pick(BRAND_COST_CODE, "brand").alias("R"),
        _level().alias("SE0"), text.alias("L"),
    )
    link = F.struct(F.lit("link").alias("kind"), _link_symbol().alias("symbol"), text.alias("N"), text.alias("R"), text.alias("SE0"), _any_link().alias("L"))
    rows = lines(spark, sf_dir, part=True, supplier=True).select(
        "Sc", horizon(F.col("year")).alias("YEAR"), "l_extendedprice", F.explode(F.array(asset, link)).alias("x")
    )
    both = shared(rows.groupBy("x.kind", "x.symbol", "Sc", "x.N", "x.R", "x.SE0", "x.L", "YEAR").agg(_exact_sum("l_extendedprice").alias("value")))
    return (
        both.filter("kind = 'asset'").select("symbol", "Sc", "N", "R", "SE0", "YEAR", "value"),
        both.filter("kind = 'link'").select("symbol", "Sc", "L", "YEAR", "value"),
    )


def gen_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        lines(spark, sf_dir, part=True)
        .groupBy(
            _by_value("l_linestatus", {"O": "ALL"}, "SUB").alias("SE0"),
            _pick(BRAND_GENERATOR, "brand").alias("PW_GEN"),
            "N",
            F.col("year").cast("string").alias("YEAR"),
            "Sc",
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def sto_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        lines(spark, sf_dir, part=True)
        .groupBy(
            _by_value("l_linestatus", {"O": "ALL"}, "SUB").alias("SE0"),
            _by_value("p_type", TYPE_STORAGE, "CAES").alias("PW_STO"),
            "N",
            F.col("year").cast("string").alias("YEAR"),
            "Sc",
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def potentials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(installed by scenario, maximum) per node and renewable technology, from one pass over the lines."""
    local = (F.col("l_returnflag") == "R") & (F.col("N0") == F.col("N"))
    both = shared(
        lines(spark, sf_dir, part=True, supplier=True)
        .groupBy("Sc", "N", _by_value("p_type", TYPE_RENEWABLE).alias("R"))
        .agg(F.sum(F.when(local, F.col("l_quantity"))).alias("built"), F.count(F.when(local, F.lit(1))).alias("n_built"), F.sum("l_quantity").alias("most"))
    )
    built = both.filter("n_built > 0").select("Sc", "N", "R", F.col("built").alias("value"))
    return built, both.groupBy("N", "R").agg(F.sum("most").alias("value"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, N, I, MT, value): unit price per month, and the ANN row."""
    monthly = (
        lines(spark, sf_dir)
        .groupBy(
            "Sc",
            "N",
            _by_value("l_linestatus", {"F": "AC"}, "AC2").alias("I"),
            F.concat(F.lit("m"), F.lpad(F.month("l_shipdate").cast("string"), 2, "0")).alias("MT"),
        )
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("paid"), F.sum("l_quantity").alias("quantity"))
    )
    rows = monthly.withColumn("MT", F.explode(F.array(F.col("MT"), F.lit("ANN"))))
    return rows.groupBy("Sc", "N", "I", "MT").agg((F.sum("paid").cast("double") / F.sum("quantity")).alias("value"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, N, I, MT, value)."""
    return (
        lines(spark, sf_dir)
        .groupBy(
            "Sc",
            "N",
            _by_value("l_linestatus", {"O": "AC2"}, "H2").alias("I"),
            F.concat(F.lit("m"), F.lpad(F.month("l_shipdate").cast("string"), 2, "0")).alias("MT"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def yearly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, N, I, Y, value); the year is text."""
    return (
        lines(spark, sf_dir)
        .groupBy(
            "Sc",
            "N",
            _by_value("l_linestatus", {"O": "AC2"}, "H2").alias("I"),
            horizon(F.col("year"), 2005).cast("string").alias("Y"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def emission_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Sc, MQ, Y, value) by country."""
    return (
        lines(spark, sf_dir)
        .groupBy(
            "Sc",
            first_match("N", vocab.COUNTRY_OF_NODE).alias("MQ"),
            horizon(F.col("year"), 2005).cast("string").alias("Y"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide series per region; one row has no region name, like a footer line."""
    o = orders(spark, sf_dir)
    years = list(range(2020, 2051, 5))
    long = o.groupBy(
        _by_value("n_regionkey", GDP_REGION).alias("Region"),
        horizon(F.year("o_orderdate")).alias("Y"),
    ).agg(_exact_sum("o_totalprice").alias("v"))
    return pivot_wider(long, ["Region"], "Y", "v", years)


