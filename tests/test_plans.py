"""Result tables on small tables shaped like the model's output."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.plans import balance, capacity, costs, inputs, maps, mix, panel, prices

from conftest import rows_of

LABELS = {"500C_Elc40": "w/ grid", "500C": "w/o grid"}
SCEN = "Scenario string, Status string, scen_dpol string, scen_tpol string"


@pytest.fixture(scope="module")
def scenarios(spark):
    rows = [
        ("NoPOL", "Optimal", "NoPOL", "default"),
        ("500C", "Optimal", "default", "default"),
        ("500C_Elc40", "Optimal", "default", "NEAG"),
        ("bad", "Infeasible", "default", "default"),
    ]
    return spark.createDataFrame(rows, SCEN)


@pytest.fixture(scope="module")
def matrix(scenarios):
    return panel.scenario_matrix(scenarios, LABELS)


def test_scenario_matrix(scenarios, matrix):
    assert rows_of(matrix) == [
        ("NoPOL", "Optimal", "NoPOL", "w/o grid"),
        ("w/ grid", "Optimal", "default", "w/ grid"),
        ("w/o grid", "Optimal", "default", "w/o grid"),
    ]
    assert rows_of(panel.scenario_matrix(scenarios, LABELS, feasible=False)) == [("bad", "Infeasible", "default", "default")]


def test_codes_of_covers_unlabelled_names():
    assert panel.codes_of(LABELS, ["w/ grid", "NoPOL"]) == ["500C_Elc40", "w/ grid", "NoPOL"]
    assert panel.codes_of(LABELS, ["500C"]) == []


@pytest.fixture(scope="module")
def annual(spark):
    rows = [
        ("500C", "Sec_Ene_Ele_Nuc", "JPN", 2046, 10.0),
        ("500C", "Sec_Ene_Ele_Nuc", "JPN", 2050, 20.0),
        ("500C", "Sec_Ene_Ele_Solar_Cen", "JPN", 2050, 45.0),
        ("500C", "Sec_Ene_Ele_Cur", "JPN", 2050, 7.0),
        ("500C_Elc40", "Sec_Ene_Ele_Nuc", "JPN", 2045, 4.0),
        ("500C_Elc40", "Sec_Ene_Ele_Nuc", "JP-HD", 2050, 6.0),
        ("500C_Elc40", "Unknown", "JPN", 2050, 1.0),
        ("other", "Sec_Ene_Ele_Nuc", "JPN", 2050, 1.0),
    ]
    return spark.createDataFrame(rows, "Sc string, Sv string, Sr string, Sy int, value double")


@pytest.fixture(scope="module")
def mixed(annual, matrix):
    return mix.generation_mix(panel.annual_panel(annual, LABELS, ["w/o grid", "w/ grid"]), vocab.ANNUAL, matrix)


def test_annual_panel(annual):
    got = rows_of(panel.annual_panel(annual, LABELS, ["w/o grid"]), "Sv", "Y5", "value")
    assert got == [("Sec_Ene_Ele_Cur", 2050, 7.0), ("Sec_Ene_Ele_Nuc", 2050, 15.0), ("Sec_Ene_Ele_Solar_Cen", 2050, 45.0)]
    both = panel.annual_panel(annual, LABELS, ["w/o grid", "w/ grid"])
    assert both.filter("Y5 = 2045").count() == both.filter("Y5 = 2050").count() == 6


def test_generation_mix_and_share(mixed):
    share = mix.technology_share(mixed, ["JPN"], ["w/o grid"], 2050)
    assert rows_of(share, "Sv", "share", "cat1", "cat2") == [
        ("Sec_Ene_Ele_Nuc", 25.0, "default", "w/o grid"),
        ("Sec_Ene_Ele_Solar_Cen", 75.0, "default", "w/o grid"),
    ]
    assert rows_of(mix.generation_total(mixed, ["JPN"], ["w/o grid"], 2050)) == [("w/o grid", "JPN", 60.0)]


def test_share_table_adds_variable_renewables(mixed):
    tech = mix.names(vocab.ANNUAL)
    wide = mix.share_table(mix.technology_share(mixed, ["JPN"], ["w/o grid"]), tech)
    row = wide.filter("Y5 = 2050").first()
    assert row["Sec_Ene_Ele_WinSol"] == 75.0 and row["Sec_Ene_Ele_Hyd"] == 0.0


def test_regional_view_signs_losses_and_orders(mixed):
    view = mix.regional_view(mixed, ["JPN"], ["w/o grid"], vocab.ANNUAL, {"JPN": "Japan"}, year=2050, divisor=1.0)
    got = rows_of(view, "Sv", "Sr", "value", "ord")
    assert got[0] == ("Sec_Ene_Ele_Cur", "Japan", -7.0, 18)


def test_grid_effect_fills_the_missing_side(mixed):
    assert rows_of(mix.grid_effect(mixed, "JP-", 2050), "Sv", "Sr", "value") == [("Sec_Ene_Ele_Nuc", "JP-HD", 6.0)]


def test_subnational_names(mixed):
    order = list(vocab.PREFECTURE_GROUPS.values())
    got = mix.subnational_mix(mixed, "JP-", ["w/ grid"], 2050, vocab.PREFECTURE_GROUPS, order)
    assert rows_of(got, "Sr", "value", "ord") == [("Hokkaido", 6.0, 1)]


def test_trade_volume_by_sign(table):
    h = table("Sc string, Sv string, Sr string, value double", *[("s", "Trd_Sec_Ene_Ele", "JP-HD", v) for v in (3.0, -1.0, -1.0, 0.0)])
    assert rows_of(mix.trade_volume(h, "JP-"), "Sv", "value") == [("export", -2.0), ("import", 3.0)]


# capacity --------------------------------------------------------------------

LNK = [
    ("500C", "JP-HD-AC_JP-TH-AC", "2046", 1.0),
    ("500C", "JP-HD-AC_JP-TH-AC", "2050", 3.0),
    ("500C_Elc40", "JP-HD-AC_JP-TH-AC", "2050", 5.0),
    ("500C_Elc40", "KR-AC_JP-KY-AC", "2050", 7.0),
    ("500C_Elc40", "JP-CG-AC_JP-KY-AC", "2050", 11.0),
    ("500C_Elc40", "RU-AC_MN-AC", "2050", 13.0),
    ("500C_Elc40", "JP-HD-AC_JP-HD-DC", "2050", 17.0),
    ("500C_Elc40", "broken", "2050", 19.0),
]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(LNK, "Sc string, PW_LNK string, YEAR string, value double")


@pytest.fixture(scope="module")
def link_cap(links):
    return capacity.link_capacity(links)


def test_link_capacity_means_per_bin(link_cap):
    got = dict(rows_of(link_cap.filter("Sc = '500C'"), "PW_LNK", "value"))
    assert got == {"JP-HD-AC_JP-TH-AC": 2.0}


def test_corridors_keep_the_unnamed_group(link_cap):
    got = rows_of(capacity.corridor_capacity(link_cap, LABELS, ["w/ grid"]), "Sv", "value", "Flag")
    assert got == [("Japan domestic", 16.0, "domestic"), ("Korea/Japan", 7.0, "international"), (None, 13.0, None)]


def test_corridor_completion(link_cap):
    cap = capacity.corridor_capacity(link_cap, LABELS, ["w/ grid", "w/o grid"])
    got = rows_of(capacity.corridor_complete(cap, ["w/ grid", "w/o grid"]), "Sv", "Sc", "value")
    assert got == [("Korea/Japan", "w/ grid", 7.0), ("Korea/Japan", "w/o grid", 0.0)]


def test_short_corridor_names(link_cap):
    cap = capacity.corridor_capacity(link_cap, LABELS, ["w/ grid"], vocab.CAPACITY_CORRIDORS_SHORT, capacity.short_scope())
    assert rows_of(cap, "Sv", "Flag") == [("JPN", "domestic"), ("KOR-JPN", "international"), (None, None)]


def test_small_links_collapse(link_cap):
    got = rows_of(capacity.domestic_links(link_cap, LABELS, ["w/ grid"]), "Sv", "value")
    assert got == [("JP-HD / JP-TH", 5.0), ("KR / JP-KY", 7.0), ("Other", 11.0)]


def test_link_difference_is_null_without_counterpart(link_cap):
    got = rows_of(capacity.link_difference(link_cap, LABELS, "w/ grid", "w/o grid"), "Sv", "value")
    assert got == [("JP-CG / JP-KY", None), ("JP-HD / JP-TH", 3.0)]


def test_links_with_coordinates(link_cap, table):
    nodes = table("Sr string, centroid_x double, centroid_y double, geometry string", ("JP-HD", 1.0, 2.0, "g"), ("KR", 3.0, 4.0, "g"))
    got = capacity.links_with_coordinates(link_cap, nodes, LABELS, ["w/ grid"], 2050)
    want = ("KR", "JP-KY", 0.007, 3.0, 4.0, None, None)
    assert want in rows_of(got, "N0", "N1", "value", "x0", "y0", "x1", "y1")


def test_intra_node_power(links):
    got = rows_of(capacity.intra_node_power(links, "^(JP-[A-Z]+)"), "Sr", "Sv", "Sy", "value")
    assert got == [("JP-HD", "Cap_Ele_Sto_LiB_Pow", 2050, 17.0)]


def test_generator_and_storage_codes(table):
    gen = table("SE0 string, PW_GEN string, N string, YEAR string, Sc string, value double",
                ("ALL", "PVC", "JP-HD", "2050", "s", 1.0), ("ALL", "ZZZ", "JP-HD", "2050", "s", 2.0), ("SUB", "PVC", "JP-HD", "2050", "s", 3.0))
    assert rows_of(capacity.generator_capacity(gen)) == [("s", "JP-HD", "Cap_Ele_Solar_Cen", 2050, 1.0)]
    sto = table("SE0 string, PW_STO string, N string, YEAR string, Sc string, value double",
                ("ALL", "LIBE", "JP-HD", "2050", "500C", 4.0), ("ALL", "LIBE", "KR", "2050", "500C", 6.0), ("ALL", "LIBE", "RU", "2050", "500C", 1.0))
    binned = capacity.storage_capacity(sto, LABELS, ["w/o grid"])
    got = rows_of(capacity.storage_by_country(binned, 2050), "Sr2", "Sv", "value")
    assert got == [("JPN", "Li-ion battery", 4.0), ("KOR", "Li-ion battery", 6.0), ("Total", "Li-ion battery", 11.0), (None, "Li-ion battery", 1.0)]


def test_installed_vs_potential(table):
    inst = table("Sc string, N string, R string, value double", ("a", "JP-HD", "PVC", 2.0), ("a", "KR", "PVC", 9.0), ("a", "JP-HD", "WNO", 4.0))
    mx = table("N string, R string, value double", ("JP-HD", "PVC", 5.0), ("JP-TH", "PVC", 6.0), ("JP-HD", "coal", 7.0))
    got = rows_of(capacity.installed_vs_potential(inst, mx, {"a": "in a", "b": "in b"}), "N", "Sv", "value")
    assert got == [
        ("JP-HD", "in a", 2.0), ("JP-HD", "in b", 0.0), ("JP-HD", "maximum installable capacity", 5.0),
        ("JP-TH", "in a", 0.0), ("JP-TH", "in b", 0.0), ("JP-TH", "maximum installable capacity", 6.0),
    ]


# balance ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def hourly(spark):
    rows = [
        ("w/ grid", "Fin_Ene_Ele", "JPN", "D001H00", 1000.0),
        ("w/ grid", "Fin_Ene_Ele", "JPN", "D001H20", 500.0),
        ("w/o grid", "Sec_Ene_Ele_Nuc", "JPN", "D001H00", 700.0),
        ("w/ grid", "not listed", "JPN", "D001H00", 1.0),
    ]
    return spark.createDataFrame(rows, "Sc string, Sv string, Sr string, St string, value double")


def test_hourly_balance_is_the_full_product(hourly, matrix):
    dense = balance.hourly_balance(hourly, vocab.HOURLY, matrix)
    assert dense.count() == 2 * 2 * 1 * 2
    got = rows_of(dense.filter("value <> 0"), "Sc", "Sv", "T", "value", "cat2")
    assert got == [
        ("w/ grid", "Fin_Ene_Ele", 10, 1000.0, "w/ grid"), ("w/ grid", "Fin_Ene_Ele", 30, 500.0, "w/ grid"),
        ("w/o grid", "Sec_Ene_Ele_Nuc", 10, 700.0, "w/o grid"),
    ]


def test_daily_balance_and_view(hourly, matrix):
    daily = balance.daily_balance(balance.hourly_balance(hourly, vocab.HOURLY, matrix))
    view = balance.dispatch_daily_summary(daily, "JPN", 2050)
    assert rows_of(view, "Sc", "Sv", "D", "value") == [
        ("w/ grid", "Fin_Ene_Ele", date(2050, 1, 1), -1.0), ("w/ grid", "Fin_Ene_Ele", date(2050, 1, 2), -0.5),
        ("w/o grid", "Sec_Ene_Ele_Nuc", date(2050, 1, 1), 0.7),
    ]
    assert rows_of(balance.variable_presence(daily, ["Fin_Ene_Ele"])) == [("Fin_Ene_Ele", 4, 2)]
    assert balance.dispatch_daily_scenario(daily, "JPN", 2050, "w/o grid").count() == 1


def test_hour_window_and_overlay(hourly, matrix):
    dense = balance.hourly_balance(hourly, vocab.HOURLY, matrix)
    window = ("2050-01-01", "2050-01-01")
    bars = balance.dispatch_hourly_summary(dense, window, "JPN", 2050)
    assert rows_of(bars, "Sc", "T", "value") == [("w/ grid", datetime(2050, 1, 2, 9), -1.0), ("w/o grid", datetime(2050, 1, 2, 9), 0.7)]
    line = balance.demand_line(hourly, "JPN", 2050, window, ["w/ grid"])
    both = balance.window_with_overlay(bars, line)
    assert rows_of(both.groupBy("layer").count()) == [("bar", 2), ("line", 1)]


def test_roles_collapse_before_completion(hourly, matrix):
    got = balance.hourly_balance(hourly, vocab.HOURLY_BY_ROLE, matrix, merge=vocab.HOURLY_TO_ROLE)
    assert rows_of(got, "Sc", "Sv", "value") == [("w/o grid", "Other", 700.0)]


def test_facet_counts(hourly, matrix):
    assert rows_of(balance.facet_counts(balance.hourly_balance(hourly, vocab.HOURLY, matrix))) == [(1, 2, False)]


# prices ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def mcoe(spark):
    price = [
        ("500C", "JP-HD", "AC", "t1", 10.0), ("500C", "JP-TH", "AC", "t1", 20.0), ("500C", "KR", "AC", "t1", 30.0),
        ("500C", "JP-HD", "AC", "t2", 50.0), ("500C", "JP-HD", "AC", "ANN", 99.0), ("500C", "KR-X", "AC2", "t1", 70.0),
    ]
    dmd = [("500C", "JP-HD", "AC2", "t1", 1.0), ("500C", "JP-TH", "AC2", "t1", 3.0), ("500C", "KR", "AC2", "t1", 4.0), ("500C", "JP-HD", "H2", "t2", 1.0)]
    schema = "Sc string, N string, I string, MT string, value double"
    return prices.price_table(spark.createDataFrame(price, schema), spark.createDataFrame(dmd, schema))


def test_price_table_excludes_annual_rows(mcoe):
    assert mcoe.count() == 5
    assert rows_of(mcoe.filter("T = 't2'"), "price", "dmd") == [(50.0, None)]


def test_slice_prices_are_null_without_demand(mcoe):
    assert rows_of(prices.slice_price(mcoe, LABELS), "Sc", "T", "value") == [("w/o grid", "t1", 17.5), ("w/o grid", "t2", None)]


def test_country_prices_and_total(mcoe):
    t1 = mcoe.filter("T = 't1'")
    assert rows_of(prices.country_price(t1, LABELS), "I", "Sr", "value") == [
        ("AC", "JPN", 17.5), ("AC", "KOR", 30.0), ("AC", "Total", pytest.approx(23.75)), ("AC2", "Total", None), ("AC2", None, None),
    ]
    assert rows_of(prices.node_price(t1, LABELS), "Sr", "value") == [("JP-HD", 10.0), ("JP-TH", 20.0)]


def test_price_curve(mcoe):
    assert rows_of(prices.price_curve(prices.slice_price(mcoe, LABELS)), "T", "St", "value") == [(1, "t1", 17.5), (2, "t2", None)]


def test_policy_facets_first_match(table):
    df = table("Sc string", ("1000C w/ grid",), ("500C w/o grid",), ("NoPOL",))
    got = rows_of(prices.with_policy_facets(df))
    assert got == [("1000C w/ grid", "1000C", "w/ grid"), ("500C w/o grid", "500C", "w/o grid"), ("NoPOL", None, None)]


# costs -----------------------------------------------------------------------


def test_asset_cost_classes(table):
    symbols = table(
        "symbol string, Sc string, N string, R string, SE0 string, YEAR int, value double",
        ("gen_inv", "s", "KR", "PVC", "ALL", 2030, 1.0), ("gen_inv", "s", "KR", "??", "ALL", 2030, 2.0),
        ("gen_inv", "s", "KR", "PVC", "SUB", 2030, 4.0), ("sto_inv", "s", "KR", None, "ALL", 2030, 8.0),
        ("gen_fom", "s", "KR", None, "ALL", 2030, 16.0), ("sto_fom", "s", "KR", None, "ALL", 2030, 32.0), ("gen_vom", "s", "KR", None, "ALL", 2030, 64.0),
    )
    assert rows_of(costs.asset_cost(symbols), "Sv", "value") == [
        ("CAPEX (battery)", 8.0), ("CAPEX (solar)", 1.0), ("Fuel", 64.0), ("OPEX", 48.0), (None, 2.0),
    ]


def test_stacked_symbols(table):
    one = table("Sc string, value double", ("s", 1.0))
    got = costs.stack_symbols(lnk_inv=one, lnk_fom=one)
    assert rows_of(got, "symbol", "value") == [("lnk_fom", 1.0), ("lnk_inv", 1.0)]


def test_link_cost_allocation(table):
    symbols = table(
        "symbol string, Sc string, L string, YEAR int, value double",
        ("lnk_inv", "s", "KR-AC_JP-KY-AC", 2030, 10.0), ("lnk_inv", "s", "JP-HD-AC_JP-TH-AC", 2030, 4.0),
        ("lnk_inv", "s", "JP-HD-AC_JP-HD-DC", 2030, 3.0), ("lnk_inv", "s", "JP-HD-AC_JP-HD-PHS", 2030, 2.0),
        ("lnk_fom", "s", "KR-AC_JP-KY-AC", 2030, 1.0),
    )
    assert rows_of(costs.link_cost(symbols), "N", "Sv", "value") == [
        ("JP-HD", "CAPEX (battery)", 3.0), ("JP-HD", "CAPEX (domestic interconnection)", 4.0), ("JP-HD", "CAPEX (other)", 2.0),
        ("JP-KY", "CAPEX (international interconnection)", 5.0), ("JP-KY", "OPEX", 0.5),
        ("KR", "CAPEX (international interconnection)", 5.0), ("KR", "OPEX", 0.5),
    ]


def test_increment_spreads_model_years_backward(table):
    schema = "Sc string, N string, Sv string, YEAR int, value double"
    asset = table(schema, ("s", "KR", "OPEX", 2025, 10.0), ("NoPOL", "KR", "OPEX", 2025, 4.0), ("s", "KR", "OPEX", 2015, 99.0))
    empty = asset.limit(0)
    inc = costs.annual_increment(asset, empty)
    got = {r.YEAR: r.value for r in inc.collect()}
    assert sorted(got) == list(range(2020, 2051))
    assert got[2020] == 0.0 and [got[y] for y in range(2021, 2026)] == [6.0] * 5 and got[2026] == 0.0
    npv = costs.increment_npv(inc, {"s": "shown"}).first()
    assert (npv.Sc, npv.Sr2) == ("shown", "KOR")
    assert npv.value == pytest.approx(6.0 * sum(0.95 ** (y - 2020) for y in range(2021, 2026)))


def test_later_window_keeps_the_discount_base(table):
    schema = "Sc string, N string, Sv string, YEAR int, value double"
    asset = table(schema, ("s", "KR", "OPEX", 2040, 1.0), ("s", "KR", "OPEX", 2025, 50.0))
    inc = costs.annual_increment(asset, asset.limit(0), first=2040)
    assert inc.count() == 11
    assert costs.increment_npv(inc, {}).first().value == pytest.approx(0.95**20)


def test_headline_and_percentages(table):
    npv = table("Sc string, Sv string, Sr2 string, value double",
                ("w/ grid", "CAPEX (wind)", "JPN", 1.0), ("w/ grid", "CAPEX (fossil w/o CCS)", "KOR", 3.0))
    gdp = table("Sr2 string, GDP double", ("JPN", 50.0), ("KOR", 150.0), ("Total", 200.0))
    total = costs.cost_with_total(npv)
    head = costs.headline_cost(costs.cost_all_classes(total), gdp)
    assert rows_of(head, "Sc", "Sc2", "value", "value2") == [("w/ grid", "2040", 4.0, 2.0)]
    pct = costs.cost_pct_gdp(total, gdp)
    assert rows_of(pct.filter("Sr2 <> 'Total'"), "Sr2", "Sv", "value") == [("JPN", "CAPEX (solar/wind)", 2.0), ("KOR", "CAPEX (fossil)", 2.0)]
    assert rows_of(costs.absolute_to_pct(head, divisor=2.0), "trillion", "pct") == [(2.0, 2.0)]


# inputs and maps -------------------------------------------------------------


def test_demand_completion(table):
    d = table("Sc string, N string, I string, Y string, value double", ("500C", "JP-HD", "H2", "2030", 2.0), ("500C", "KR", "H2", "2030", 3.0))
    got = rows_of(inputs.demand_by_carrier(d, LABELS, ["NoPOL", "w/o grid"], [2025, 2030]), "I", "Sc", "Y", "value")
    assert got == [("Hydrogen", "NoPOL", 2025, 0.0), ("Hydrogen", "NoPOL", 2030, 0.0), ("Hydrogen", "w/o grid", 2025, 0.0), ("Hydrogen", "w/o grid", 2030, 5.0)]
    by = rows_of(inputs.demand_by_country(d, LABELS, ["w/o grid"], "H2", [2025, 2030]), "Sr", "Y", "value")
    assert by == [("JPN", 2025, 0.0), ("JPN", 2030, 2.0), ("KOR", 2025, 0.0), ("KOR", 2030, 3.0)]


def test_emission_cap(table):
    c = table("Sc string, MQ string, Y string, value double", ("s", "JPN", "2030", 1.0), ("s", "KOR", "2030", 2.0))
    assert rows_of(inputs.emission_cap(c)) == [(2030, 3.0)]
    assert rows_of(inputs.emission_cap(c, ["MQ"])) == [(2030, "JPN", 1.0), (2030, "KOR", 2.0)]


def test_node_map(mixed, table):
    nodes = table("Sr string, centroid_x double, centroid_y double", ("JP-HD", 100.0, 40.0))
    nm = maps.node_mix(mixed, nodes, 2050, ["w/ grid"])
    assert rows_of(nm, "Sv", "Sr", "value", "centroid_x") == [("Sec_Ene_Ele_Nuc", "JP-HD", 6.0, 100.0)]
    box = maps.symbol_boxes(nm.drop("centroid_x", "centroid_y"), nodes, divisor=10.0)
    assert rows_of(box, "xmin", "xmax", "ymin", "ymax") == [(99.5, 100.5, 39.5, 40.5)]
    moved = maps.adjusted_centroids(nodes, {"JP-HD": (0.5, -0.25)})
    assert rows_of(moved) == [("JP-HD", 100.5, 39.75)]
    assert maps.node_slice(nm, "JP-HD", "w/o grid").count() == 0


def test_codes_with_one_label_are_not_added_up(table):
    """Sums and means are made per raw code, relabelled after."""
    labels = {"a": "same", "b": "same"}
    links = table("Sc string, PW_LNK string, Y5 int, value double", ("a", "JP-HD-AC_JP-TH-AC", 2050, 1.0), ("b", "JP-HD-AC_JP-TH-AC", 2050, 5.0))
    got = rows_of(capacity.corridor_capacity(links, labels, ["same"]), "Sc", "value")
    assert got == [("same", 1.0), ("same", 5.0)]
    got = rows_of(capacity.domestic_links(links, labels, ["same"]), "Sc", "value")
    assert got == [("same", 1.0), ("same", 5.0)]
    rows = table("Sc string, Sr string, Sv string, Sy int, value double", ("a", "KR", "x", 2050, 1.0), ("b", "KR", "x", 2050, 5.0))
    got = rows_of(capacity.binned_capacity(rows, labels, ["same"], [("KR", "KOR")]), "Sc", "value")
    assert got == [("same", 1.0), ("same", 5.0)]


def test_cost_per_year_has_countries_and_total(table):
    rows = [("s", 2020, "JPN", "a", 1.0), ("s", 2020, "JPN", "b", 2.0), ("s", 2020, "KOR", "a", 4.0), ("s", 2021, "KOR", "a", 10.0)]
    df = table("Sc string, YEAR int, Sr2 string, Sv string, value double", *rows)
    got = rows_of(costs.cost_per_year(df), "YEAR", "Sr2", "value")
    assert got == [(2020, "JPN", 3.0), (2020, "KOR", 4.0), (2020, "Total", 7.0), (2021, "KOR", 9.5), (2021, "Total", 9.5)]
