"""Flow orientation and net trade."""

import pytest
from pyspark.sql import functions as F

from scenaria import operators as op
from scenaria.plans import trade

from conftest import rows_of

SCHEMA = "Sc string, N0 string, N1 string, L string, T string, YEAR int, value double"
LINK = "KR-AC_JP-KY-AC"
ROWS = [
    ("s", "KR", "JP-KY", LINK, "D001H00", 2050, 5.0),
    ("s", "KR", "JP-KY", LINK, "D001H00", 2050, 1.0),
    ("s", "JP-KY", "KR", LINK, "D001H00", 2050, 2.0),
    ("s", "JP-KY", "KR", LINK, "D001H01", 2050, 4.0),
    ("s", "KR", "JP-KY", LINK, "D001H02", 2050, 0.0),
    ("s", "KR", "JP-KY", LINK, "D001H00", 2045, 9.0),
    ("s", "CN-NE", "RU", "none", "D001H00", 2050, 9.0),
]


def signed(table):
    return trade.flow_of_links(table(SCHEMA, *ROWS), 2050, [LINK, "none"])


def test_flows_are_oriented_along_the_link(table):
    got = rows_of(signed(table), "St", "N0", "N1", "value")
    assert got == [("D001H00", "KR", "JP-KY", -2.0), ("D001H00", "KR", "JP-KY", 6.0), ("D001H01", "KR", "JP-KY", -4.0)]


def test_gross_flow_has_its_real_direction(table):
    got = rows_of(op.directed_flow(signed(table)), "St", "N0", "N1", "value")
    assert got == [("D001H00", "JP-KY", "KR", 2.0), ("D001H00", "KR", "JP-KY", 6.0), ("D001H01", "JP-KY", "KR", 4.0)]


def test_netting_happens_per_slice(table):
    yearly = trade.yearly_trade(signed(table))
    assert rows_of(yearly, "Sr", "Sv", "value") == [
        ("JPN", "export", -4.0), ("JPN", "import", 4.0), ("KOR", "export", -4.0), ("KOR", "import", 4.0),
    ]
    assert rows_of(trade.net_balance(yearly), "Sr", "value") == [("JPN", 0.0), ("KOR", 0.0)]


def test_net_balance_is_null_if_one_side_is_missing(table):
    only = trade.flow_of_links(table(SCHEMA, ROWS[0]), 2050, [LINK])
    assert rows_of(trade.net_balance(trade.yearly_trade(only)), "Sr", "value") == [("JPN", None), ("KOR", None)]


def test_export_equals_import_before_losses(table):
    node = trade.trade_by_node(signed(table))
    tot = dict(rows_of(node.groupBy("Sv").agg(F.sum("value"))))
    assert tot["export"] == tot["import"] == 12.0


def test_receive_side_is_an_argument(table):
    rec = table(SCHEMA, *[(*r[:6], r[6] * 0.5) for r in ROWS])
    received = trade.flow_of_links(rec, 2050, [LINK])
    tot = dict(rows_of(trade.trade_by_node(signed(table), received).groupBy("Sv").agg(F.sum("value"))))
    assert tot == {"export": 12.0, "import": 6.0}


def test_orientation_preserves_magnitude_and_coordinates(table):
    df = table("N0 string, N1 string, x0 double, x1 double, value double", ("a", "b", 1.0, 2.0, -3.0), ("a", "b", 1.0, 2.0, 0.0))
    got = op.reorient(df, pairs=[("N0", "N1"), ("x0", "x1")], negate=False)
    assert rows_of(got) == [("b", "a", 2.0, 1.0, -3.0)]


def test_self_link_cancels(table):
    rows = [("s", "KR", "KR", "KR-AC_KR-AC", "D001H00", 2050, 5.0)]
    assert rows_of(trade.flow_of_links(table(SCHEMA, *rows), 2050, ["KR-AC_KR-AC"])) == []


def test_heat_map_is_dense_and_shifted(table):
    heat = trade.corridor_heat(signed(table), 2050)
    got = rows_of(heat, "Sv", "St", "value", "H", F.col("D").cast("string"))
    assert got == [("Korea/Japan", "D001H00", 4.0, 9, "2050-01-01"), ("Korea/Japan", "D001H01", -4.0, 10, "2050-01-01")]
    use = rows_of(trade.corridor_use(heat), "mean_abs", "total")
    assert use == [(4.0, 0.0)]
    assert rows_of(trade.corridor_range(heat, "Korea/Japan"), "lo", "hi", "limit") == [(-0.004, 0.004, 0.004)]


def test_utilisation_joins_on_the_scenario(table):
    heat = trade.corridor_heat(signed(table), 2050)
    cap = table("Sc string, Sv string, Y5 int, value double", ("s", "Korea/Japan", 2050, 8.0), ("other", "Korea/Japan", 2050, 1.0))
    assert rows_of(trade.utilisation(heat, cap, 2050), "St", "value") == [("D001H00", 50.0), ("D001H01", -50.0)]


def test_trade_share_matches_null_countries(table):
    yearly = table("Sc string, Sr string, Sv string, value double", ("s", None, "import", 1e6), ("s", "JPN", "import", 3e6))
    dmd = table("Sc string, Sr string, dmd double", ("s", None, 4e6), ("s", "JPN", 0.0))
    got = rows_of(trade.trade_vs_demand(yearly, dmd), "Sr", "value", "dmd", "rate")
    assert got == [("JPN", 3.0, 0.0, None), (None, 1.0, 4.0, 25.0)]


def test_demand_in_electricity(table):
    d = table("Sc string, N string, I string, value double", ("s", "JP-HD", "H2", 6.8), ("s", "JP-TH", "AC2", 1.0), ("s", "JP-TH", "CH4", 9.0))
    assert rows_of(trade.electricity_demand(d)) == [("s", "JPN", pytest.approx(11.0))]
