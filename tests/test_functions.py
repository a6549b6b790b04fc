"""Column functions on hand-written values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scenaria import functions as fn
from scenaria import vocab
from scenaria.functions.timeslice import hour_window_columns

from conftest import rows_of


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    "year, bin_",
    [(1995, 1995), (1996, 2000), (2000, 2000), (2001, 2005), (2005, 2005), (2006, 2010), (2046, 2050), (2050, 2050)],
)
def test_year_bin(spark, year, bin_):
    assert one(spark, fn.year_bin(F.lit(year))) == (bin_,)


def test_strict_aggregates_propagate_null(table):
    df = table("g string, v double", ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None), ("c", None))
    got = df.groupBy("g").agg(fn.strict_sum("v").alias("s"), fn.strict_avg("v").alias("m"))
    assert rows_of(got) == [("a", 3.0, 1.5), ("b", None, None), ("c", None, None)]


def test_weighted_mean(table):
    df = table(
        "g string, x double, w double",
        ("a", 10.0, 1.0), ("a", 20.0, 3.0), ("zero", 5.0, 0.0), ("null", 5.0, None), ("null", 5.0, 1.0),
    )
    got = df.groupBy("g").agg(fn.weighted_mean("x", "w").alias("m"))
    assert rows_of(got) == [("a", 17.5), ("null", None), ("zero", None)]


def test_percent_of_zero_is_null(spark):
    assert one(spark, fn.percent_of(F.lit(1.0), F.lit(4.0)), fn.percent_of(F.lit(1.0), F.lit(0.0))) == (25.0, None)


def test_recode_passes_through_and_lookup_does_not(table):
    df = table("c string", ("x",), ("y",), (None,))
    got = df.select("c", fn.recode("c", {"x": "X"}).alias("r"), fn.lookup("c", {"x": "X"}).alias("l"))
    assert rows_of(got) == [("x", "X", "X"), ("y", "y", None), (None, None, None)]


def test_case_labels_without_default_are_null(spark):
    assert one(spark, fn.first_match(F.lit("RU-01"), vocab.COUNTRY_OF_NODE)) == (None,)


def test_first_match_is_ordered_and_unanchored(spark):
    got = one(
        spark,
        fn.first_match(F.lit("JP-KR"), vocab.COUNTRY_OF_NODE),
        fn.first_match(F.lit("KR-AC"), vocab.COUNTRY_OF_NODE),
        fn.first_match(F.lit("xMNx"), vocab.COUNTRY_OF_NODE),
        fn.first_match(F.lit("KR-AC"), [("KR", "KOR")], exact=True),
    )
    assert got == ("JPN", "KOR", "MNG", None)


def test_capture_without_match_is_null(spark):
    assert one(spark, fn.capture(F.lit("JP-HD-AC_JP-TH-AC"), vocab.LINK_ORIGIN), fn.capture(F.lit("none"), vocab.LINK_ORIGIN)) == (
        "JP-HD", None,
    )


def test_capture_is_lazy(spark):
    assert one(spark, fn.capture(F.lit("A-AC_B-AC_C-AC"), vocab.LINK_ORIGIN)) == ("A",)


@pytest.mark.parametrize(
    "bus, node",
    [("JP-HD-AC", "JP-HD"), ("JP-HD-AC2", "JP-HD"), ("JP-HD-PHS", "JP-HD"), ("JP-HD-H2-GT", "JP-HD-H2-GT"), ("KR", "KR")],
)
def test_strip_bus(spark, bus, node):
    assert one(spark, fn.strip_bus(F.lit(bus))) == (node,)


def test_link_label(spark):
    assert one(spark, fn.link_label(F.lit("KR-AC_JP-KY-AC"))) == ("KR / JP-KY",)


def test_corridor_needs_the_given_direction(spark):
    rules = vocab.CAPACITY_CORRIDORS
    got = one(
        spark,
        fn.class_of_ends(F.lit("KR-AC"), F.lit("JP-KY-AC"), rules),
        fn.class_of_ends(F.lit("JP-KY-AC"), F.lit("KR-AC"), rules),
        fn.class_of_ends(F.lit("JP-HD-AC"), F.lit("JP-TH-AC"), rules),
    )
    assert got == ("Korea/Japan", None, "Japan domestic")


@pytest.mark.parametrize(
    "n0, n1, label",
    [
        ("JP-HD-AC", "JP-HD-DC", "Cap_Ele_Sto_LiB_Pow"),
        ("JP-HD-AC", "JP-HD-H2", "Cap_Hyd_Ele"),
        ("JP-HD-H2", "JP-HD-H2S", "Cap_Hyd_Sto_H2S_Pow"),
        ("JP-HD-H2-GT", "JP-HD-AC", "Cap_Ele_H2_GT"),
        ("JP-HD-AC", "JP-HD-AC2", "Cap_Ele_Dis"),
        ("JP-HD-AC", "JP-HD-XX", None),
    ],
)
def test_asset_of_buses(spark, n0, n1, label):
    assert one(spark, fn.class_of_ends(F.lit(n0), F.lit(n1), vocab.ASSET_OF_BUSES)) == (label,)


def test_same_site(spark):
    p = "^(JP-[A-Z]+)-"
    assert one(
        spark, fn.same_site(F.lit("JP-HD-AC"), F.lit("JP-HD-DC"), p), fn.same_site(F.lit("JP-HD-AC"), F.lit("JP-TH-DC"), p)
    ) == ("JP-HD", None)


def test_link_scope_keeps_null(spark):
    assert one(spark, fn.link_scope(F.lit("Japan domestic")), fn.link_scope(F.lit("a/b")), fn.link_scope(F.lit(None).cast("string"))) == (
        "domestic", "international", None,
    )


def test_slice_hour_does_not_wrap(spark):
    got = one(spark, fn.slice_hour(F.lit("D001H00")), fn.slice_hour(F.lit("D365H23"), 9), fn.slice_hour(F.lit("ANN")))
    assert got == (1, 8769, None)
    assert one(spark, fn.day_of_hour(F.lit(8769)), fn.day_of_hour(F.lit(24)), fn.day_of_hour(F.lit(25))) == (366, 1, 2)


def test_calendar_values(spark):
    got = one(
        spark,
        fn.date_of_day(F.lit(32), 2050),
        fn.timestamp_of_hour(F.lit(1), 2050, 23),
        fn.month_day(F.lit(date(2050, 7, 5))),
    )
    assert got == (date(2050, 2, 1), datetime(2050, 1, 2, 0, 0), "Jul 05")


def test_hour_window_includes_the_end_day(spark):
    assert fn.hour_window("2050-01-01", "2050-01-01") == (1, 24)
    assert fn.hour_window("2050-07-25", "2050-08-07") == (205 * 24 + 1, 218 * 24 + 24)
    a, b = hour_window_columns(F.lit(date(2050, 7, 25)), F.lit(date(2050, 8, 7)))
    assert one(spark, a, b) == fn.hour_window("2050-07-25", "2050-08-07")


def test_unreadable_number_is_null(spark):
    assert one(spark, fn.to_number(F.lit("2050")), fn.to_number(F.lit("abc"))) == (2050, None)


def test_sign_flip_and_carrier(spark):
    got = one(
        spark,
        fn.sign_flip(F.lit("out"), F.lit(2.0), ["out"]),
        fn.sign_flip(F.lit("in"), F.lit(2.0), ["out"]),
        fn.carrier_equivalent(F.lit("H2"), F.lit(6.8)),
        fn.carrier_equivalent(F.lit("AC2"), F.lit(6.8)),
    )
    assert got == (-2.0, 2.0, pytest.approx(10.0), 6.8)


def test_discount_is_not_a_compound_rate(spark):
    got = one(spark, fn.discount_factor(F.lit(2022)), fn.discount_factor(F.lit(2020)))
    assert got == (pytest.approx(0.9025), 1.0)


def test_symmetric_limit(table):
    df = table("v double", (-5.0,), (3.0,))
    assert rows_of(df.agg(fn.symmetric_limit("v"))) == [(5.0,)]


def test_sub_is_one_based_inclusive(spark):
    assert one(spark, fn.sub(F.lit("D123H45"), 2, 4), fn.sub(F.lit("JP-HD"), 1, 2), fn.sub(F.lit("abc"), 2)) == ("123", "JP", "bc")
