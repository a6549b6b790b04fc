"""Table operators on hand-written tables."""

import pytest
from pyspark.sql import functions as F

from scenaria import operators as op
from scenaria.operators.category import category_rank

from conftest import rows_of


# joins -----------------------------------------------------------------------


def test_natural_join_matches_null_keys(table):
    left = table("k string, a int", ("x", 1), (None, 2), ("y", 3))
    right = table("k string, b int", ("x", 10), (None, 20))
    assert rows_of(op.natural_join(left, right)) == [("x", 1, 10), ("y", 3, None), (None, 2, 20)]


def test_natural_full_join_keeps_both_sides(table):
    left = table("k string, a int", ("x", 1), (None, 2))
    right = table("k string, b int", ("z", 10), (None, 20))
    assert rows_of(op.natural_join(left, right, "full")) == [("x", 1, None), ("z", None, 10), (None, 2, 20)]


def test_natural_right_join_keys_come_from_the_right(table):
    left = table("k string, a int", ("x", 1))
    right = table("k string, b int", ("x", 10), ("w", 5))
    assert rows_of(op.natural_join(left, right, "right")) == [("w", None, 5), ("x", 1, 10)]


def test_code_join_drops_unmapped_and_fact_free_codes(table):
    facts = table("code string, y int, v double", ("A", 1, 1.0), ("Z", 1, 2.0), (None, 1, 3.0))
    codes = table("code string, Sv string", ("A", "alpha"), ("B", "beta"))
    assert rows_of(op.code_join(facts, codes, ["Sv", "y"])) == [("A", 1, 1.0, "alpha")]
    assert rows_of(op.code_join(facts, codes, ["Sv"]), "code", "Sv", "v") == [("A", "alpha", 1.0), ("B", "beta", None)]


def test_semi_join_ignores_null_and_keeps_duplicates(table):
    df = table("Sc string, v int", ("a", 1), ("a", 2), ("b", 3), (None, 4))
    keys = table("Scenario string", ("a",), ("a",), (None,))
    assert rows_of(op.semi_join(df, keys, {"Sc": "Scenario"})) == [("a", 1), ("a", 2)]


def test_role_join_twice(table):
    links = table("N0 string, N1 string", ("a", "b"), ("b", "zz"))
    nodes = table("Sr string, x double", ("a", 1.0), ("b", 2.0))
    got = op.role_join(op.role_join(links, nodes, "Sr", "N0", "0"), nodes, "Sr", "N1", "1")
    assert rows_of(got, "N0", "N1", "x0", "x1") == [("a", "b", 1.0, 2.0), ("b", "zz", 2.0, None)]


def test_union_fills_missing_columns(table):
    got = op.union_rows(table("a int", (1,)), table("b int, a int", (9, 2)))
    assert rows_of(got, "a", "b") == [(1, None), (2, 9)]


# columns ---------------------------------------------------------------------


def test_swap_is_simultaneous(table):
    df = table("N0 string, N1 string, v int", ("a", "b", -1), ("c", "d", 1))
    assert rows_of(op.swap(df, ("N0", "N1"))) == [("b", "a", -1), ("d", "c", 1)]
    assert rows_of(op.swap(df, ("N0", "N1"), where=F.col("v") < 0)) == [("b", "a", -1), ("c", "d", 1)]


def test_split_link_short_and_long_keys(table):
    df = table("L string", ("a_b",), ("solo",), ("a_b_c",))
    assert rows_of(op.split_link(df, "L")) == [("a_b", "a", "b"), ("a_b_c", "a", "b"), ("solo", "solo", None)]
    assert op.split_link(df, "L", keep=False).columns == ["N0", "N1"]


def test_categories_to_text(table):
    df = table("a binary, b int", (bytearray(b"x"), 1))
    assert dict(op.categories_to_text(df).dtypes) == {"a": "string", "b": "int"}


def test_as_category_closes_the_domain(table):
    df = table("c string", ("a",), ("b",), ("z",), (None,))
    got = op.as_category(df, "c", ["a", "b"], ord_col="ord", reverse=True)
    assert rows_of(got) == [("a", 2), ("b", 1), (None, None), (None, None)]


def test_category_rank_null(table):
    assert rows_of(table("c string", (None,)).select(category_rank("c", ["a"]))) == [(None,)]


def test_display_order(table):
    df = table("v int", (2,), (None,), (3,), (1,))
    assert [r.v for r in op.display_order(df, "v").collect()] == [1, 2, 3, None]
    assert [r.v for r in op.display_order(df, "v", descending=True).collect()] == [3, 2, 1, None]


def test_map_columns(table):
    got = op.map_columns(table("a int, b int, c int", (1, 2, 3)), ["a", "b"], lambda c: c - F.col("c"))
    assert rows_of(got) == [(-2, -1, 3)]
    assert rows_of(op.select_renamed(got, {"x": "c"})) == [(3,)]


def test_unknown_scenario_loses_its_label(table):
    scen = table("Scenario string, scen_dpol string, scen_tpol string", ("s1", "d", "t"))
    got = op.with_scenario_category(table("Sc string, v int", ("s1", 1), ("s9", 2)), scen)
    assert rows_of(got, "Sc", "v", "cat1", "cat2") == [("s1", 1, "d", "t"), (None, 2, None, None)]


def test_attach_dimension(table):
    got = op.attach_dimension(table("Sv string", ("a",), ("q",)), [("a", "Alpha", "red"), ("b", "Beta", "blue")], "Sv")
    assert rows_of(got) == [("a", "Alpha", "red", 1), ("q", None, None, None)]


def test_classify_first_match(table):
    df = table("v int", (1,), (5,), (50,))
    got = op.classify(df, "c", {"small": F.col("v") < 3, "mid": F.col("v") < 10})
    assert rows_of(got) == [(1, "small"), (5, "mid"), (50, None)]


# aggregates ------------------------------------------------------------------


def test_grouped_sum_is_strict_and_keeps_null_groups(table):
    df = table("g string, value double", ("a", 1.0), ("a", None), (None, 2.0))
    assert rows_of(op.grouped_sum(df, ["g"])) == [("a", None), (None, 2.0)]


def test_totals_do_not_mix_with_null_members(table):
    df = table("Sc string, Sr2 string, value double", ("s", "JPN", 1.0), ("s", "JPN", 2.0), ("s", None, 4.0))
    assert rows_of(op.with_totals(df, ["Sc"], "Sr2")) == [("s", "JPN", 3.0), ("s", "Total", 7.0), ("s", None, 4.0)]


def test_totals_without_keys_and_strict(table):
    df = table("r string, GDP double", ("a", 1.0), ("b", None))
    assert rows_of(op.with_totals(df, [], "r", value="GDP")) == [("Total", None), ("a", 1.0), ("b", None)]


def test_weighted_totals_are_recomputed(table):
    df = table("Sc string, Sr string, p double, d double", ("s", "a", 10.0, 1.0), ("s", "b", 20.0, 3.0))
    got = rows_of(op.with_weighted_totals(df, ["Sc"], "Sr", "p", "d"))
    assert got == [("s", "Total", 17.5), ("s", "a", 10.0), ("s", "b", 20.0)]


def test_weighted_totals_null_and_zero_weight(table):
    df = table("Sc string, Sr string, p double, d double", ("s", "a", 10.0, None), ("s", "b", 20.0, 0.0))
    assert rows_of(op.with_weighted_totals(df, ["Sc"], "Sr", "p", "d")) == [("s", "Total", None), ("s", "a", None), ("s", "b", None)]


def test_half_allocation(table):
    df = table("Sv string, N0 string, N1 string, value double", ("c", "JP-a", "JP-b", 8.0), ("c", "JP-a", "KR", 6.0))
    shared = F.substring("N0", 1, 2) != F.substring("N1", 1, 2)
    assert rows_of(op.allocate_to_ends(df, shared, ["Sv"])) == [("JP-a", "c", 11.0), ("KR", "c", 3.0)]


def test_discounted_sum(table):
    df = table("k string, YEAR int, value double", ("a", 2020, 100.0), ("a", 2021, 100.0))
    assert rows_of(op.discounted_sum(df, ["k"])) == [("a", pytest.approx(195.0))]


def test_decade_sum_labels(table):
    df = table("Sc string, YEAR int, value double", *[("s", y, 1.0) for y in range(2020, 2052)])
    assert rows_of(op.decade_sum(df, ["Sc"])) == [("s", "2021-30", 10.0), ("s", "2031-40", 10.0), ("s", "2041-50", 10.0)]


def test_is_unused(table):
    df = table("a string, b string", (None, "x"), (None, None))
    assert rows_of(op.is_unused(df, ["a", "b"])) == [(True, False)]


def test_extents(table):
    df = table("g string, value double", ("a", -4.0), ("a", 3.0))
    assert rows_of(op.extents(df, ["g"])) == [("a", -4.0, 3.0, 4.0)]


# reshape ---------------------------------------------------------------------


def test_pivot_wider_fill_only_for_absent(table):
    df = table("id string, n string, v double", ("a", "x", 1.0), ("a", "y", None), ("b", "x", 2.0))
    got = op.pivot_wider(df, ["id"], "n", "v", ["x", "y"], fill=0.0)
    assert rows_of(got) == [("a", 1.0, None), ("b", 2.0, 0.0)]
    assert rows_of(op.pivot_wider(df, ["id"], "n", "v", ["x", "y"])) == [("a", 1.0, None), ("b", 2.0, None)]


def test_pivot_longer_casts_names(table):
    df = table("id string, `2020` double, `2025` double", ("a", 1.0, None))
    got = op.pivot_longer(df, ["id"], names_to="YEAR", values_to="v", names_type="int")
    assert rows_of(got) == [("a", 2020, 1.0), ("a", 2025, None)]


def test_densify_observed_and_given(table):
    df = table("id string, Y5 int, value double", ("a", 1, 1.0), ("b", 2, None))
    assert rows_of(op.densify(df, ["id"], "Y5")) == [("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 0.0), ("b", 2, 0.0)]
    only = op.densify(df, ["id"], "Y5", domain=[1, 3], keep_outside=False)
    assert rows_of(only) == [("a", 1, 1.0), ("a", 3, 0.0), ("b", 1, 0.0), ("b", 3, 0.0)]
    outside = op.densify(df, ["id"], "Y5", domain=[1, 3])
    assert rows_of(outside) == [("a", 1, 1.0), ("a", 3, 0.0), ("b", 1, 0.0), ("b", 2, 0.0), ("b", 3, 0.0)]
    years = table("y int", (1,), (2,))
    assert rows_of(op.densify(df, ["id"], "Y5", domain=years)) == rows_of(op.densify(df, ["id"], "Y5"))


def test_complete_is_a_full_join(table):
    df = table("a string, b int, value double", ("x", 1, 1.0), ("y", 9, 2.0), ("y", 1, None))
    got = op.complete(df, ["a", "b"], {"value": 0.0}, {"b": [1, 2]})
    assert rows_of(got) == [("x", 1, 1.0), ("x", 2, 0.0), ("y", 1, 0.0), ("y", 2, 0.0), ("y", 9, 2.0)]


def test_complete_keeps_duplicates_and_null_domain_values(table):
    df = table("a string, b int, value double", ("x", 1, 1.0), ("x", 1, 5.0), (None, 2, 2.0))
    got = op.complete(df, ["a", "b"], {"value": 0.0})
    assert rows_of(got) == [("x", 1, 1.0), ("x", 1, 5.0), ("x", 2, 0.0), (None, 1, 0.0), (None, 2, 2.0)]


def test_complete_sum_equals_complete_of_the_sum(table):
    df = table("a string, b string, value double", ("x", "p", 1.0), ("x", "p", 2.0), (None, "q", 4.0), ("y", "p", None))
    got = op.complete_sum(df, ["a", "b"])
    want = op.complete(op.grouped_sum(df, ["a", "b"]), ["a", "b"], {"value": 0.0})
    assert rows_of(got) == rows_of(want.select("a", "b", "value"))
    assert len(rows_of(got)) == 6


def test_complete_sum_with_slice_table(table):
    df = table("a string, St string, value double", ("x", "s1", 1.0), ("x", "s9", 3.0))
    slices = table("t string", ("s1",), ("s2",), ("s2",))
    got = op.complete_sum(df, ["a", "St"], domains={"St": slices})
    assert rows_of(got) == [("x", "s1", 1.0), ("x", "s2", 0.0), ("x", "s9", 3.0)]


def test_complete_series_within_groups(table):
    df = table("g string, Y int, value double", ("a", 2020, 1.0), ("a", 2100, 7.0), (None, 2025, None))
    got = op.complete_series(df, ["g"], "Y", [2020, 2025], fill=0.0)
    assert rows_of(got) == [("a", 2020, 1.0), ("a", 2025, 0.0), ("a", 2100, 7.0), (None, 2020, 0.0), (None, 2025, 0.0)]
    inside = op.complete_series(df, ["g"], "Y", [2020, 2025], keep_outside=False)
    assert rows_of(inside) == [("a", 2020, 1.0), ("a", 2025, None), (None, 2020, None), (None, 2025, None)]


def test_complete_series_over_pairs(table):
    df = table("I string, Sc string, Y int, value double", ("AC", "s", 2005, 1.0), ("AC", "other", 2005, 2.0))
    got = op.complete_series(df, ["I"], ["Sc", "Y"], [("s", 2005), ("s", 2010)], fill=0.0)
    assert rows_of(got) == [("AC", "other", 2005, 2.0), ("AC", "s", 2005, 1.0), ("AC", "s", 2010, 0.0)]


def test_delta_vs_baseline(table):
    df = table("k string, Sc string, value double", ("a", "NoPOL", 1.0), ("a", "s", 5.0), ("b", "s", 2.0), ("c", "NoPOL", 3.0))
    assert rows_of(op.delta_vs_baseline(df, ["k"])) == [("a", "s", 4.0), ("b", "s", 2.0), ("c", "s", -3.0)]
    kept = op.delta_vs_baseline(df, ["k"], scenarios=["NoPOL", "s"], drop_baseline=False)
    assert [r for r in rows_of(kept) if r[1] == "NoPOL"] == [("a", "NoPOL", 0.0), ("b", "NoPOL", 0.0), ("c", "NoPOL", 0.0)]


def test_contrast_with_and_without_fill(table):
    df = table("k string, c string, value double", ("a", "p", 5.0), ("a", "m", 2.0), ("b", "p", 1.0))
    assert rows_of(op.contrast(df, ["k"], "c", "p", "m", fill=0.0)) == [("a", 3.0), ("b", 1.0)]
    assert rows_of(op.contrast(df, ["k"], "c", "p", "m")) == [("a", 3.0), ("b", None)]


# series ----------------------------------------------------------------------


def test_share_of_total(table):
    df = table("k string, value double", ("a", 1.0), ("a", 3.0), ("z", 0.0), ("n", 1.0), ("n", None))
    got = rows_of(op.share_of_total(df, ["k"]), "k", "share")
    assert got == [("a", 25.0), ("a", 75.0), ("n", None), ("n", None), ("z", None)]


def test_carry_backward_and_tail(table):
    df = table("k string, Y int, value double", ("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None))
    assert rows_of(op.carry_backward(df, ["k"], "Y")) == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None)]


def test_interpolate_on_row_index_with_flat_ends(table):
    df = table(
        "k string, Y int, v double",
        ("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 10, 20.0), ("a", 11, None), ("b", 1, None),
    )
    got = rows_of(op.interpolate(df, ["k"], "Y", "v"))
    assert got == [("a", 1, 10.0), ("a", 2, 10.0), ("a", 3, 15.0), ("a", 10, 20.0), ("a", 11, 20.0), ("b", 1, None)]


# rank ------------------------------------------------------------------------


def test_duration_curve_breaks_ties_by_slice(table):
    df = table("Sc string, St string, value double", ("s", "t2", 5.0), ("s", "t1", 5.0), ("s", "t3", 9.0), ("q", "t1", 1.0), ("q", "t2", None))
    got = rows_of(op.duration_curve(df, ["Sc"], "value", ["St"]), "Sc", "T", "St")
    assert got == [("q", 1, "t1"), ("q", 2, "t2"), ("s", 1, "t3"), ("s", 2, "t1"), ("s", 3, "t2")]


@pytest.mark.parametrize("combine", ["only", "sum", "strict_sum"])
def test_absent_cells_take_the_fill_under_every_combine(table, combine):
    df = table("g string, y int, value double", ("a", 1, 2.0), ("b", 2, None))
    got = op.densify(df, ["g"], "y", fill=7.0, domain=[1, 2, 3], combine=combine)
    stored = 0.0 if combine == "sum" else 7.0  # a stored NULL counts as nothing in a sum
    assert rows_of(got) == [("a", 1, 2.0), ("a", 2, 7.0), ("a", 3, 7.0), ("b", 1, 7.0), ("b", 2, stored), ("b", 3, 7.0)]
    got = op.complete_series(df, ["g"], "y", [1, 2, 3], combine=combine)
    stored = 0.0 if combine == "sum" else None
    assert rows_of(got) == [("a", 1, 2.0), ("a", 2, None), ("a", 3, None), ("b", 1, None), ("b", 2, stored), ("b", 3, None)]
    filled = op.carry_backward(op.complete_series(df.filter("g = 'a'"), ["g"], "y", [0, 1, 2], combine=combine), ["g"], "y")
    assert rows_of(filled) == [("a", 0, 2.0), ("a", 1, 2.0), ("a", 2, 2.0)]


def test_rank_rows_equals_window_on_a_hot_group(spark):
    """One group holds most rows; ranks must be those of a plain window."""
    df = spark.range(5000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).otherwise("hot").alias("g"),
        (F.hash("id") % 50).cast("double").alias("v"),
        "id",
    )
    got = op.rank_rows(df, ["g"], "v", ["id"], target=100)
    want = op.duration_curve(df, ["g"], "v", ["id"])
    assert rows_of(got, "g", "v", "id", "T") == rows_of(want, "g", "v", "id", "T")


def test_rank_rows_with_null_group(table):
    df = table("g string, v int", (None, 1), (None, 3), ("a", 2))
    got = op.rank_rows(df, ["g"], "v")
    assert rows_of(got, "g", "v", "T") == [("a", 2, 1), (None, 1, 2), (None, 3, 1)]


def same_ranks(df, target, tie=("id",)):
    got = op.rank_rows(df, ["g"], "v", list(tie), target=target)
    want = op.duration_curve(df, ["g"], "v", list(tie))
    cols = ["g", "v", *tie, "T"]
    assert [str(r) for r in rows_of(got, *cols)] == [str(r) for r in rows_of(want, *cols)]


def test_rank_rows_of_any_distribution(spark):
    """Many small groups, all values equal, odd values, a few values far out."""
    many = spark.range(3000, numPartitions=5).select((F.col("id") % 700).alias("g"), (F.hash("id") % 9).alias("v"), "id")
    same_ranks(many, 100)
    same_ranks(many.select(F.lit("a").alias("g"), F.lit(2.5).alias("v"), "id"), 50)
    far = F.when(F.col("id") < 3, F.col("id") * 1e12).otherwise(F.hash("id") % 100 / 1e3)
    same_ranks(many.select(F.lit(None).cast("string").alias("g"), far.alias("v"), "id"), 50)
    odd = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, float("nan")).when(F.col("id") % 7 == 2, float("inf"))
    odd = odd.when(F.col("id") % 7 == 3, float("-inf")).otherwise((F.hash("id") % 5).cast("double"))
    same_ranks(many.select(F.lit(1).alias("g"), odd.alias("v"), "id"), 50)
    same_ranks(many.select(F.lit(1).alias("g"), (F.hash("id") % 2).alias("v"), F.col("id").cast("string").alias("id")), 50)


def test_rank_rows_runs_nothing_while_planning(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    op.rank_rows(spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"], "v", target=10)
    assert set(tracker.getJobIdsForGroup(None)) == before


def raises(df):
    with pytest.raises(Exception, match="several rows for one"):
        df.collect()


def test_reshape_duplicates_raise_or_combine(table):
    twice = table("k string, n string, v double", ("a", "x", 1.0), ("a", "x", 5.0), ("a", "y", None), ("b", "y", 2.0), ("b", "y", None))
    raises(op.pivot_wider(twice, ["k"], "n", "v", ["x", "y"]))
    assert rows_of(op.pivot_wider(twice, ["k"], "n", "v", ["x", "y"], combine="sum")) == [("a", 6.0, None), ("b", None, 2.0)]
    assert rows_of(op.pivot_wider(twice, ["k"], "n", "v", ["x", "y"], fill=0.0, combine="strict_sum")) == [("a", 6.0, None), ("b", 0.0, None)]
    raises(op.contrast(twice, ["k"], "n", "x", "y", "v"))
    assert rows_of(op.contrast(twice, ["k"], "n", "x", "y", "v", fill=0.0, combine="sum"))[1] == ("b", -2.0)
    for f in (
        lambda c: op.densify(twice, ["k"], "n", "v", combine=c),
        lambda c: op.complete_series(twice, ["k"], "n", ["x"], "v", fill=0.0, combine=c),
    ):
        raises(f("only"))
        assert ("a", "x", 6.0) in rows_of(f("sum")) and ("b", "y", 2.0) in rows_of(f("sum"))
        assert ("a", "x", 6.0) in rows_of(f("strict_sum")) and ("b", "y", 0.0) in rows_of(f("strict_sum"))
    raises(op.delta_vs_baseline(twice, ["k"], "n", "v", "x"))
    assert rows_of(op.delta_vs_baseline(twice, ["k"], "n", "v", "x", combine="sum")) == [("a", "y", -6.0), ("b", "y", 2.0)]


def test_reshape_null_keys_are_a_group(table):
    df = table("k string, y int, v double", ("a", None, 1.0), ("a", 2020, 2.0), ("b", 2025, 3.0))
    dense = op.densify(df, ["k"], "y", "v")
    assert ("a", None, 1.0) in rows_of(dense) and ("b", None, 0.0) in rows_of(dense) and dense.count() == 6
    given = op.densify(df, ["k"], "y", "v", domain=[2020])
    assert rows_of(given) == [("a", 2020, 2.0), ("a", None, 1.0), ("b", 2020, 0.0), ("b", 2025, 3.0)]
    series = op.complete_series(df, ["k"], "y", [2020, 2030], "v", fill=0.0)
    assert ("a", None, 1.0) in rows_of(series) and ("b", 2025, 3.0) in rows_of(series) and series.count() == 6
    sc = table("k string, Sc string, value double", ("a", None, 5.0), ("a", "NoPOL", 2.0), ("a", "z", 1.0), (None, None, 4.0))
    want = [("a", "z", -1.0), ("a", None, 3.0), (None, "z", 0.0), (None, None, 4.0)]
    assert rows_of(op.delta_vs_baseline(sc, ["k"])) == want
    kept = op.delta_vs_baseline(sc, ["k"], scenarios=["s"])
    assert ("a", None, 3.0) in rows_of(kept) and ("a", "s", -2.0) in rows_of(kept) and ("a", "z", -1.0) in rows_of(kept)
    inside = op.delta_vs_baseline(sc, ["k"], scenarios=["s"], keep_outside=False)
    assert rows_of(inside) == [("a", "s", -2.0), (None, "s", 0.0)]


def test_country_net_flow_is_strict(table):
    rows = [("s", 2020, "t", "JP-A", "import", 3.0), ("s", 2020, "t", "JP-A", "export", None), ("s", 2020, "t", "KR", "import", 2.0)]
    df = table("Sc string, Sy int, St string, N string, Sv string, value double", *rows)
    got = rows_of(op.country_net_flow(df, F.col("N")), "Sr", "import", "export", "value")
    assert got == [("JP-A", 3.0, None, None), ("KR", 2.0, 0.0, 2.0)]


def test_no_join_of_a_ranking_gathers_a_group(spark, monkeypatch):
    """Rows meet the bounds of a large group, or of a run of one value, in many parts."""
    from scenaria.operators import rank

    real, most = rank.natural_join, []

    def seen(left, right, how, on):
        most.append(left.groupBy(*on).count().agg(F.max("count")).first()[0])
        return real(left, right, how, on=on)

    monkeypatch.setattr(rank, "natural_join", seen)
    df = spark.range(5000).select(F.lit("x").alias("g"), F.when(F.col("id") < 2500, 1.0).otherwise(F.col("id")).alias("v"), "id")
    got = op.rank_rows(df, ["g"], "v", ["id"], target=100)
    want = sorted(((1.0 if k < 2500 else float(k), k) for k in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r.v, r.id) for r in got.orderBy("T").collect()] == want
    assert len(most) == 4 and max(most) <= 150
