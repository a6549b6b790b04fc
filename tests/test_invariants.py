"""Properties that hold for any table; checked on random small ones."""

import random

import pytest
from pyspark.sql import functions as F

from scenaria import operators as op

from conftest import rows_of

SEEDS = [1, 2, 3]


def random_rows(seed, n=60):
    r = random.Random(seed)
    return [
        (r.choice("ab"), r.choice(["x", "y", None]), r.choice([2020, 2025, 2030, 2035]), float(r.randint(-9, 9)))
        for _ in range(n)
    ]


@pytest.fixture(params=SEEDS)
def df(request, spark):
    return spark.createDataFrame(random_rows(request.param), "Sc string, Sv string, YEAR int, value double")


def test_shares_sum_to_hundred(df):
    pos = op.grouped_sum(df.withColumn("value", F.abs("value") + 1), ["Sc", "Sv"])
    total = op.share_of_total(pos, ["Sc"]).groupBy("Sc").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(100.0) for r in total.collect())


def test_completion_has_product_size_and_keeps_the_sum(df):
    facts = op.grouped_sum(df, ["Sc", "Sv", "YEAR"])
    dense = op.complete_sum(df, ["Sc", "Sv", "YEAR"])
    sizes = [len({r[i] for r in facts.select("Sc", "Sv", "YEAR").collect()}) for i in range(3)]
    assert dense.count() == sizes[0] * sizes[1] * sizes[2]
    assert dense.agg(F.sum("value")).first()[0] == facts.agg(F.sum("value")).first()[0]
    assert rows_of(dense) == rows_of(op.complete(facts, ["Sc", "Sv", "YEAR"], {"value": 0.0}))


def test_densify_is_idempotent(df):
    once = op.densify(op.grouped_mean(df, ["Sc", "Sv", "YEAR"]), ["Sc", "Sv"], "YEAR")
    assert rows_of(op.densify(once, ["Sc", "Sv"], "YEAR")) == rows_of(once)


def test_backward_fill_leaves_no_gap(df):
    grid = op.complete_series(op.grouped_sum(df, ["Sc", "Sv", "YEAR"]), ["Sc", "Sv"], "YEAR", list(range(2020, 2036)))
    assert op.carry_backward(grid, ["Sc", "Sv"], "YEAR").filter("value IS NULL").count() == 0


def test_interpolation_keeps_known_values(df):
    known = op.grouped_sum(df, ["Sc", "Sv", "YEAR"])
    grid = op.complete_series(known, ["Sc", "Sv"], "YEAR", list(range(2020, 2036)))
    filled = op.interpolate(grid, ["Sc", "Sv"], "YEAR")
    assert op.natural_join(known, filled, on=["Sc", "Sv", "YEAR"]).count() == known.count()
    kept = {r[:3]: r[3] for r in rows_of(filled)}
    assert all(kept[r[:3]] == r[3] for r in rows_of(known))


def test_half_allocation_conserves_totals(df):
    links = df.withColumns({"N0": F.col("Sc"), "N1": F.coalesce("Sv", F.lit("z"))})
    out = op.allocate_to_ends(links, F.col("N0") != F.col("N1"), ["YEAR"])
    assert out.agg(F.sum("value")).first()[0] == df.agg(F.sum("value")).first()[0]


def test_total_row_is_the_sum_of_members(df):
    out = op.with_totals(df, ["Sc"], "Sv", label="all")
    for r in out.filter("Sv = 'all'").collect():
        members = out.filter((F.col("Sc") == r.Sc) & ~F.col("Sv").eqNullSafe("all"))
        assert members.agg(F.sum("value")).first()[0] == r.value


def test_curve_never_rises(df):
    got = rows_of(op.duration_curve(df.withColumn("St", F.concat_ws("-", "Sv", "YEAR")), ["Sc"], "value", ["St"]), "Sc", "T", "value")
    for (s0, t0, v0), (s1, t1, v1) in zip(got, got[1:]):
        assert s0 != s1 or (t1 == t0 + 1 and v1 <= v0)


def test_baseline_difference_is_zero(df):
    total = op.grouped_sum(df, ["Sv", "YEAR", "Sc"])
    out = op.delta_vs_baseline(total, ["Sv", "YEAR"], baseline="a", drop_baseline=False)
    assert out.filter("Sc = 'a' AND value <> 0").count() == 0


def test_orientation_preserves_magnitude(df):
    flows = df.select(F.lit("n").alias("N0"), F.lit("m").alias("N1"), "value")
    moved = op.reorient(flows)
    want = df.filter("value <> 0").agg(F.sum(F.abs("value"))).first()[0]
    assert moved.agg(F.sum("value")).first()[0] == want and moved.filter("value < 0").count() == 0
