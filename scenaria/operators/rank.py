"""Ranking inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.operators.joins import natural_join, shared

BINS = 1024
#: Parts of a group for its joins with bounds.
PARTS = 1024
#: Bin numbers of a row: each cuts what the one before left too large.
BINS_OF = ("__b1", "__b2", "__b3")


def duration_curve(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], out: str = "T") -> DataFrame:
    """Values of each group from high to low with their position.

    For tables that hold one row per group and time slice: the slice domain of
    a year bounds the group. Use :func:`rank_rows` for raw rows.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), *tie)
    return df.withColumn(out, F.row_number().over(w))


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of a number, counted from the high end in the order of a descending sort with NULLs last."""
    share = F.floor((v - lo) / (hi - lo) * BINS)
    return (
        F.when(v.isNull(), BINS + 1)
        .when(F.isnan(v), -2)
        .when(v == float("inf"), -1)
        .when(v == float("-inf"), BINS)
        .when(hi == lo, 0)
        .otherwise(BINS - 1 - F.least(share, F.lit(BINS - 1)))
        .cast("int")
    )


def _bytes_from(x: Column, at: Column) -> Column:
    """Six bytes of a binary from position ``at`` (from 0) as a number, zeros beyond its end."""
    return F.conv(F.rpad(F.hex(F.substring(x, at + 1, F.lit(6))), 12, "0"), 16, 10).cast("double")


class _Coordinate:
    """One column of the order. ``code`` is what is compared: a double, or the bytes of a text."""

    def __init__(self, df: DataFrame, i: int, name: str, descending: bool):
        c, kind = F.col(name), df.schema[name].dataType
        self.name, self.sign = f"__c{i}", 1 if descending else -1
        self.lo, self.hi, self.varies = f"__lo{i}", f"__hi{i}", f"__v{i}"
        self.text = isinstance(kind, (T.StringType, T.BinaryType))
        if self.text:
            self.code = c.cast("binary")
        elif isinstance(kind, T.DateType):
            self.code = F.unix_date(c).cast("double")
        elif isinstance(kind, T.TimestampNTZType):
            self.code = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{name}`)").cast("double")
        elif isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType)):
            self.code = c.cast("double")
        else:  # arrays and structs: ordered within their bin
            self.code = F.lit(None).cast("double")

    def stats(self) -> list[Column]:
        """Exact bounds, and whether rows differ in this column."""
        c, n = F.col(self.name), F.count(F.lit(1))
        known = F.count(c)
        inner = c if self.text else _finite(c)
        some = F.count(inner)
        lo, hi = F.min(inner), F.max(inner)
        varies = (lo < hi) | ((known > 0) & (known < n)) | ((some > 0) & (some < known))
        return [lo.alias(self.lo), hi.alias(self.hi), F.coalesce(varies, F.lit(False)).alias(self.varies)]

    def bin(self) -> Column:
        """Bin of a row between the bounds, in the order of the sort; NULLs are last if it descends, else first."""
        c, lo, hi = F.col(self.name), F.col(self.lo), F.col(self.hi)
        if not self.text:
            return self.sign * _bin(c, F.coalesce(lo, F.lit(0.0)), F.coalesce(hi, F.lit(0.0)))
        # all texts between the bounds share the bytes that the bounds share
        same = F.lit(0) + F.length(F.regexp_extract(F.concat(F.hex(lo), F.lit("|"), F.hex(hi)), r"^((?:..)*)[^|]*\|\1", 1)) / 2
        same = same.cast("int")
        share = F.try_divide(_bytes_from(c, same) - _bytes_from(lo, same), _bytes_from(hi, same) - _bytes_from(lo, same))
        up = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))
        down = F.when(c.isNull(), BINS + 1).otherwise(BINS - 1 - up)
        return (self.sign * down).cast("int")


def cut_rows(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], target: int) -> DataFrame:
    """``df`` with three bin numbers (``BINS_OF``) that follow an order of (column, descending), and ``__large``.

    A group of more than ``target`` rows is cut into equal ranges of the first column of the order in which its rows
    differ, between exact bounds; a bin that still holds more is cut twice more, by its own bounds. A run of equal
    values is thus cut by the next column, and texts by the bytes after those that they share.
    Bounds are exact minima and maxima: they do not depend on the order of rows, so every evaluation gives the same bins.
    The rows are computed once: all bounds, counts and the result read one exchange that deals them out evenly.
    Rows meet the bounds of their group in PARTS parts, by a hash of the order, so that no join gathers a group: there are at
    most three bounds, of PARTS rows each, for ``target`` rows.
    """
    keys = list(keys)
    by = [_Coordinate(df, i, *c) for i, c in enumerate(order)]
    coded = df.withColumns({c.name: c.code for c in by})
    part = F.pmod(F.xxhash64(*[c.name for c in by]), F.lit(PARTS)).cast("int")
    rows = shared(coded.withColumn("__part", part).hint("rebalance"))
    for k, bin_ in enumerate(BINS_OF):
        at = [*keys, *BINS_OF[:k]]
        used = by[:1] if k == 0 and not by[0].text else by  # the first bounds are of all rows: a hash aggregate of numbers
        still = rows if k == 0 else rows.filter(f"__large{k - 1}").drop(*_bounds_of(by))
        stats = still.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"), *[x for c in used for x in c.stats()])
        stats = stats.filter(F.col("__n") > target).withColumn("__n", F.lit(True))
        stats = stats.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = natural_join(rows.drop(*_bounds_of(by)), stats.withColumnRenamed("__n", f"__large{k}"), "left", on=[*at, "__part"])
        cut = F.lit(0)
        for c in reversed(used):
            cut = F.when(F.col(c.varies), c.bin()).otherwise(cut)
        large = F.coalesce(F.col(f"__large{k}"), F.lit(False))
        rows = rows.withColumns({f"__large{k}": large, bin_: F.when(large, cut).otherwise(0)})
    return rows.select(*df.columns, *BINS_OF, F.col("__large0").alias("__large"))


def _bounds_of(by: Sequence[_Coordinate]) -> list[str]:
    return [x for c in by for x in (c.lo, c.hi, c.varies)]


def binned_rows(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], target: int) -> DataFrame:
    """:func:`cut_rows` in the order of a ranking: ``value`` from high to low, then the tie columns."""
    return cut_rows(df, keys, [(value, True), *[(t, False) for t in tie]], target)


def rank_rows(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str] = (), out: str = "T", target: int = 1_000_000) -> DataFrame:
    """Position in each group by ``value`` from high to low (NULLs last), then
    by the tie columns, for groups without a size bound.

    Rows are numbered within bins (see :func:`cut_rows`); what lies in the
    bins before is a running sum over counts. Everything is lazy: nothing is
    run or stored while the plan is built. Groups of up to ``target`` rows are one bin, and only
    the bounds and counts of larger groups are joined. The order should end in
    a distinguishing column: rows equal in all of it stay in one task.
    """
    keys, bins = list(keys), list(BINS_OF)
    rows = binned_rows(df, keys, value, tie, target)
    counts = rows.filter("__large").groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, *bins, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, *bins).orderBy(F.col(value).desc_nulls_last(), *tie)
    numbered = rows.withColumn("__row", F.row_number().over(within))
    ranked = natural_join(numbered, before, "left", on=[*keys, *bins])
    rank = F.col("__row") + F.coalesce(F.col("__before"), F.lit(0))
    return ranked.select(*df.columns, rank.cast("long").alias(out))
