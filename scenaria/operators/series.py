"""Operators along an ordered key inside a group.

The rows of one group normally are one value per step of a calendar domain (years
of a horizon, slices of a year), after aggregation to that key. That domain
bounds the group, so a window per group is safe. For groups without such a bound
the fills take ``target``: groups of more rows are cut along the order, each
piece is filled on its own, and what a piece lacks comes from a scan over one row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria.functions import percent_of, strict_sum
from scenaria.operators.joins import natural_join, shared
from scenaria.operators.rank import BINS_OF, cut_rows


def share_of_total(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "share") -> DataFrame:
    """Percent of the group's total; NULL if any member is NULL or the total is zero.

    The total is a grouped sum with map-side combine, joined back: no task holds a whole group, and a hot one
    is left to adaptive skew splitting.
    """
    rows = shared(df)
    total = rows.groupBy(*keys).agg(strict_sum(value).alias("__total"))
    return natural_join(rows, total, "left", on=list(keys)).select(*df.columns, percent_of(F.col(value), F.col("__total")).alias(out))


def _pieces(df: DataFrame, keys: Sequence[str], order: str, target: int) -> DataFrame:
    """``df`` with ``__p``: the piece of its group along ``order``, pieces of small groups being whole groups."""
    return cut_rows(df, keys, [(order, False)], target).select(*df.columns, F.struct(*BINS_OF).alias("__p"))


def carry_backward(df: DataFrame, keys: Sequence[str], order: str, value: str = "value", target: int | None = None) -> DataFrame:
    """Fill a gap with the next known value; a gap at the end takes the last one.

    ``target``: rows of a group that one task may hold; None for groups that a calendar bounds.
    """
    c = F.col(value)
    rows = df if target is None else shared(_pieces(df, keys, order, target))
    piece = list(keys) if target is None else [*keys, "__p"]
    w = Window.partitionBy(*piece).orderBy(order)
    ahead = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if target is None:
        return rows.withColumn(value, F.coalesce(ahead, behind))
    known = F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("v")))
    ends = rows.groupBy(*piece).agg(F.min(known).alias("__first"), F.max(known).alias("__last"))
    scan = Window.partitionBy(*keys).orderBy("__p")
    after = F.first("__first", ignorenulls=True).over(scan.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("__last", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1))
    around = ends.select(*piece, after["v"].alias("__after"), before["v"].alias("__before"))
    found = natural_join(rows.withColumns({"__next": ahead, "__own": behind}), around, "left", on=piece)
    best = F.coalesce("__next", "__after", "__own", "__before")
    return found.select(*[best.alias(x) if x == value else F.col(x) for x in df.columns])


def interpolate(df: DataFrame, keys: Sequence[str], order: str, value: str = "value", target: int | None = None) -> DataFrame:
    """Linear interpolation over the row position in the group; gaps at either
    end take the nearest known value. ``target``: as in :func:`carry_backward`."""
    c, i = F.col(value), F.col("__i")
    if target is None:
        w = Window.partitionBy(*keys).orderBy(order)
        at = df.withColumn("__i", F.row_number().over(w))
    else:
        w = Window.partitionBy(*keys, "__p").orderBy(order)
        at = shared(_pieces(df, keys, order, target).withColumn("__i", F.row_number().over(w)))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fore = w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(c.isNotNull(), F.struct(i.alias("i"), c.alias("v")))
    near = at.withColumns(
        {
            "__l": F.last(known, ignorenulls=True).over(back),
            "__n": F.first(known, ignorenulls=True).over(fore),
        }
    )
    if target is not None:
        near = _from_other_pieces(near, at, keys, known)
    p, n = F.col("__l"), F.col("__n")
    slope: Column = F.try_divide(n["v"] - p["v"], n["i"] - p["i"])
    line = p["v"] + slope * (i - p["i"])
    filled = F.when(c.isNotNull(), c).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line)
    return near.select(*[filled.alias(x) if x == value else F.col(x) for x in df.columns])


def _from_other_pieces(near: DataFrame, at: DataFrame, keys: Sequence[str], known: Column) -> DataFrame:
    """Positions counted over the whole group, and the known values of the pieces around where a piece has none."""
    piece = at.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__rows"), F.min(known).alias("__first"), F.max(known).alias("__last"))
    scan = Window.partitionBy(*keys).orderBy("__p")
    earlier = scan.rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("__off", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))

    def moved(x: Column, by: Column) -> Column:
        return F.when(x.isNotNull(), F.struct((x["i"] + by).alias("i"), x["v"].alias("v")))

    off = F.col("__off")
    piece = piece.withColumns({"__first": moved(F.col("__first"), off), "__last": moved(F.col("__last"), off)})
    after = F.first("__first", ignorenulls=True).over(scan.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("__last", ignorenulls=True).over(earlier)
    around = piece.select(*keys, "__p", "__off", before.alias("__before"), after.alias("__after"))
    found = natural_join(near, around, "left", on=[*keys, "__p"])
    return found.withColumns(
        {"__l": F.coalesce(moved(F.col("__l"), off), "__before"), "__n": F.coalesce(moved(F.col("__n"), off), "__after"), "__i": F.col("__i") + off}
    )
