"""Long/wide reshaping, domain completion and scenario differences.

No operator here pivots on values found in the data and none pairs the rows of
a group with each other. A domain that is given as a list is unrolled as an array. An
observed one (the distinct values of an index column), or one that is a table, stays distributed: its values lie
in a few parts, and every row to be completed goes to each part. Observed domains
are read from the same exchange as the rows (``shared``).

One rule for all of them: NULL keys are an ordinary group, and two rows for one
cell are an error unless the caller says how to combine them. A series is completed by empty
rows, one for each of its steps, that join its own rows before one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.functions import strict_sum
from scenaria.operators.joins import natural_join, shared
from scenaria.sources.inline import sql_literal

Domain = Sequence[Any] | DataFrame | None

#: Parts of a domain that is not a list.
SPREAD = 8


def _lits(values: Sequence[Any]) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def _part(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SPREAD)).cast("int")


def _times(rows: DataFrame, domain: DataFrame, col: str) -> DataFrame:
    """``rows`` once for each different value of the one-column ``domain``, in column ``col``; NULL is a value like any other."""
    values = domain.toDF(col).distinct().withColumn("__b", _part(F.col(col)))
    dealt = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(values, "__b").select(*rows.columns, col)


# long <-> wide ---------------------------------------------------------------


def _one_cell(hits: int | Column, value: Column, what: str) -> Column:
    """``value``, or an error if the cell has several rows."""
    return F.when(hits > 1, F.raise_error(F.lit(f"several rows for one {what}; say how to combine them"))).otherwise(value)


def pivot_wider(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    columns: Sequence[Any] | Mapping[Any, str],
    fill: Any = None,
    combine: str = "only",
) -> DataFrame:
    """One column per listed name. One grouped pass; ``fill`` is for absent
    pairs only, a stored NULL stays NULL.

    ``combine`` is for several rows of one cell: ``only`` raises, ``sum`` adds
    what is there, ``strict_sum`` gives NULL as soon as one is NULL.
    """
    aliases = dict(columns) if isinstance(columns, Mapping) else {c: str(c) for c in columns}
    aggs = []
    for name, alias in aliases.items():
        hit = F.col(names).eqNullSafe(F.lit(name))
        rows, cells = F.count(F.when(hit, F.lit(1))), F.when(hit, F.col(values))
        cell = {
            "only": lambda: _one_cell(rows, F.max(cells), f"{names} = {name}"),  # noqa: B023
            "sum": lambda: F.sum(cells),  # noqa: B023
            "strict_sum": lambda: F.when(rows == F.count(cells), F.sum(cells)),  # noqa: B023
        }[combine]()
        if fill is not None:
            cell = F.when(rows == 0, F.lit(fill)).otherwise(cell)
        aggs.append(cell.alias(alias))
    return df.groupBy(*ids).agg(*aggs)


def pivot_longer(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str] | None = None,
    names_to: str = "name",
    values_to: str = "value",
    names_type: str | None = None,
) -> DataFrame:
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    out = df.unpivot(list(ids), cols, names_to, values_to)
    return out.withColumn(names_to, F.col(names_to).cast(names_type)) if names_type else out


# completion ------------------------------------------------------------------


def _packed(df: DataFrame, ids: Sequence[str], key: Column, value: str) -> DataFrame:
    """The cells of each id as an array ``__m`` of (k, v)."""
    return df.groupBy(*ids).agg(F.collect_list(F.struct(key.alias("k"), F.col(value).alias("v"))).alias("__m"))


def _cell(key: Column, what: str, combine: str) -> Column:
    """The value of the cell ``key`` of ``__m``, NULL if there is none; NULL is a key like any other."""
    hits = F.filter("__m", lambda c: c["k"].eqNullSafe(key))
    first = F.get(hits, F.lit(0))["v"]
    if combine == "only":
        return _one_cell(F.size(hits), first, what)
    each = {"sum": lambda v: F.coalesce(v, F.lit(0)), "strict_sum": lambda v: v}[combine]
    rest = F.slice(hits, F.lit(2), F.greatest(F.size(hits) - 1, F.lit(0)))
    return F.when(F.size(hits) > 0, F.aggregate(rest, each(first), lambda a, c: a + each(c["v"])))


def _with_empty(df: DataFrame, ids: Sequence[str], along: Sequence[str], grid: DataFrame, value: str, fill: Any, keep_outside: bool, combine: str) -> DataFrame:
    """The cells of ``df`` and the empty cells of ``grid`` (ids, along) as one table with one row a cell.

    All cells of an id meet in one exchange, which operators along the series then reuse.
    """
    what, has = ", ".join(along), F.col("__n") == 1
    rows = df.select(*ids, *along, F.col(value).alias("__v"), F.lit(1).alias("__n"))
    empty = grid.select(*ids, *along, F.lit(None).cast(df.schema[value].dataType).alias("__v"), F.lit(0).alias("__n"))
    both = rows.unionByName(empty)
    both = both.repartition(*ids) if ids else both
    n, v = F.sum("__n"), F.col("__v")
    cell = {
        "only": lambda: _one_cell(n, F.max(v), what),
        "sum": lambda: F.when(n > 0, F.coalesce(F.sum(v), F.lit(0))),
        "strict_sum": lambda: F.when(n == F.count(v), F.sum(v)),
    }[combine]()
    cell = cell if fill is None else F.coalesce(cell, F.lit(fill))
    out = both.groupBy(*ids, *along).agg(cell.alias(value), F.count(F.when(~has, F.lit(1))).alias("__asked"))
    return (out if keep_outside else out.filter("__asked > 0")).select(*ids, *along, value)


def densify(
    df: DataFrame,
    ids: Sequence[str],
    along: str,
    value: str = "value",
    fill: Any = 0.0,
    domain: Domain = None,
    keep_outside: bool = True,
    combine: str = "only",
) -> DataFrame:
    """Every id combination gets every value of ``along``, absent ones filled.

    Give ``domain`` as a list when the bins are known to save the join with them; rows outside of it stay
    unless ``keep_outside`` is off. ``fill`` also replaces values that are NULL already.
    """
    df, kind = shared(df), df.schema[along].dataType
    series = df.select(*ids).distinct()
    if domain is None or isinstance(domain, DataFrame):
        values = df.select(along) if domain is None else domain.toDF(along).select(F.col(along).cast(kind))
        grid = _times(series, values, along)
    else:
        grid = series.withColumn(along, F.explode(_lits(domain).cast(f"array<{kind.simpleString()}>")))
    return _with_empty(df, ids, [along], grid, value, fill, keep_outside, combine)


def complete_series(
    df: DataFrame,
    group: Sequence[str],
    along: str | Sequence[str],
    domain: Sequence[Any] | Column,
    value: str = "value",
    fill: Any = None,
    keep_outside: bool = True,
    combine: str = "only",
) -> DataFrame:
    """Supply a fixed domain within each group.

    ``along`` is one column, or several with a domain of tuples. ``fill`` also
    replaces values that are NULL already. Rows of the group outside the domain
    are kept unless ``keep_outside`` is off.
    """
    df = shared(df)
    if isinstance(along, str):
        steps = (domain if isinstance(domain, Column) else _lits(domain)).cast(f"array<{df.schema[along].dataType.simpleString()}>")
        along, back = [along], [F.col("__k").alias(along)]
    else:
        typed = [[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(along, step)] for step in domain]
        steps, back = F.array(*[F.struct(*step) for step in typed]), [F.col(f"__k.{c}").alias(c) for c in along]
    grid = df.select(*group).distinct().withColumn("__k", F.explode(steps)).select(*group, *back)
    return _with_empty(df, group, along, grid, value, fill, keep_outside, combine)


def _grid(df: DataFrame, keys: Sequence[str], domains: Mapping[str, Domain]) -> DataFrame:
    """The product of the key domains; ``df`` is a table whose branches share an exchange.

    The rows of the last key's domain (normally the time slices) come first; each further key
    unrolls its values onto them.
    """

    def distinct(k: str) -> DataFrame | None:
        domain = domains.get(k)
        if domain is None:
            return df.select(k).distinct()
        return domain.toDF(k).distinct() if isinstance(domain, DataFrame) else None

    last = keys[-1]
    grid = distinct(last)
    if grid is None:
        grid = df.sparkSession.range(1).select(F.explode(_lits(domains[last])).alias(last)).repartition(last)
    for k in keys[:-1]:
        values = distinct(k)
        grid = grid.select("*", F.explode(_lits(domains[k])).alias(k)) if values is None else _times(grid, values, k)
    return grid


def complete(
    df: DataFrame,
    keys: Sequence[str],
    fill: Mapping[str, Any] | None = None,
    domains: Mapping[str, Domain] | None = None,
) -> DataFrame:
    """Every combination of the key domains, plus all rows already present.

    Domains default to the observed values. Existing rows outside a given
    domain are kept, and ``fill`` applies to values that were NULL before, too.
    """
    df = shared(df)
    grid = _grid(df, keys, domains or {})
    out = natural_join(grid, df, "full", on=list(keys))
    cols = [F.coalesce(F.col(c), F.lit((fill or {})[c])).alias(c) if c in (fill or {}) else F.col(c) for c in df.columns]
    return out.select(*cols)


def complete_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    domains: Mapping[str, Domain] | None = None,
) -> DataFrame:
    """Grouped sum over the completed key product, absent and NULL cells zero.

    The grid joins in as zero rows before the sum, so completion costs no
    join: facts and grid share the one shuffle of the aggregation.
    """
    # The domains need all rows, the facts only those that a view keeps: filters stop here, so that
    # both read the same exchange.
    facts = shared(df.groupBy(*keys).agg(strict_sum(value).alias(value)))
    grid = _grid(facts, keys, domains or {}).select(*keys, F.lit(0.0).alias(value))
    return facts.unionByName(grid).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


# differences -----------------------------------------------------------------


def delta_vs_baseline(
    df: DataFrame,
    keys: Sequence[str],
    scenario: str = "Sc",
    value: str = "value",
    baseline: str = "NoPOL",
    scenarios: Sequence[str] | None = None,
    drop_baseline: bool = True,
    keep_outside: bool = True,
    combine: str = "only",
) -> DataFrame:
    """Every scenario minus the baseline, absent cells zero.

    ``scenarios`` is the scenario domain (observed by default); scenarios
    outside of it stay unless ``keep_outside`` is off. The scenarios of one key
    travel as a small array, as in :func:`densify`.
    """
    df = shared(df)
    packed, own = _packed(df, keys, F.col(scenario), value), F.transform("__m", lambda c: c["k"])
    if scenarios is None:
        rows = _times(packed, df.select(scenario), scenario)
    else:
        steps = _lits(scenarios).cast(f"array<{df.schema[scenario].dataType.simpleString()}>")
        rows = packed.withColumn(scenario, F.explode(F.array_union(steps, own) if keep_outside else steps))
    if drop_baseline:
        rows = rows.filter(~F.col(scenario).eqNullSafe(F.lit(baseline)))
    cell = F.coalesce(_cell(F.col(scenario), scenario, combine), F.lit(0.0))
    base = F.coalesce(_cell(F.lit(baseline), scenario, combine), F.lit(0.0))
    return rows.select(*keys, scenario, (cell - base).alias(value))


def contrast(
    df: DataFrame,
    keys: Sequence[str],
    names: str,
    plus: str,
    minus: str,
    value: str = "value",
    fill: float | None = None,
    combine: str = "only",
) -> DataFrame:
    """``plus`` minus ``minus`` per key. With ``fill`` an absent side takes
    that value; without it the difference is NULL. ``combine``: as in
    :func:`pivot_wider`."""
    wide = pivot_wider(df, keys, names, value, {plus: "__a", minus: "__b"}, fill, combine)
    return wide.select(*keys, (F.col("__a") - F.col("__b")).alias(value))
