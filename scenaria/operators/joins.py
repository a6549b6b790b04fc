"""Joins. No broadcast hints: Spark picks the side by its measured size
(file statistics first, shuffle statistics under adaptive execution)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nullable(df: DataFrame, c: str) -> bool:
    return df.schema[c].nullable


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", on: Sequence[str] | None = None) -> DataFrame:
    """Join on all common columns; NULL keys match NULL keys.

    A plain equality is used for keys that cannot be NULL on both sides, so
    only nullable keys pay for the null-safe comparison.
    """
    keys = list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("natural join without common columns")
    if how not in ("left", "right", "inner", "full"):
        raise ValueError(f"unsupported join type {how!r}")
    both = {k: _nullable(left, k) and _nullable(right, k) for k in keys}
    if not any(both.values()):
        return left.join(right, keys, how)
    l, r = left.alias("l"), right.alias("r")
    lk = {k: F.col(f"l.`{k}`") for k in keys}
    rk = {k: F.col(f"r.`{k}`") for k in keys}
    cond = [lk[k].eqNullSafe(rk[k]) if both[k] else lk[k] == rk[k] for k in keys]
    key_out: dict[str, Column] = {
        k: {"right": rk[k], "full": F.coalesce(lk[k], rk[k])}.get(how, lk[k]) for k in keys
    }
    cols = [key_out[k].alias(k) for k in keys]
    cols += [F.col(f"l.`{c}`").alias(c) for c in left.columns if c not in keys]
    cols += [F.col(f"r.`{c}`").alias(c) for c in right.columns if c not in keys]
    return l.join(r, reduce(lambda a, b: a & b, cond), how).select(*cols)


def semi_join(df: DataFrame, other: DataFrame, on: Mapping[str, str] | str) -> DataFrame:
    """Rows of ``df`` whose key occurs in a column of another table."""
    pairs = {on: on} if isinstance(on, str) else dict(on)
    keys = other.select(*[F.col(r).alias(f"__k{i}") for i, r in enumerate(pairs.values())])
    cond = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"__k{i}") for i, l in enumerate(pairs)])
    return df.join(keys, cond, "left_semi")


def role_join(df: DataFrame, dim: DataFrame, key: str, at: str, suffix: str) -> DataFrame:
    """Attach the dimension under another key name, e.g. the attributes of a
    link's start (``at='N0'``); attribute columns get the suffix."""
    attrs = [c for c in dim.columns if c != key]
    role = dim.select(F.col(key).alias(at), *[F.col(c).alias(f"{c}{suffix}") for c in attrs])
    return natural_join(df, role, "left", on=[at])


def code_join(facts: DataFrame, codes: DataFrame, required: Sequence[str]) -> DataFrame:
    """Map codes to categories and drop rows that lack a required column.

    Stands for a full join followed by a NULL drop. When a required column
    comes from each side (as for a code map and a fact key) the two steps are
    an inner join, and it is planned as one.
    """
    keys = [c for c in facts.columns if c in codes.columns]
    from_facts = any(c in facts.columns and c not in keys for c in required)
    from_codes = any(c in codes.columns and c not in keys for c in required)
    how = {(True, True): "inner", (False, True): "right", (True, False): "left"}.get((from_facts, from_codes), "full")
    return natural_join(facts, codes, how).dropna(subset=list(required))


def shared(df: DataFrame) -> DataFrame:
    """``df`` unchanged, for tables that several branches of one plan read.

    Spark computes an exchange once if the branches ask for the same one. A filter or a choice of columns
    above ``df`` would otherwise be pushed down in one branch alone, which then reads its input again. The
    condition (always true) reads all columns and is not deterministic, so nothing moves below it.
    """
    return df.filter(F.rand(0) < F.lit(2) + F.hash(*df.columns) * F.lit(0.0))


def union_rows(*dfs: DataFrame) -> DataFrame:
    """Stack by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
