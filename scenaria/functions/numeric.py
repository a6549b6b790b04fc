"""Arithmetic, aggregates and value relabelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenaria import vocab


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL (a plain ``sum`` skips NULLs)."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_avg(c: Column | str) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """``sum(w*x)/sum(w)``; NULL for a missing input or a zero total weight."""
    x, w = _c(x), _c(w)
    return F.try_divide(strict_sum(w * x), strict_sum(w))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_c(part), _c(whole)) * F.lit(100.0)


def symmetric_limit(c: Column | str) -> Column:
    """Aggregate: the larger magnitude of the two extremes of ``c``."""
    c = _c(c)
    return F.greatest(F.abs(F.max(c)), F.abs(F.min(c)))


def year_bin(year: Column | str, width: int = 5, origin: int = 2001) -> Column:
    """Last year of the half-open bin ``(y-width, y]`` that holds ``year``."""
    steps = F.floor(F.ceil(_c(year) - F.lit(origin)) / F.lit(width))
    return (steps * F.lit(width) + F.lit(origin + width - 1)).cast("int")


def discount_factor(
    year: Column | str,
    base: int = vocab.DISCOUNT_BASE_YEAR,
    rate: float = vocab.DISCOUNT_RATE,
) -> Column:
    return F.pow(F.lit(1.0 - rate), _c(year) - F.lit(base))


def to_number(c: Column | str, dtype: str = "int") -> Column:
    """Text to number; anything unreadable becomes NULL, also under ANSI mode."""
    return _c(c).cast("string").try_cast(dtype)


def scaled(c: Column | str, divisor: float) -> Column:
    return _c(c) / F.lit(float(divisor))


def sign_flip(name: Column | str, value: Column | str, outflows: Sequence[str]) -> Column:
    """Negate ``value`` where ``name`` is one of ``outflows``."""
    return F.when(_c(name).isin(list(outflows)), -_c(value)).otherwise(_c(value))


def carrier_equivalent(
    carrier: Column | str,
    value: Column | str,
    efficiency: Mapping[str, float] | None = None,
) -> Column:
    """Express ``value`` in electricity, dividing by the carrier's conversion efficiency."""
    out = None
    for name, eff in (efficiency or {"H2": vocab.H2_TO_ELECTRICITY}).items():
        hit, val = _c(carrier) == F.lit(name), _c(value) / F.lit(eff)
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out.otherwise(_c(value))


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Relabel values; what the mapping does not name passes through unchanged."""
    c, out = _c(c), None
    by_label: dict[str, list[str]] = {}
    for old, new in mapping.items():
        by_label.setdefault(new, []).append(old)
    for new, olds in by_label.items():
        hit = c.isin(olds)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return c if out is None else out.otherwise(c)


def lookup(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Named lookup: the mapped value, NULL for a name the mapping lacks."""
    c, out = _c(c), None
    by_label: dict[str, list[str]] = {}
    for name, label in mapping.items():
        by_label.setdefault(label, []).append(name)
    for label, found in by_label.items():
        out = F.when(c.isin(found), F.lit(label)) if out is None else out.when(c.isin(found), F.lit(label))
    return F.lit(None).cast("string") if out is None else out
