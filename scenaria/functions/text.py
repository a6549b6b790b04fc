"""Pattern tests and node/link key parsing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions.numeric import _c

_PLAIN = re.compile(r"^[\w\-/ ]+$")


def detect(c: Column | str, pattern: str) -> Column:
    """Unanchored regex test. Plain text skips the regex engine (and can be
    pushed to the scan as a ``contains`` filter)."""
    return _c(c).contains(pattern) if _PLAIN.match(pattern) else _c(c).rlike(pattern)


def capture(c: Column | str, pattern: str, group: int = 1) -> Column:
    """One capture group; NULL where the pattern does not match."""
    c = _c(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def sub(c: Column | str, start: int = 1, end: int | None = None) -> Column:
    """Characters ``start``..``end``, both 1-based and inclusive."""
    c = _c(c)
    return F.substring(c, start, 2**31 - 1 - start if end is None else end - start + 1)


def first_match(c: Column | str, rules: Sequence[tuple[str, str]], exact: bool = False) -> Column:
    """Label of the first rule whose pattern is found in ``c``; NULL without a match."""
    out = None
    for pattern, label in rules:
        hit = _c(c) == F.lit(pattern) if exact else detect(c, pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def class_of_ends(n0: Column | str, n1: Column | str, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Label of the first rule whose two patterns are found in the two link ends."""
    out = None
    for p0, p1, label in rules:
        hit = detect(n0, p0) & detect(n1, p1)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def strip_bus(c: Column | str, pattern: str = vocab.BUS_SUFFIX) -> Column:
    return F.regexp_replace(_c(c), pattern, "")


def link_label(c: Column | str, strip: str = "-AC", joiner: str = " / ") -> Column:
    """``JP-HD-AC_JP-TH-AC`` to ``JP-HD / JP-TH``."""
    return F.replace(F.replace(_c(c), F.lit(strip), F.lit("")), F.lit("_"), F.lit(joiner))


def same_prefix(a: Column | str, b: Column | str, n: int = 2) -> Column:
    return F.substring(_c(a), 1, n) == F.substring(_c(b), 1, n)


def link_scope(label: Column | str, marker: str = "domestic", marked: str = "domestic", other: str = "international") -> Column:
    """Two-way flag from a marker in the label; NULL labels stay NULL."""
    label = _c(label)
    return F.when(detect(label, marker), F.lit(marked)).when(~detect(label, marker), F.lit(other))


def same_site(n0: Column | str, n1: Column | str, pattern: str) -> Column:
    """The site both ends belong to, e.g. ``JP-HD`` for ``JP-HD-AC`` and ``JP-HD-DC``."""
    a, b = capture(n0, pattern), capture(n1, pattern)
    return F.when(a == b, a)
