"""Link key parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_link(df: DataFrame, col: str, into: tuple[str, ...] = ("N0", "N1"), sep: str = "_", keep: bool = True) -> DataFrame:
    """Split a key into columns; pieces that do not exist are NULL, pieces
    beyond the last column are dropped."""
    parts = F.split(F.col(col), sep)
    out = df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into)})
    return out if keep or col in into else out.drop(col)
