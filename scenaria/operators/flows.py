"""Directed flows on links: orientation, node balances and net trade.

A flow row is (N0, N1, L, slice, value): ``value`` was sent from N0 to N1 over
link L. The link id names its own direction; flows against it count negative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import capture, strict_sum
from scenaria.operators.columns import swap


def link_signed_flow(
    flows: DataFrame,
    keys: Sequence[str] = ("Sc", "Sy", "St"),
    value: str = "value",
    link: str = "L",
    origin_pattern: str = vocab.LINK_ORIGIN,
) -> DataFrame:
    """One row per directed pair and slice, oriented along the link.

    The table is read once: a row along its link gets sign +1, against it -1,
    and a row touching the link's origin with neither end is dropped. After
    the sum, negative rows are turned to the link's direction and stay
    negative; zero rows are dropped.
    """
    origin = capture(link, origin_pattern)
    sign = (F.col("N0") == origin).cast("int") - (F.col("N1") == origin).cast("int")
    rows = (
        flows.withColumn("__o", origin)
        .filter((F.col("N0") == F.col("__o")) | (F.col("N1") == F.col("__o")))
        .select(*keys, "N0", "N1", (F.col(value) * sign).alias("value"))
    )
    total = rows.groupBy(*keys, "N0", "N1").agg(strict_sum("value").alias("value"))
    return reorient(total, negate=False)


def reorient(
    df: DataFrame,
    value: str = "value",
    pairs: Sequence[tuple[str, str]] = (("N0", "N1"),),
    negate: bool = True,
) -> DataFrame:
    """Exchange the ends (and any paired attributes) of negative rows; drop
    zero rows. ``negate`` makes the exchanged rows positive."""
    moved = swap(df.filter(F.col(value) != 0), *pairs, where=F.col(value) < 0)
    return moved.withColumn(value, F.abs(value)) if negate else moved


def directed_flow(link_signed: DataFrame) -> DataFrame:
    """Positive flow in its actual direction."""
    return reorient(link_signed, negate=True)


def node_trade(
    directed: DataFrame,
    received: DataFrame | None = None,
    keys: Sequence[str] = ("Sc", "Sy", "St"),
) -> DataFrame:
    """Export by origin and import by destination per slice.

    With one table each row is expanded to its two ends before a single
    grouped sum. ``received`` supplies the import side separately (what arrives
    after losses); by default the sent amount is used on both sides.
    """
    def end(node: str, kind: str) -> Column:
        return F.struct(F.col(node).alias("N"), F.lit(kind).alias("Sv"))

    if received is None:
        rows = directed.select(*keys, "value", F.explode(F.array(end("N0", "export"), end("N1", "import"))).alias("e"))
    else:
        out = directed.select(*keys, "value", end("N0", "export").alias("e"))
        rows = out.unionByName(received.select(*keys, "value", end("N1", "import").alias("e")))
    return rows.groupBy(*keys, F.col("e.N").alias("N"), F.col("e.Sv").alias("Sv")).agg(strict_sum("value").alias("value"))


def country_net_flow(trade: DataFrame, country: Column, keys: Sequence[str] = ("Sc", "Sy", "St")) -> DataFrame:
    """Import, export and their difference per country and slice; a side
    without rows counts as zero, one with a NULL flow is NULL."""

    def side(kind: str) -> Column:
        own = F.col("Sv") == kind
        rows, value = F.count(F.when(own, F.lit(1))), F.when(own, F.col("value"))
        return F.when(rows == 0, 0.0).when(rows == F.count(value), F.sum(value))

    return (
        trade.groupBy(*keys, country.alias("Sr"))
        .agg(
            side("import").alias("import"),
            side("export").alias("export"),
        )
        .withColumn("value", F.col("import") - F.col("export"))
    )


def import_export(net: DataFrame, keys: Sequence[str] = ("Sc", "Sr")) -> DataFrame:
    """Sum of the importing slices and of the exporting slices (negative).
    Netting happens per slice, before this sum."""
    kind = F.when(F.col("value") > 0, F.lit("import")).when(F.col("value") < 0, F.lit("export"))
    rows = net.select(*keys, kind.alias("Sv"), "value").filter(F.col("Sv").isNotNull())
    return rows.groupBy(*keys, "Sv").agg(strict_sum("value").alias("value"))
