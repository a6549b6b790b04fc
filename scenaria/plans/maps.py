"""Data behind the node map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import detect, sign_flip
from scenaria.operators import collapse, grouped_sum, natural_join
from scenaria.plans.mix import without_losses


def adjusted_centroids(nodes: DataFrame, moves: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Shift the label point of single nodes."""
    x, y = F.col("centroid_x"), F.col("centroid_y")
    for node, (dx, dy) in moves.items():
        hit = F.col("Sr") == node
        x = F.when(hit, F.col("centroid_x") + dx).otherwise(x)
        y = F.when(hit, F.col("centroid_y") + dy).otherwise(y)
    return nodes.withColumns({"centroid_x": x, "centroid_y": y})


def node_mix(mix: DataFrame, nodes: DataFrame, year: int, scenarios: Sequence[str], node_pattern: str = "JP-") -> DataFrame:
    """Collapsed mix per node with its map attributes."""
    rows = without_losses(mix).filter(
        (F.col("Y5") == year) & detect("Sr", node_pattern) & F.col("Sc").isin(list(scenarios))
    )
    rows = rows.withColumn("value", sign_flip("Sv", "value", vocab.ANNUAL_OUTFLOWS))
    label = (
        F.when(detect("Sv", "Sec_Ene_Ele_Fos"), "Sec_Ene_Ele_Fos")
        .when(detect("Sv", "Sec_Ene_Ele_Bio"), "Sec_Ene_Ele_Bio")
        .otherwise(F.col("Sv"))
    )
    coarse = collapse(rows, "Sv", label, ["Sc", "Sv", "Sr", "Y5", "cat1", "cat2"])
    return natural_join(coarse, nodes.select("Sr", "centroid_x", "centroid_y"), on=["Sr"])


def node_slice(mix: DataFrame, node: str, scenario: str) -> DataFrame:
    """The rows of one pie."""
    return mix.filter((F.col("Sr") == node) & (F.col("Sc") == scenario))


def symbol_boxes(mix: DataFrame, nodes: DataFrame, divisor: float = vocab.SYMBOL_DIVISOR, minus: float = vocab.SYMBOL_SHIFT) -> DataFrame:
    """Total per node and the box its symbol covers around the centroid."""
    total = grouped_sum(mix, ["Sc", "Sr"])
    half = F.col("value") / F.lit(float(divisor)) - F.lit(minus)
    at = natural_join(total, nodes.select("Sr", "centroid_x", "centroid_y"), on=["Sr"]).withColumn("half", half)
    return at.select(
        "Sc",
        "Sr",
        "value",
        (F.col("centroid_x") - F.col("half")).alias("xmin"),
        (F.col("centroid_x") + F.col("half")).alias("xmax"),
        (F.col("centroid_y") - F.col("half")).alias("ymin"),
        (F.col("centroid_y") + F.col("half")).alias("ymax"),
    )
