"""Cross-border flows, net trade and corridor use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import (
    carrier_equivalent,
    class_of_ends,
    detect,
    first_match,
    percent_of,
    recode,
    scaled,
    slice_hour,
    strict_sum,
    timestamp_of_hour,
)
from scenaria.operators import (
    complete_sum,
    country_net_flow,
    directed_flow,
    extents,
    grouped_sum,
    import_export,
    link_signed_flow,
    natural_join,
    node_trade,
    pivot_wider,
    reorient,
    role_join,
    with_scenario_category,
)


def country_of(node: str = "N") -> Column:
    return first_match(node, vocab.COUNTRY_OF_NODE)


def flow_of_links(flows: DataFrame, year: int, links: Sequence[str] | Column, value: str = "value") -> DataFrame:
    """Link-oriented flow of chosen links in one year, from a single scan."""
    chosen = links if isinstance(links, Column) else F.col("L").isin(list(links))
    rows = flows.filter((F.col("YEAR") == year) & chosen)
    rows = rows.select("Sc", "N0", "N1", "L", F.col("T").alias("St"), F.col("YEAR").alias("Sy"), F.col(value).alias("value"))
    return link_signed_flow(rows)


def trade_by_node(link_signed: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """Export and import per node and slice."""
    return node_trade(directed_flow(link_signed), None if received is None else directed_flow(received))


def net_flow_by_country(trade: DataFrame) -> DataFrame:
    return country_net_flow(trade, country_of("N"))


def yearly_trade(link_signed: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """Yearly import and export per country, netted per slice."""
    return import_export(net_flow_by_country(trade_by_node(link_signed, received)))


def net_balance(yearly: DataFrame) -> DataFrame:
    """Import plus (negative) export; NULL for a country that never does one of the two."""
    wide = pivot_wider(yearly, ["Sc", "Sr"], "Sv", "value", {"export": "e", "import": "i"})
    return wide.select("Sc", "Sr", (F.col("e") + F.col("i")).alias("value"))


def import_export_pairs(yearly: DataFrame, country_names: Mapping[str, str] | None = None) -> DataFrame:
    wide = pivot_wider(yearly, ["Sc", "Sr"], "Sv", "value", ["export", "import"])
    return wide.withColumns({"export": -F.col("export"), "Sr": recode("Sr", country_names or {})})


def electricity_demand(demand: DataFrame, carriers: Sequence[str] = ("AC2", "H2")) -> DataFrame:
    """Demand per country, hydrogen as the electricity it takes."""
    rows = demand.filter(F.col("I").isin(list(carriers)))
    return (
        rows.select("Sc", country_of("N").alias("Sr"), carrier_equivalent("I", "value").alias("dmd"))
        .groupBy("Sc", "Sr")
        .agg(strict_sum("dmd").alias("dmd"))
    )


def trade_vs_demand(yearly: DataFrame, demand: DataFrame) -> DataFrame:
    """Trade as a percentage of demand; volumes in TWh."""
    joined = natural_join(yearly, demand)
    return joined.withColumns(
        {"rate": percent_of("value", "dmd"), "value": scaled("value", 1e6), "dmd": scaled("dmd", 1e6)}
    )


def corridor_heat(link_signed: DataFrame, year: int, slices: Sequence[str] | DataFrame | None = None, shift: int = 8, date_shift: int = 9) -> DataFrame:
    """Corridor flow on the full slice grid with its date and hour of day.

    The hours are zone-free: ``shift`` moves the timestamp, ``date_shift`` is
    added on top for the date.
    """
    rows = link_signed.withColumn("Sv", class_of_ends("N0", "N1", vocab.FLOW_CORRIDORS))
    dense = complete_sum(rows, ["Sc", "Sv", "St"], domains={"St": slices})
    stamp = timestamp_of_hour(slice_hour("St"), year, shift)
    return dense.withColumns(
        {
            "T": stamp,
            "D": F.to_date(F.timestamp_add("HOUR", F.lit(date_shift), stamp)),
            "H": F.hour(stamp),
        }
    )


def utilisation(heat: DataFrame, corridors: DataFrame, year: int) -> DataFrame:
    """Flow as a percentage of the corridor's capacity in the same scenario."""
    cap = corridors.filter(~detect("Sv", "domestic") & (F.col("Y5") == year))
    joined = natural_join(heat, cap.select("Sc", "Sv", F.col("value").alias("vfs")), on=["Sc", "Sv"])
    return joined.withColumn("value", percent_of("value", "vfs"))


def corridor_use(heat: DataFrame) -> DataFrame:
    """Mean magnitude and total of the corridor flow."""
    return heat.groupBy("Sc", "Sv").agg(F.avg(F.abs("value")).alias("mean_abs"), F.sum("value").alias("total"))


def corridor_range(heat: DataFrame, corridor: str) -> DataFrame:
    """Symmetric colour range of one corridor, all terms in GW."""
    rows = heat.filter(F.col("Sv") == corridor).withColumn("value", scaled("value", 1000))
    return extents(rows, ["Sc", "Sv"])


def annual_link_flow(
    flows: DataFrame,
    year: int,
    nodes: DataFrame,
    scenarios: DataFrame,
    node_pattern: str = "JP-",
) -> DataFrame:
    """Yearly flow on the AC links inside a country, with end coordinates and
    scenario categories. Ends are oriented along the link."""
    inside = detect("N0", node_pattern) & detect("N1", node_pattern) & detect("L", vocab.AC_LINK)
    rows = flows.filter((F.col("YEAR") == year) & inside).withColumnRenamed("YEAR", "Sy")
    yearly = link_signed_flow(rows, keys=["Sc", "Sy"])
    points = nodes.select("Sr", "centroid_x", "centroid_y")
    located = role_join(role_join(yearly, points, "Sr", "N0", "0"), points, "Sr", "N1", "1")
    return with_scenario_category(located, scenarios)


def annual_flow_arrows(link_flow: DataFrame) -> DataFrame:
    """Net flow per oriented pair; a negative net turns the arrow and both
    coordinates, and keeps its sign."""
    keys = ["Sc", "N0", "N1", "centroid_x0", "centroid_y0", "centroid_x1", "centroid_y1"]
    total = grouped_sum(link_flow, keys)
    pairs = [("N0", "N1"), ("centroid_x0", "centroid_x1"), ("centroid_y0", "centroid_y1")]
    return reorient(total, pairs=pairs, negate=False)


def node_energy_balance(panel: DataFrame, nodes: DataFrame, scenarios: DataFrame, year: int, node_pattern: str = "JP-", variable: str = "Trd_Sec_Ene_Ele") -> DataFrame:
    """Trade of each node with its map attributes."""
    rows = panel.filter((F.col("Sv") == variable) & detect("Sr", node_pattern) & (F.col("Y5") == year))
    return with_scenario_category(natural_join(rows, nodes, on=["Sr"]), scenarios)
