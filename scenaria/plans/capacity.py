"""Link, generator and storage capacities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria.functions import (
    class_of_ends,
    detect,
    first_match,
    link_label,
    link_scope,
    lookup,
    recode,
    same_site,
    scaled,
    strip_bus,
    to_number,
    year_bin,
)
from scenaria.operators import (
    code_join,
    complete_series,
    contrast,
    extents,
    grouped_mean,
    grouped_sum,
    natural_join,
    role_join,
    split_link,
    union_rows,
    with_totals,
)
from scenaria.plans.panel import labelled, of_codes
from scenaria.sources import inline_table


def link_capacity(links: DataFrame, pattern: str = vocab.AC_LINK) -> DataFrame:
    """Mean capacity per AC link and five-year bin, all scenarios from one scan."""
    rows = links.filter(detect("PW_LNK", pattern)).withColumn("Y5", year_bin(to_number("YEAR")))
    return grouped_mean(rows, ["Sc", "PW_LNK", "Y5"])


def corridor_capacity(
    link_cap: DataFrame,
    labels: Mapping[str, str],
    keep: Sequence[str],
    corridors: Sequence[tuple[str, str, str]] = tuple(vocab.CAPACITY_CORRIDORS),
    flag: Column | None = None,
    scenarios: DataFrame | None = None,
) -> DataFrame:
    """Capacity per corridor; links outside of the named corridors stay as one
    NULL corridor. ``scenarios`` adds the scenario categories."""
    ends = split_link(link_cap, "PW_LNK").withColumn("Sv", class_of_ends("N0", "N1", corridors))
    total = grouped_sum(of_codes(ends, labels, keep), ["Sc", "Sv", "Y5"]).withColumn("Sc", recode("Sc", labels))
    out = total.withColumn("Flag", link_scope("Sv") if flag is None else flag)
    if scenarios is None:
        return out
    cats = scenarios.select(F.col("Scenario").alias("Sc"), F.col("scen_dpol").alias("cat1"), F.col("scen_tpol").alias("cat2"))
    return natural_join(out, cats)


def short_scope() -> Column:
    """Scope flag of the short corridor names: a dash joins two countries."""
    return link_scope("Sv", marker="-", marked="international", other="domestic")


def corridor_complete(corridors: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """International corridors with a zero where a scenario has none."""
    rows = corridors.filter(F.col("Flag") == "international")
    return complete_series(rows, ["Sv", "Y5", "Flag"], "Sc", scenarios, fill=0.0)


def named_links(link_cap: DataFrame, end_pattern: str = "JP-") -> DataFrame:
    """Links into a country with a readable name."""
    ends = split_link(link_cap, "PW_LNK").filter(detect("N1", end_pattern))
    return ends.withColumn("Sv", link_label("PW_LNK")).drop("PW_LNK")


def domestic_links(
    link_cap: DataFrame,
    labels: Mapping[str, str],
    keep: Sequence[str],
    collapse_to: Mapping[str, str] = vocab.SMALL_LINKS_AS_OTHER,
    first_year: int = 2020,
    end_pattern: str = "JP-",
) -> DataFrame:
    """Readable link capacities, the small links summed as ``Other``."""
    rows = of_codes(named_links(link_cap, end_pattern), labels, keep).filter(F.col("Y5") >= first_year)
    total = grouped_sum(rows.withColumn("Sv", recode("Sv", collapse_to)), ["Sc", "Sv", "Y5"])
    return total.withColumn("Sc", recode("Sc", labels))


def link_difference(
    link_cap: DataFrame,
    labels: Mapping[str, str],
    plus: str,
    minus: str,
    first_year: int = 2020,
    end_pattern: str = "JP-",
    exclude: str | None = "KR",
) -> DataFrame:
    """Capacity difference of two scenarios; NULL where one of them lacks the link."""
    rows = labelled(named_links(link_cap, end_pattern), labels, [plus, minus]).filter(F.col("Y5") >= first_year)
    if exclude:
        rows = rows.filter(~detect("Sv", exclude))
    return contrast(rows, ["Sv", "Y5"], "Sc", plus, minus)


def links_with_coordinates(
    link_cap: DataFrame,
    nodes: DataFrame,
    labels: Mapping[str, str],
    keep: Sequence[str],
    year: int,
    end_pattern: str = "JP-",
) -> DataFrame:
    """Links in GW with the coordinates of both ends."""
    rows = split_link(labelled(link_cap, labels, keep), "PW_LNK", keep=False)
    rows = rows.filter(detect("N1", end_pattern) & (F.col("Y5") == year))
    rows = rows.withColumns(
        {
            "N0": F.replace("N0", F.lit("-AC"), F.lit("")),
            "N1": F.replace("N1", F.lit("-AC"), F.lit("")),
            "value": scaled("value", 1000),
        }
    )
    points = nodes.select("Sr", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    return role_join(role_join(rows, points, "Sr", "N0", "0"), points, "Sr", "N1", "1")


def link_width_range(links: DataFrame) -> DataFrame:
    """Extent of the capacities, for a common width scale."""
    return extents(links, [])


def generator_capacity(gen_cap: DataFrame, region_pattern: str | None = None) -> DataFrame:
    """Generator capacity by variable; unmapped codes drop out."""
    rows = [("ALL", c, v) for c, v in vocab.GENERATOR_VARIABLE.items()]
    codes = inline_table(gen_cap.sparkSession, "SE0 string, PW_GEN string, Sv string", rows)
    facts = gen_cap.filter(detect("N", region_pattern)) if region_pattern else gen_cap
    out = code_join(facts, codes, ["Sv", "YEAR"])
    return out.select("Sc", F.col("N").alias("Sr"), "Sv", to_number("YEAR").alias("Sy"), "value")


def intra_node_power(links: DataFrame, site_pattern: str, node_pattern: str | None = "JP-", self_links: bool = False) -> DataFrame:
    """Power of the conversion and storage links inside a node."""
    ends = split_link(links.filter(~detect("PW_LNK", vocab.AC_LINK)), "PW_LNK")
    if node_pattern:
        ends = ends.filter(detect("N0", node_pattern))
    if self_links:
        ends = ends.filter(strip_bus("N0") == strip_bus("N1"))
    return ends.select(
        "Sc",
        same_site("N0", "N1", site_pattern).alias("Sr"),
        class_of_ends("N0", "N1", vocab.ASSET_OF_BUSES).alias("Sv"),
        to_number("YEAR").alias("Sy"),
        "value",
    )


def storage_rows(sto_cap: DataFrame, region_pattern: str | None = None) -> DataFrame:
    rows = [("ALL", c, v) for c, v in vocab.STORAGE_VARIABLE.items()]
    codes = inline_table(sto_cap.sparkSession, "SE0 string, PW_STO string, Sv string", rows)
    facts = sto_cap.filter(detect("N", region_pattern)) if region_pattern else sto_cap
    out = code_join(facts, codes, ["Sv", "Sc"])
    return out.select("Sc", F.col("N").alias("Sr"), "Sv", to_number("YEAR").alias("Sy"), "value")


def binned_capacity(rows: DataFrame, labels: Mapping[str, str], keep: Sequence[str], countries: Sequence[tuple[str, str]] = tuple(vocab.COUNTRY_OF_NODE)) -> DataFrame:
    """Mean per node and five-year bin, with the node's country."""
    binned = of_codes(rows, labels, keep).withColumns({"Sr2": first_match("Sr", countries), "Y5": year_bin("Sy")})
    return grouped_mean(binned, ["Sc", "Sr", "Sr2", "Sv", "Y5"]).withColumn("Sc", recode("Sc", labels))


def storage_capacity(sto_cap: DataFrame, labels: Mapping[str, str], keep: Sequence[str], countries: Sequence[tuple[str, str]] = tuple(vocab.COUNTRY_OF_NODE)) -> DataFrame:
    return binned_capacity(storage_rows(sto_cap), labels, keep, countries)


def technology_capacity(
    gen_cap: DataFrame,
    links: DataFrame,
    sto_cap: DataFrame,
    labels: Mapping[str, str],
    keep: Sequence[str],
    site_pattern: str,
    node_pattern: str | None = None,
) -> DataFrame:
    """Generators, intra-node links and storages in one capacity table."""
    rows = union_rows(
        generator_capacity(gen_cap, node_pattern),
        intra_node_power(links, site_pattern, node_pattern),
        storage_rows(sto_cap, node_pattern),
    )
    return binned_capacity(rows, labels, keep)


def storage_by_country(storage: DataFrame, year: int, variables: Mapping[str, str] = vocab.STORAGE_LABEL, only: str | None = "Li-ion battery", total: bool = True) -> DataFrame:
    """Energy capacity by country with the total, labelled."""
    rows = storage.filter(F.col("Sv").isin(list(variables)) & (F.col("Y5") == year))
    keys = ["Sc", "Sv", "Y5"]
    out = with_totals(rows, keys, "Sr2") if total else grouped_sum(rows, [*keys, "Sr2"])
    out = out.withColumn("Sv", recode("Sv", variables))
    return out.filter(F.col("Sv") == only) if only else out


def storage_by_node(storage: DataFrame, year: int, variables: Mapping[str, str] = vocab.STORAGE_LABEL) -> DataFrame:
    rows = storage.filter(F.col("Sv").isin(list(variables)) & (F.col("Y5") == year))
    return grouped_sum(rows, ["Sc", "Sr", "Sv", "Y5"]).withColumn("Sv", recode("Sv", variables))


def installed_vs_potential(
    installed: DataFrame,
    maximum: DataFrame,
    scenarios: Mapping[str, str],
    region_pattern: str = "JP-",
    technologies: Mapping[str, str] = vocab.RENEWABLE_LABEL,
    maximum_label: str = "maximum installable capacity",
) -> DataFrame:
    """Installed capacity per scenario beside the potential.

    Every potential appears for every scenario, with zero where nothing was
    built. ``installed`` is (Sc, N, R, value), ``maximum`` is (N, R, value).
    """
    wanted = F.col("R").isin(list(technologies)) & detect("N", region_pattern)
    limit = maximum.filter(wanted).select("N", "R", F.col("value").alias("limit"))
    codes = F.array(*[F.lit(c) for c in scenarios])
    asked = limit.select("N", "R", F.explode(codes).alias("Sc"))
    built = natural_join(installed.filter(wanted), asked, "right", on=["Sc", "N", "R"]).na.fill({"value": 0.0})
    rows = union_rows(
        built.select("N", "R", "value", lookup("Sc", scenarios).alias("Sv")),
        limit.select("N", "R", F.col("limit").alias("value"), F.lit(maximum_label).alias("Sv")),
    )
    return grouped_sum(rows.withColumn("R", recode("R", technologies)), ["N", "Sv", "R"])
