"""Scans of model results, dimensions and reference series.

Schemas are explicit: no inference pass over the data, and the index columns
have one type across scenarios. Scenario and year come from the path, so a
filter on them prunes files instead of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.functions import to_number

INDEX_TYPES = {"Sy": "int", "YEAR": "int", "Y": "int"}


def _schema(index: Sequence[str], symbol: str) -> str:
    cols = [f"`{c}` {INDEX_TYPES.get(c, 'string')}" for c in index]
    return ", ".join([*cols, f"`{symbol}` double"])


def _read(spark: SparkSession, paths: str | Sequence[str], schema: str | None, fmt: str, base: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if base:
        reader = reader.option("basePath", base)
    return reader.load(paths if isinstance(paths, str) else list(paths))


def read_parameter(spark: SparkSession, path: str | Sequence[str], symbol: str, index: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """One long parameter table; its value column is named after the symbol on
    disk and ``value`` in Spark."""
    return _read(spark, path, _schema(index, symbol), fmt).withColumnRenamed(symbol, "value")


def read_set(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A one-column domain."""
    return _read(spark, path, f"`{name}` string", fmt).select(name).distinct()


def read_scenarios(
    spark: SparkSession,
    root: str,
    symbol: str,
    index: Sequence[str],
    scenarios: Sequence[str] | None = None,
    fmt: str = "parquet",
    layout: str = "files",
) -> DataFrame:
    """The same symbol of many scenarios in one scan, tagged ``Sc``.

    ``layout='files'``: ``root/<Sc>.<ext>``; the named scenarios select the
    files. ``layout='hive'``: ``root/Sc=<Sc>/``; partition pruning does.
    """
    if layout == "hive":
        schema = _schema(index, symbol) + ", `Sc` string"
        out = _read(spark, root, schema, fmt)
        if scenarios is not None:
            out = out.filter(F.col("Sc").isin(list(scenarios)))
    else:
        paths = [f"{root}/{s}.{fmt}" for s in scenarios] if scenarios is not None else f"{root}/*.{fmt}"
        # the scenario may be one file or a folder of part files
        name = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)\.{fmt}(?:/.*)?$", 1)
        out = _read(spark, paths, _schema(index, symbol), fmt).withColumn("Sc", _decoded(name))
    return out.withColumnRenamed(symbol, "value")


def read_scenario_tree(
    spark: SparkSession,
    root: str,
    symbol: str,
    index: Sequence[str],
    matrix: DataFrame | None = None,
    years: Sequence[int] | None = None,
    fmt: str = "parquet",
    scenario: str = "Scenario",
) -> DataFrame:
    """``root/Sc=<Sc>/Sy=<year>/``: all scenarios and years of a symbol in one scan.

    Scenario and year are partition columns. ``years`` selects folders while the plan is built. ``matrix`` keeps
    the scenarios of its column ``scenario``; what that table holds is known when the plan runs only, so Spark then
    prunes the folders by it: rows of other scenarios are not read and thrown away, their files are not opened.
    """
    out = _read(spark, root, _schema(index, symbol) + ", `Sc` string, `Sy` int", fmt)
    if years is not None:
        out = out.filter(F.col("Sy").isin(list(years)))
    if matrix is not None:
        out = out.join(matrix.select(F.col(scenario).alias("Sc")), "Sc", "left_semi")
    return out.select("Sc", "Sy", *index, F.col(symbol).alias("value"))


def read_yearly_files(
    spark: SparkSession,
    root: str,
    symbol: str,
    index: Sequence[str],
    scenarios: Sequence[str],
    years: Sequence[int],
    fmt: str = "parquet",
) -> DataFrame:
    """``root/<Sc>/<year>.<ext>``: only the files of the wanted years are opened."""
    paths = [f"{root}/{s}/{y}.{fmt}" for s in scenarios for y in years]
    parts = F.split(F.col("_metadata.file_path"), "/")
    raw = _read(spark, paths, _schema(index, symbol), fmt)
    year = to_number(F.regexp_extract(F.element_at(parts, -1), r"^(\d+)\.", 1))
    out = raw.withColumns({"Sc": _decoded(F.element_at(parts, -2)), "Sy": year})
    return out.withColumnRenamed(symbol, "value")


def _decoded(path_part: Column) -> Column:
    """Path text as written; a plus sign in a file name stands for itself."""
    return F.url_decode(F.replace(path_part, F.lit("+"), F.lit("%2B")))


def read_scenario_matrix(spark: SparkSession, path: str) -> DataFrame:
    schema = "Scenario string, Status string, scen_dpol string, scen_tpol string"
    # header names decide, so extra columns of the file do not shift the fields
    wide = spark.read.option("header", True).csv(path)
    return wide.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(schema).fields])


def read_gdp(spark: SparkSession, path: str) -> DataFrame:
    """Wide yearly series; the attribution line at the end has no region and is dropped."""
    wide = spark.read.option("header", True).csv(path)
    years = [c for c in wide.columns if c.isdigit()]
    typed = wide.select("Region", *[to_number(F.col(f"`{y}`"), "double").alias(y) for y in years])
    return typed.filter(F.col("Region").isNotNull())


def read_node_attributes(spark: SparkSession, path: str, key: str = "N_PSY") -> DataFrame:
    """Feature attributes of a GeoJSON file; the geometry stays a JSON text."""
    schema = T.StructType(
        [
            T.StructField(
                "features",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField(
                                "properties",
                                T.StructType(
                                    [
                                        T.StructField(key, T.StringType()),
                                        T.StructField("centroid_x", T.DoubleType()),
                                        T.StructField("centroid_y", T.DoubleType()),
                                    ]
                                ),
                            ),
                            T.StructField("geometry", T.StringType()),
                        ]
                    )
                ),
            )
        ]
    )
    feats = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    return feats.select(
        F.col(f"f.properties.{key}").alias("Sr"),
        F.col("f.properties.centroid_x").alias("centroid_x"),
        F.col("f.properties.centroid_y").alias("centroid_y"),
        F.col("f.geometry").alias("geometry"),
    )
