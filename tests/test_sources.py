"""Readers and writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scenaria import vocab
from scenaria import sources as src

from conftest import rows_of


def test_parameter_and_set(spark, tmp_path, table):
    path = str(tmp_path / "p")
    table("Sc string, St string, data_out_hr double", ("a", "D001H00", 1.0), ("a", "D001H01", 2.0)).write.parquet(path)
    df = src.read_parameter(spark, path, "data_out_hr", ["Sc", "St"])
    assert df.columns == ["Sc", "St", "value"] and df.count() == 2
    assert rows_of(src.read_set(spark, path, "St")) == [("D001H00",), ("D001H01",)]


def test_csv_parameter_has_declared_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("N,YEAR,cap\nKR,2050,1.5\nMN,bad,2\n")
    df = src.read_parameter(spark, str(tmp_path / "x.csv"), "cap", ["N", "YEAR"], fmt="csv")
    assert dict(df.dtypes) == {"N": "string", "YEAR": "int", "value": "double"}
    assert rows_of(df) == [("KR", 2050, 1.5), ("MN", None, 2.0)]


def test_scenarios_from_files_and_hive(spark, tmp_path, table):
    for s, v in (("500C", 1.0), ("500C_dmd+_CCS", 2.0), ("NoPOL", 3.0)):
        part = table("L string, cap double", ("l", v)).coalesce(1)
        part.write.parquet(str(tmp_path / "files" / f"{s}.parquet"))
    got = src.read_scenarios(spark, str(tmp_path / "files"), "cap", ["L"], ["500C_dmd+_CCS", "NoPOL"])
    assert rows_of(got, "Sc", "value") == [("500C_dmd+_CCS", 2.0), ("NoPOL", 3.0)]
    hive = str(tmp_path / "hive")
    table("L string, cap double, Sc string", ("l", 1.0, "500C"), ("l", 3.0, "NoPOL")).write.partitionBy("Sc").parquet(hive)
    df = src.read_scenarios(spark, hive, "cap", ["L"], ["NoPOL"], layout="hive")
    assert rows_of(df, "Sc", "L", "value") == [("NoPOL", "l", 3.0)]
    assert "PartitionFilters: [isnotnull(Sc" in df._jdf.queryExecution().executedPlan().toString()


def test_single_file_scenarios(spark, tmp_path):
    for s, v in (("500C", 1), ("500C_dmd+_CCS", 2)):
        (tmp_path / f"{s}.csv").write_text(f"L,cap\nl,{v}\n")
    all_ = src.read_scenarios(spark, str(tmp_path), "cap", ["L"], fmt="csv")
    assert rows_of(all_, "Sc", "value") == [("500C", 1.0), ("500C_dmd+_CCS", 2.0)]
    one = src.read_scenarios(spark, str(tmp_path), "cap", ["L"], ["500C_dmd+_CCS"], fmt="csv")
    assert rows_of(one, "Sc", "value") == [("500C_dmd+_CCS", 2.0)]


def test_yearly_files(spark, tmp_path):
    for s in ("500C", "NoPOL"):
        os.makedirs(tmp_path / s)
        for y in (2045, 2050):
            (tmp_path / s / f"{y}.csv").write_text(f"N,dmd\nKR,{y}\n")
    df = src.read_yearly_files(spark, str(tmp_path), "dmd", ["N"], ["500C"], [2050], fmt="csv")
    assert rows_of(df, "Sc", "Sy", "value") == [("500C", 2050, 2050.0)]


def test_scenario_tree_opens_only_what_the_matrix_names(spark, tmp_path):
    """The scenarios come from a table, so the folders are pruned while the plan runs; files of others cannot even be read."""
    for s in ("500C", "700C", "NoPOL"):
        for y in (2045, 2050):
            folder = tmp_path / "tree" / f"Sc={s}" / f"Sy={y}"
            os.makedirs(folder)
            if s == "700C" or y == 2045:
                (folder / "part-0.parquet").write_text("not a table")
            else:
                spark.createDataFrame([("KR", float(y))], "N string, dmd double").coalesce(1).write.mode("overwrite").parquet(str(folder))
    matrix = tmp_path / "m.csv"
    matrix.write_text("Scenario,Status,scen_dpol,scen_tpol\n500C,Optimal,a,b\n700C,Infeasible,a,b\nNoPOL,Optimal,a,b\n")
    feasible = src.read_scenario_matrix(spark, str(matrix)).filter("Status <> 'Infeasible'")
    df = src.read_scenario_tree(spark, str(tmp_path / "tree"), "dmd", ["N"], feasible, [2050])
    assert df.columns == ["Sc", "Sy", "N", "value"]
    assert rows_of(df) == [("500C", 2050, "KR", 2050.0), ("NoPOL", 2050, "KR", 2050.0)]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="part-0|not a Parquet|PARQUET"):
        src.read_scenario_tree(spark, str(tmp_path / "tree"), "dmd", ["N"], None, [2050]).collect()


def test_scenario_matrix_by_header_name(spark, tmp_path):
    (tmp_path / "s.csv").write_text("x,scen_tpol,Scenario,Status,scen_dpol\n1,NEAG,500C,Optimal,default\n")
    assert rows_of(src.read_scenario_matrix(spark, str(tmp_path / "s.csv"))) == [("500C", "Optimal", "default", "NEAG")]


def test_geojson_attributes(spark, tmp_path):
    feat = {"type": "Feature", "properties": {"N_PSY": "JP-HD", "centroid_x": 142.5, "centroid_y": 43.0},
            "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "n.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feat]}, indent=1))
    df = src.read_node_attributes(spark, str(tmp_path / "n.geojson"))
    assert rows_of(df, "Sr", "centroid_x", "centroid_y") == [("JP-HD", 142.5, 43.0)]
    assert "Point" in df.first().geometry


def test_geojson_of_many_files(spark, tmp_path):
    for k in range(12):
        feats = [{"type": "Feature", "properties": {"N_PSY": f"N{k}-{j}", "centroid_x": float(k), "centroid_y": float(j)}, "geometry": None} for j in range(3)]
        (tmp_path / f"part-{k}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    df = src.read_node_attributes(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    assert rows_of(df, "Sr", "centroid_x", "centroid_y") == sorted((f"N{k}-{j}", float(k), float(j)) for k in range(12) for j in range(3))


def test_gdp_without_its_footer(spark, tmp_path):
    (tmp_path / "gdp.csv").write_text('Region,Unit,2020,2025\nJapan,x,1.5,2\nChina,x,,4\n,,"Source: somebody, 2023",\n')
    df = src.read_gdp(spark, str(tmp_path / "gdp.csv"))
    assert dict(df.dtypes) == {"Region": "string", "2020": "double", "2025": "double"}
    assert rows_of(df) == [("China", None, 4.0), ("Japan", 1.5, 2.0)]


def test_inline_tables(spark):
    df = src.inline_table(spark, "a string, b int", [("it's", 1), ("back\\slash", None)])
    assert rows_of(df) == [("back\\slash", None), ("it's", 1)]
    empty = src.inline_table(spark, "a string, b int", [])
    assert empty.count() == 0 and empty.dtypes == [("a", "string"), ("b", "int")]
    long = src.inline_table(spark, "a string, b int, c double, d boolean", [(f"k{i}", i, i / 7, i % 2 == 0) for i in range(20_000)])
    assert long.count() == 20_000 and long.dtypes == [("a", "string"), ("b", "int"), ("c", "double"), ("d", "boolean")]
    assert tuple(long.filter("b = 12345").first()) == ("k12345", 12345, 12345 / 7, False)
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_variable_table(spark):
    df = src.variable_table(spark, vocab.ANNUAL, vocab.ANNUAL_OUTFLOWS)
    assert df.count() == 19 and df.filter("is_outflow").count() == 3
    assert df.orderBy("ord").first().Variable == vocab.ANNUAL[0].Variable


def test_sinks(spark, tmp_path, table):
    df = table("Sc string, Sr string, value double", ("w/ grid", "JPN", 1.0), ("NoPOL", "KR", 2.0))
    path = src.write_table(df, str(tmp_path), "t7", fmt="csv")
    assert spark.read.option("header", True).csv(path).count() == 2
    path = src.write_by_key(df, str(tmp_path), "by_key")
    back = spark.read.parquet(path)
    assert rows_of(back, "Sr", "Sc", "value") == [("JPN", "w/ grid", 1.0), ("KR", "NoPOL", 2.0)]
    assert os.path.isdir(os.path.join(path, "Sr=JPN"))


def test_writing_one_key_again_leaves_the_others(spark, tmp_path, table):
    schema = "Sc string, Sr string, value double"
    first = table(schema, ("a", "JPN", 1.0), ("b", "JPN", 2.0), ("b", "KR", 3.0))
    path = src.write_by_key(first, str(tmp_path), "t")
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet") if "Sc=a" in str(p) or "Sr=KR" in str(p)}
    for _ in range(2):  # a repeated run gives the same rows
        src.write_by_key(table(schema, ("b", "JPN", 9.0)), str(tmp_path), "t")
        assert rows_of(spark.read.parquet(path), "Sc", "Sr", "value") == [("a", "JPN", 1.0), ("b", "JPN", 9.0), ("b", "KR", 3.0)]
    assert files == {f: os.stat(f).st_mtime_ns for f in files}
