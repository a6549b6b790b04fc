"""Run queries against their DuckDB twins: ``python tools/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scenaria.session import local_session  # noqa: E402
from scenaria.workload.catalog import QUERIES  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        if hasattr(v, "to_pydatetime"):
            return str(v.to_pydatetime())
        if hasattr(v, "item"):
            v = v.item()
            return 0.0 if isinstance(v, float) and v == 0 else v
        return str(v) if not isinstance(v, (int, str, bool)) else v

    df = df[sorted(df.columns)]
    cols = [[cell(v) for v in df[c].astype(object).where(df[c].notna(), None)] for c in df.columns]
    return sorted(zip(*cols), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def types_of(df) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def compare(spark, con, name: str, sf_dir: str, got_df=None) -> str:
    q = QUERIES[name]
    got_df = q.plan(spark, sf_dir) if got_df is None else got_df
    got = got_df.toPandas()
    rel = con.sql(q.sql)
    want_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    want = rel.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows differ: {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; first spark={bad[0][0]} duckdb={bad[0][1]}"
    pairs = {c: (types_of(got_df)[c], want_types[c]) for c in got.columns}
    same = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    off = {c: p for c, p in pairs.items() if same.get(p[0]) != p[1]}
    return f"ok {len(a)}" + (f" TYPES {off}" if off else "")


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("oracle-check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for n in names:
        start = time.time()
        try:
            res = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += not res.startswith("ok")
        print(f"{n:32s} {time.time() - start:6.2f}s {res}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
