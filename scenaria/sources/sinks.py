"""Writers of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Persist one result table under ``root/name``."""
    path = f"{root}/{name}"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_by_key(df: DataFrame, root: str, name: str, keys: Sequence[str] = ("Sr", "Sc"), fmt: str = "parquet", rows_per_file: int = 5_000_000) -> str:
    """One folder per region and scenario. Rows are not shuffled into one task
    per key: each task writes its part, and large parts roll over to new files.

    A write replaces the folders of the keys that ``df`` holds, and no other: one scenario can be made
    again beside the rest, and a repeated run leaves the same rows.
    """
    path = f"{root}/{name}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.partitionBy(*keys).option("maxRecordsPerFile", rows_per_file)
    writer.format(fmt).save(path)
    return path
