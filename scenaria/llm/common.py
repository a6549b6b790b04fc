"""Shared helpers: tables in the shared folder, components, bounded blocks, words as arrays."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package wherever the
    driver was started. On a cluster the package is installed or sent with the job."""
    sc = spark.sparkContext
    if sc.master.startswith("local["):
        sc.environment.setdefault("PYTHONPATH", ROOT)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        path = spark._jvm.org.apache.hadoop.fs.Path(configured)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="scenaria-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    what was computed survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is one
    grouped minimum and one join, so no component has to fit anywhere. Nothing but a count
    and a checksum comes to the driver.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = materialize(edges.filter(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select("v", "v").distinct()
            )
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


def blocked(rows: DataFrame, key: str, ident: list[str], size: int) -> DataFrame:
    """Cut the groups of ``key`` into pairs of blocks.

    Groups of one row go (nothing to compare). A group of n rows has ceil(n / size) blocks;
    a row of block b goes to every pair (b, j), as columns ``blk_lo``, ``blk_hi``, with its own
    block in ``blk``. Two rows of a key meet in exactly one pair: that of their blocks, or
    (b, b). A pair holds about 2 * size rows however large the group is.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("blk_n")).filter("blk_n > 1")
    blocks = F.ceil(F.col("blk_n") / F.lit(size)).cast("int")
    return (
        rows.join(n, key)
        .withColumn("blk_c", blocks)
        .withColumn("blk", F.pmod(F.xxhash64(*ident), F.col("blk_c")).cast("int"))
        .withColumn("blk_j", F.explode(F.sequence(F.lit(0), F.col("blk_c") - 1)))
        .withColumn("blk_lo", F.least("blk", "blk_j"))
        .withColumn("blk_hi", F.greatest("blk", "blk_j"))
        .drop("blk_n", "blk_c", "blk_j")
    )


def star_edges(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a boolean adjacency matrix: (member, root) positions."""
    n = len(linked)
    label = np.arange(n)
    if not n:
        return label, label
    grown = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(grown, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def parts(batch: pa.RecordBatch, column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``at_once`` bytes of text (whole texts; a longer one alone), so that
    what is computed from a part stays small. Unused memory goes back after each part."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = np.cumsum(size) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give unused memory of Arrow and of the C library back to the system: Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of every text (runs without ASCII white space; null: none).

    Returns the bounds of each text in the flat word list, the flat list as codes, and the
    distinct words that the codes point to.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    bounds = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    codes, vocab = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    blank = np.flatnonzero(np.asarray(pc.equal(vocab, ""), dtype=bool))
    if len(blank):
        keep = codes != blank[0]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return bounds, codes, vocab


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of a sequence from one prefix sum, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.power = self.back = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, self.BASE, np.uint64)])
                self.back = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, self.INVERSE, np.uint64)])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[: len(values)])])

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair."""
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self.back[start] + (end - start).astype(np.uint64))
