"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its PREFIX nearest pivots (a bounded sample of the vectors, thinned so
that no two are close: else a large group of near copies owns many of them, and the nearest ones of
two of its vectors hardly overlap), in order. Inverted lists lead from a pivot to the vectors that have it in their prefix; two vectors of
a list that share enough pivots are candidates, and their cosine is computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.llm.common import blocked, connected_components, materialize, ship, star_edges, table

COSINE = 0.95
#: Nearest pivots kept, and how many of them a pair must share.
PREFIX, SHARED = 8, 2
#: One pivot for so many distinct vectors, within bounds; the pivots are broadcast, so the upper
#: bound limits what is sent (8 MB at 64 numbers each). An inverted list then has some 512 vectors.
VECTORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 16, 16384
#: No two pivots have a cosine of APART or more; DRAWN vectors are looked at for each pivot wanted.
APART, DRAWN = 0.8, 4
#: Vectors of one list that are compared in one task; longer lists are cut into pairs of blocks.
BLOCK = 1024


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as a matrix, padded with zeros."""
    size = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
    return out


def _thinned(drawn: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of the first ``most`` rows that have a cosine below APART to all taken before."""
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    kept = unit[:0]
    for at in range(0, len(unit), 256):
        some = unit[at : at + 256]
        some = some[~(some @ kept.T >= APART).any(axis=1)]
        close = some @ some.T >= APART
        free = np.ones(len(some), bool)
        for k in range(len(some)):
            if free[k]:
                free[k + 1 :] &= ~close[k, k + 1 :]
        kept = np.concatenate([kept, some[free]])
        if len(kept) >= most:
            break
    return kept[:most]


def _described(nodes: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Add ``prefix``: the numbers of the nearest pivots, nearest first."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)
    kept = min(PREFIX, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                x = _matrix(some.column("vec"), dim)
                near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value.T
                top = np.argpartition(-near, kept - 1, axis=1)[:, :kept]
                order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
                prefix = np.take_along_axis(top, order, axis=1).astype(np.int32)
                ends = np.arange(0, kept * len(prefix) + 1, kept, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.ravel()))], [*some.schema.names, "prefix"]
                )

    return nodes.mapInArrow(run, "node long, n long, vec array<double>, prefix array<int>")


def _compare(groups: Iterator[pa.RecordBatch], dim: int, cosine: float, least: int) -> Iterator[pa.RecordBatch]:
    """For each block pair: (node, links, root) of the nodes with links. A pair counts in the list
    of the smallest pivot it shares, and there once."""
    for b in groups:
        out = [[], [], []]
        lists = b.column("cells")
        bounds, cells = np.asarray(lists.offsets), lists.values
        node, n, blk = (np.asarray(cells.field(c)) for c in ("node", "n", "blk"))
        vec, prefix = cells.field("vec"), cells.field("prefix")
        for g in range(len(lists)):
            lo, hi = int(bounds[g]), int(bounds[g + 1])
            x = _matrix(vec.slice(lo, hi - lo), dim)
            owned = prefix.slice(lo, hi - lo)
            size = np.diff(np.asarray(owned.offsets))
            pivot, back = np.unique(np.asarray(owned.flatten()), return_inverse=True)
            has = np.zeros((hi - lo, len(pivot)), np.float32)
            has[np.repeat(np.arange(hi - lo), size), back] = 1
            before = has[:, pivot < b.column("pivot")[g].as_py()]
            pair = (has @ has.T >= least) & (before @ before.T == 0)
            np.fill_diagonal(pair, False)
            if b.column("blk_lo")[g].as_py() != b.column("blk_hi")[g].as_py():
                own = blk[lo:hi]
                pair &= own[:, None] != own[None, :]
            norm = np.linalg.norm(x, axis=1)
            pair &= (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
            links = pair @ n[lo:hi]
            some = np.flatnonzero(pair.any(axis=1))
            member, root = star_edges(pair[np.ix_(some, some)])
            to = np.arange(len(some))
            to[member] = root
            out[0].append(node[lo:hi][some])
            out[1].append(links[some])
            out[2].append(node[lo:hi][some[to]])
        columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors with a cosine of at least ``cosine`` are linked. Equal vectors are one node of the
    search, so large groups of copies are never paired; n_links still counts all of them.
    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing;
    shorter vectors count as padded with zeros; a null id is never the smallest.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    nodes = rows.filter(usable).groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total, dim = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    counted = None
    if total:
        # A bounded sample, by hash: at most DRAWN * MOST_PIVOTS vectors come to the driver.
        most = max(LEAST_PIVOTS, min(MOST_PIVOTS, total // VECTORS_A_PIVOT))
        some = nodes.orderBy(F.xxhash64("vec"), "node").limit(DRAWN * most)
        pivots = np.array([r["vec"] + [0.0] * (dim - len(r["vec"])) for r in some.select("vec").collect()]).reshape(-1, dim)
        pivots = _thinned(pivots, most)
        least = min(SHARED, len(pivots))
        described = _described(nodes.select("node", "n", "vec"), pivots, dim)
        lists = described.withColumn("pivot", F.explode("prefix"))
        groups = (
            blocked(lists, "pivot", ["node"], BLOCK)
            .groupBy("pivot", "blk_lo", "blk_hi")
            .agg(F.collect_list(F.struct("node", "n", "vec", "prefix", "blk")).alias("cells"))
            .filter(F.size("cells") > 1)
        )
        counted = materialize(groups.mapInArrow(lambda it: _compare(it, dim, cosine, least), "node long, links long, root long"), "links")
        sums = counted.groupBy("node").agg(F.sum("links").alias("links"))
        roots = connected_components(counted.select("node", F.col("root").alias("other")), "node", "other")
        nodes = nodes.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        nodes = nodes.withColumns({"links": F.lit(0), "root": F.col("node")})
    least_id = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = nodes.join(least_id, "root").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("known")
    )
    marked = rows.withColumn("vec", F.when(usable, F.col("vec")))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return marked.join(known, "vec", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op4_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
