"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over a histogram of lengths, not over documents: best fit in descending
length, a whole count at a time. The histogram has at most ``capacity`` rows, and so the plan is
small whatever the corpus holds. Documents then take the planned slots by their rank within
their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenaria.llm.common import materialize, ship, table
from scenaria.llm.tokens import encoder, vocab_path

CAPACITY, END_ID = 2048, 0
#: Rows that are ranked in one group; a length with more is cut by a hash of its rows.
RANKED = 1000

Placement = tuple[int, int, int, int, int, int]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocab: str, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the ids of each text and ``end_id``, cut after
    every ``capacity`` ids. Null texts count as empty and still have their end id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            ids, bounds = enc.encode(b.column(1), end_id)
            ids = ids.astype("<u4")
            size = np.diff(bounds)
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            at = bounds[doc] + start
            crc = [zlib.crc32(ids[s : s + n]) for s, n in zip(at.tolist(), length.tolist())]
            out = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = rows.schema["id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def plan(histogram: dict[int, int], capacity: int) -> list[Placement]:
    """Best fit, longest first, over counts: (length, rank, k, n, sequence, offset).

    Items of ``length`` with ranks rank .. rank + n - 1 go into consecutive sequences from
    ``sequence`` on, k into each, one behind the other from ``offset``. Sequences with the same
    room are kept as ranges; the fullest that still has room comes first, as in best fit.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    placed: list[Placement] = []
    opened = 0

    def put(length: int, rank: int, left: int, free: int, first: int, bins: int) -> int:
        """Fill up to ``bins`` sequences with ``free`` room; returns the number of items placed."""
        k = free // length
        full = min(bins, left // k)
        if full:
            placed.append((length, rank, k, full * k, first, capacity - free))
            room.setdefault(free - k * length, []).append((first, full))
        rest, used = (left - full * k if full < bins else 0), full
        if rest:
            placed.append((length, rank + full * k, rest, rest, first + full, capacity - free))
            room.setdefault(free - rest * length, []).append((first + full, 1))
            used += 1
        if used < bins:
            room.setdefault(free, []).append((first + used, bins - used))
        return full * k + rest

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            free = min((r for r, bins in room.items() if r >= length and bins), default=None)
            if free is None:
                free, first, bins = capacity, opened, -(-left // (capacity // length))
                opened += bins
            else:
                first, bins = room[free].pop()
            done = put(length, rank, left, free, first, bins)
            rank, left = rank + done, left - done
    return placed


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) within ``length``. A length with many rows is ranked in slices by a
    hash of the row's number ``at``, each behind those before it; so repeated rows are in many slices too."""
    slices = counts.select("length", F.ceil(F.col("count") / F.lit(RANKED)).cast("int").alias("slices"))
    cut = rows.join(F.broadcast(slices), "length").withColumn(
        "slice", F.pmod(F.xxhash64("at"), F.col("slices")).cast("int")
    )
    sizes = cut.groupBy("length", "slice").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("id", "piece", "at")
    numbered = cut.withColumn("row", F.row_number().over(within))
    return numbered.join(base, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("row") - 1)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocab: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Only texts of more than ``capacity`` tokens are cut. Null and empty texts are one token
    (the end id). Repeated rows are packed as often as they occur; ids may be null; columns other
    than the two named are not read; an empty table gives no piece.
    """
    spark = docs.sparkSession
    made = pieces(docs, id_col, text_col, capacity, end_id, vocab or vocab_path(), with_ids)
    rows = materialize(made.withColumn("at", F.monotonically_increasing_id()), "pieces")
    counts = rows.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # at most ``capacity`` rows
    schema = "length long, p_rank long, p_k long, p_n long, p_seq long, p_off long"
    places = spark.createDataFrame(plan(histogram, capacity), schema)
    sized = spark.createDataFrame(list(histogram.items()), "length long, count long")
    # The plan and the histogram are bounded by the capacity alone (see ``plan``), hence the broadcasts.
    slot = F.col("rank") - F.col("p_rank")
    return (
        ranked(rows, sized)
        .join(F.broadcast(places.withColumnRenamed("length", "p_length")), (F.col("length") == F.col("p_length")) & slot.between(0, F.col("p_n") - 1))
        .select(
            F.col("id").alias(id_col),
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("p_seq") + F.floor(slot / F.col("p_k"))).cast("long").alias("sequence_id"),
            (F.col("p_off") + (slot % F.col("p_k")) * F.col("length")).cast("long").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
