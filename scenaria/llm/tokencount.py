"""Token counts of documents in flat token files without an index, by separator scan.

A flat file is nothing but ids (two bytes each here), every document followed by the end id. It is
cut into blocks; each block is searched for the end id in one vectorised comparison. What a block
has before its first end id belongs to a document that began in an earlier block: the blocks'
summaries, scanned in order of the file, say how many ids that document had so far and how many
documents came before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenaria.llm.common import materialize, new_path, ship, table
from scenaria.llm.tokens import encoder, vocab_path

END_ID, BLOCK_IDS = 49407, 1 << 21
_ITEM = np.dtype("<u2")


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocab: str | None = None) -> DataFrame:
    """Encode the texts into flat files, one per task, in the shared folder.

    Returns (file, path, ordinal, id): where each document went. Strings of special tokens in a
    text are encoded as ordinary text, so the end id stands at ends only. A task that is run again
    writes another file; only the files named in the result count.
    """
    spark = docs.sparkSession
    ship(spark)
    folder, vocab = new_path(spark, "flat"), vocab or vocab_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocab, special_as_text=True), TaskContext.get().partitionId()
        uri, out, n = f"{folder}/{part:06d}-{uuid.uuid4().hex}.u2", None, 0
        for b in batches:
            if out is None:
                fs, path = pafs.FileSystem.from_uri(uri)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path)
            ids, _ = enc.encode(b.column(1), end_id)
            out.write(ids.astype(_ITEM).tobytes())
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part, np.int32)), pa.array([uri] * rows), pa.array(np.arange(n, n + rows)), b.column(0)],
                ["file", "path", "ordinal", "id"],
            )
            n += rows
        if out:
            out.close()

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"file int, path string, ordinal long, id {kind}"), "flat-docs")


def scan_blocks(files: DataFrame, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Of (file, path): a row (file, block, k, n) for the k-th end id of each block, n being the
    ids before it in its block (since the end id before); and a summary row with k = -1,
    ends (end ids in the block) and n (ids after the last)."""
    ship(files.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                n = max(1, -(-fs.get_file_info(path).size // (block_ids * _ITEM.itemsize)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.array([uri] * n), pa.array(range(n), pa.int64())], ["file", "path", "block"]
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, uri, block in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block_ids * _ITEM.itemsize, block * block_ids * _ITEM.itemsize), _ITEM)
                ends = np.flatnonzero(ids == end_id)
                n = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
                k = np.arange(len(n))
                k[-1] = -1
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, file, np.int32)),
                        pa.array(np.full(size, block)),
                        pa.array(k),
                        pa.array(n),
                        pa.array(np.full(size, len(ends))),
                    ],
                    ["file", "block", "k", "n", "ends"],
                )

    blocks = files.select("file", "path").repartition("file").mapInArrow(cut, "file int, path string, block long")
    dealt = blocks.repartition("file", "block")
    return dealt.mapInArrow(scan, "file int, block long, k long, n long, ends long")


def count_tokens(files: DataFrame, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the flat files (file, path).

    n_tokens is without the end id; empty documents count 0. Ids behind the last end id of a file
    are one more document with closed = false. An empty file has no document.
    """
    found = materialize(scan_blocks(files, end_id, block_ids), "blocks")
    summary = found.filter("k = -1").select("file", "block", "ends", F.col("n").alias("tail"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = summary.withColumns(
        {"docs_before": F.coalesce(F.sum("ends").over(before), F.lit(0)), "ids_before": F.coalesce(F.sum("tail").over(before), F.lit(0))}
    )
    # Tails before the last block with an end id belong to documents that are over.
    over = F.last(F.when(F.col("ends") > 0, F.col("ids_before")), ignorenulls=True).over(before)
    scanned = scanned.withColumn("carry", F.col("ids_before") - F.coalesce(over, F.lit(0)))
    scanned = materialize(scanned, "scan")
    closed = (
        found.filter("k >= 0")
        .join(scanned.select("file", "block", "docs_before", "carry"), ["file", "block"])
        .select(
            "file",
            (F.col("docs_before") + F.col("k")).alias("ordinal"),
            (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
            F.lit(True).alias("closed"),
        )
    )
    last = scanned.groupBy("file").agg(F.max_by(F.struct("docs_before", "ends", "carry", "tail"), "block").alias("b"))
    rest = F.col("b.tail") + F.when(F.col("b.ends") == 0, F.col("b.carry")).otherwise(0)
    open_end = last.filter(rest > 0).select("file", F.col("b.docs_before") + F.col("b.ends"), rest, F.lit(False))
    return closed.union(open_end)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: the documents written as flat files and counted by scanning those."""
    at = write_flat(table(spark, sf_dir, "documents"))
    files = at.groupBy("file").agg(F.min("path").alias("path"))
    counts = count_tokens(files).filter("closed").select("file", "ordinal", "n_tokens")
    return at.join(counts, ["file", "ordinal"], "left").select(F.col("id").alias("doc_id"), "n_tokens")
