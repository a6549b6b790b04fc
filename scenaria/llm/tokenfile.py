"""Token-id shards with a minimal perfect hash index.

A shard is one binary file: the ids of its documents in ascending key order, little-endian, two
bytes wide if the vocabulary allows it, then the index, then a footer.

    payload | keys (int64) | null flags | document bounds (uint64, in ids)
            | hash words (uint64) | ranks (uint32) | fingerprints (uint32) | first ordinals (uint32)
            | footer (JSON) | its length (uint32) | magic

The hash sends each key to a number of its own below the number of keys: level by level, keys
that alone hit a bit of the level's array keep it, the others go on to the next level; a key's
number is the rank of its bit. The index stores a fingerprint for each number, so keys that are not
in the shard are turned away (but for one in 2**32), and the ordinal of the key's first document.
A look-up reads a few words whatever the size of the shard.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenaria.llm.common import materialize, mix64, new_path, ship, table
from scenaria.llm.tokens import encoder, vocab_path

MAGIC = b"IDSHARD1"
#: Bits for each key left, and levels at most; keys that are left then are looked up by search.
GAMMA, LEVELS = 2, 48
_FINGERPRINT = 999


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys, by numpy."""

    def __init__(self, bits: list[int], words: np.ndarray, ranks: np.ndarray, rest: np.ndarray) -> None:
        self.bits, self.words, self.ranks, self.rest = bits, words, ranks, rest

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, bits, words = keys.view(np.uint64), [], []
        while len(left) and len(bits) < LEVELS:
            m = -(-GAMMA * len(left) // 64) * 64
            at = (mix64(left, len(bits)) % np.uint64(m)).astype(np.int64)
            hits = np.bincount(at, minlength=m)
            words.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            bits.append(m)
            left = left[hits[at] != 1]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.uint32)]).astype(np.uint32)
        return cls(bits, flat, ranks, np.sort(left.view(np.int64)))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; of a key that was not built in, any number or -1."""
        keys = np.ascontiguousarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.bits):
            at = (mix64(keys[left].view(np.uint64), level) % np.uint64(m)).astype(np.int64)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.ranks[word][hit] + below[hit]
            left, base = left[~hit], base + m // 64
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = int(self.ranks[-1]) + at[same]
        return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; documents come in key order, null keys first."""

    def __init__(self, uri: str, width: int) -> None:
        fs, path = _open(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = fs.open_output_stream(path), width
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, keys: np.ndarray, nulls: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.nulls.append(nulls)
        self.sizes.append(np.diff(bounds))

    def close(self) -> tuple[int, int]:
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        nulls = np.concatenate([np.zeros(0, bool), *self.nulls])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.sizes]))]).astype("<u8")
        first = np.flatnonzero(~nulls & np.r_[True, (keys[1:] != keys[:-1]) | nulls[:-1]][: len(keys)])
        own = keys[first]
        mph = PerfectHash.build(own)
        number = mph.number(own)
        ordinal, prints = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
        ordinal[number] = first
        prints[number] = mix64(own.view(np.uint64), _FINGERPRINT) >> np.uint64(32)
        parts = {"keys": keys, "nulls": nulls.view(np.uint8), "bounds": bounds, "words": mph.words, "ranks": mph.ranks, "rest": mph.rest, "prints": prints, "ordinals": ordinal}
        at, footer = int(bounds[-1]) * self.width, {"width": self.width, "docs": len(keys), "bits": mph.bits, "parts": {}}
        for name, part in parts.items():
            raw = part.astype(part.dtype.newbyteorder("<")).tobytes()
            footer["parts"][name] = [at, len(part), part.dtype.newbyteorder("<").str]
            self.out.write(raw)
            at += len(raw)
        raw = json.dumps(footer).encode()
        self.out.write(raw + struct.pack("<I", len(raw)) + MAGIC)
        self.out.close()
        return len(keys), int(bounds[-1])


class Shard:
    """A shard opened for reading."""

    def __init__(self, uri: str) -> None:
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))
        self.docs, self.width = self.footer["docs"], self.footer["width"]
        self.parts: dict[str, np.ndarray] = {}

    def _some(self, name: str, first: int, n: int) -> np.ndarray:
        """``n`` entries of a part of the index, read from the file."""
        at, _, kind = self.footer["parts"][name]
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(n * width, at + first * width), kind)

    def _part(self, name: str) -> np.ndarray:
        """A whole part of the index, read when it is first asked for."""
        if name not in self.parts:
            self.parts[name] = self._some(name, 0, self.footer["parts"][name][1])
        return self.parts[name]

    @property
    def keys(self) -> np.ndarray:
        return self._part("keys")

    @cached_property
    def nulls(self) -> np.ndarray:
        return self._part("nulls").astype(bool)

    @property
    def bounds(self) -> np.ndarray:
        return self._part("bounds")

    @property
    def prints(self) -> np.ndarray:
        return self._part("prints")

    @property
    def ordinals(self) -> np.ndarray:
        return self._part("ordinals")

    @cached_property
    def hash(self) -> PerfectHash:
        return PerfectHash(self.footer["bits"], self._part("words"), self._part("ranks"), self._part("rest"))

    def ordinal(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of the first document of each key, -1 if the shard has none."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        number = self.hash.number(keys)
        prints = (mix64(np.ascontiguousarray(keys, np.int64).view(np.uint64), _FINGERPRINT) >> np.uint64(32)).astype(np.uint32)
        found = (number >= 0) & (self.prints[number] == prints)
        return np.where(found, self.ordinals[number].astype(np.int64), -1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents with ordinals first .. last - 1, as little-endian uint32."""
        lo, hi = int(self.bounds[first]), int(self.bounds[last])
        raw = self.file.read_at((hi - lo) * self.width, lo * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key's first document; None if the shard has no such key. Reads one word of each level
        up to the key's, one entry of each other part and the ids."""
        name, base = np.array([key], np.int64).view(np.uint64), 0
        for level, m in enumerate(self.footer["bits"]):
            at = int(mix64(name, level)[0] % np.uint64(m))
            word = int(self._some("words", base + at // 64, 1)[0])
            if word >> at % 64 & 1:
                number = int(self._some("ranks", base + at // 64, 1)[0]) + (word & ((1 << at % 64) - 1)).bit_count()
                break
            base += m // 64
        else:
            return self._get_rest(key)
        if int(self._some("prints", number, 1)[0]) != int(mix64(name, _FINGERPRINT)[0]) >> 32:
            return None
        return self._get_at(int(self._some("ordinals", number, 1)[0]))

    def _get_rest(self, key: int) -> np.ndarray | None:
        """Keys that no level placed; there hardly ever are any."""
        if not self.footer["parts"]["rest"][1]:
            return None
        at = int(self.ordinal(np.array([key], np.int64))[0])
        return None if at < 0 else self._get_at(at)

    def _get_at(self, at: int) -> np.ndarray:
        lo, hi = (int(x) for x in self._some("bounds", at, 2))
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}").astype("<u4")

    def ordinals_of(self, first: int, last: int) -> np.ndarray:
        """Where the documents first .. last - 1 are, by their keys: the index leads to a key's first document, its
        further ones follow. Documents without a key have none to look up; they come first in a shard."""
        keys, nulls, at = self.keys[first:last], self.nulls[first:last], np.arange(first, last)
        found = self.ordinal(keys)
        if (found[~nulls] < 0).any() or (self.keys[found[~nulls]] != keys[~nulls]).any():
            raise ValueError("the index does not lead to its keys")
        none = int(self.nulls.sum())
        repeat = at - none - np.searchsorted(self.keys[none:], keys)
        return np.where(nulls, at, found + repeat)


def write_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocab: str | None = None, shards: int | None = None
) -> DataFrame:
    """Encode the texts and write them as shards to the shared folder; returns the manifest
    (shard, path, n_docs, n_ids, base), base being the ids of all shards before.

    Shards are ranges of the key, a long, in ascending order (null keys first, documents with
    equal keys by the start of the text; they may lie in several shards, also if they are equal rows). A task that is run again writes a file of another name; the manifest
    names only the files of tasks that ended well. Null texts are encoded as empty ones.
    """
    spark = docs.sparkSession
    ship(spark)
    folder, vocab = new_path(spark, "shards"), vocab or vocab_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # a key that many rows share is cut by the text, and equal rows by their place in the input
    order = ["id", "head", "at"]
    rows = rows.withColumns({"head": F.substring("text", 1, 32), "at": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocab), TaskContext.get().partitionId()
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        uri, out = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids", None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or ShardWriter(uri, width)
            keys = b.column(0)
            out.add(np.asarray(keys.fill_null(0), np.int64), np.asarray(keys.is_null(), bool), *enc.encode(b.column(1), end_id))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([uri]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())],
                ["shard", "path", "n_docs", "n_ids"],
            )

    made = dealt.sortWithinPartitions(*order).select("id", "text").mapInArrow(run, "shard int, path string, n_docs long, n_ids long")
    manifest = materialize(made, "manifest")
    # One row per shard; the sum over those before needs them in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


#: Documents whose ids are read at once.
_READ = 1024


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the shards, found through
    their indexes. start counts the ids of all documents before; ids_crc32 is over the ids as
    little-endian unsigned 32-bit integers."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(uri)
                for lo in range(0, shard.docs, _READ):
                    hi = min(lo + _READ, shard.docs)
                    order = shard.ordinals_of(lo, hi)
                    keys, nulls, first = shard.keys[order], shard.nulls[order], int(order.min())
                    bounds = shard.bounds[first : int(order.max()) + 2].astype(np.int64)
                    ids = shard.ids(first, int(order.max()) + 1)
                    start, end = bounds[order - first], bounds[order - first + 1]
                    cut = [ids[s:e] for s, e in zip((start - bounds[0]).tolist(), (end - bounds[0]).tolist())]
                    out = [
                        pa.array(keys, mask=nulls),
                        pa.array(base + start),
                        pa.array(end - start),
                        pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                    ]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        offsets = np.concatenate([[0], np.cumsum(end - start)])
                        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([ids[:0], *cut]).astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names)

    more = ", ids array<int>" if with_ids else ""
    dealt = manifest.select("path", "base").repartition("path")
    return dealt.mapInArrow(run, f"id long, start long, n_tokens long, ids_crc32 long{more}")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"))
    return read_shards(manifest).withColumnRenamed("id", "doc_id")
