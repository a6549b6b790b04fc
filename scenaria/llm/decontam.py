"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK embedding (Chakraborty, Goldenberg, Koucky 2016) walks along a string and, at every
step, a random bit of the symbol it stands on says whether to move on. Two strings read with the same
random bits fall into step again soon after an edit, so that few edits become few differing
places. Sampling a few places of several walks is then an LSH for edit distance.

An item within ``edits`` edits of a passage has a run of unedited words in common with it
(pigeonhole): documents are scanned for such runs (seeds), each names an item-sized window, and the
windows are embedded. No window that could match is left out by the seeds. Symbols are words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scenaria.llm.common import free_name, mix64, parts, ship, split_words, table

SIMILARITY, SEED_WORDS = 0.8, 3
#: Walks and places sampled of each. With a fifth of the words edited, both places of a walk agree in a share of
#: cases that falls with the length, as walks fall into step again ever later: 0.1 for 150 words, 0.03 for 500, some
#: 14 / words. 0.35 walks a word find 0.99 of all passages; short items have 32.
WALKS, PLACES, WALKS_A_WORD = 32, 2, 0.35
#: Bytes of item text in one index. More items are searched in several blocks, one after another.
BLOCK_BYTES = 8 << 20
AT_ONCE = 8 << 20
_STRIP = ".,;:!?|*#$%&()[]{}<>\"'`~_-+=/\\"
_BITMAP = 22


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and flat 64-bit numbers of the words, in lower case, without punctuation at their
    ends; words of punctuation only are left out."""
    bounds, codes, vocab = split_words(texts)
    plain = pc.utf8_trim(pc.utf8_lower(vocab), characters=_STRIP).to_pylist()
    number = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain))
    there = np.fromiter(map(bool, plain), bool, len(plain))
    keep = there[codes]
    return np.concatenate([[0], np.cumsum(keep)])[bounds], number[codes[keep]]


def allowed(words: int) -> int:
    return int((1 - SIMILARITY) * words + 1e-9)


def seed_size(words: int) -> int:
    """Words in a row that a match of an item of ``words`` words must share unedited."""
    e = allowed(words)
    return max(1, min(SEED_WORDS, (words - e) // (e + 1)))


def _runs(number: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of q numbers."""
    m = max(0, len(number) - q + 1)
    h = np.full(m, q, np.uint64)
    for k in range(q):
        h = mix64(h ^ number[k : k + m], k)
    return h


def walks_of(level: int) -> int:
    """Walks for items of up to 2 ** level words, a multiple of WALKS."""
    return WALKS * max(1, math.ceil(WALKS_A_WORD * (1 << level) / WALKS)) if level > 7 else WALKS


def sampled(symbols: np.ndarray, size: np.ndarray, walks: int = WALKS) -> np.ndarray:
    """The PLACES sampled symbols of ``walks`` embeddings of each row of ``symbols`` (zeros behind size)."""
    n, width = symbols.shape
    u = np.random.default_rng(11).random((walks, PLACES))
    place = (u[None] * 2 * size[:, None, None]).astype(np.int64)
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
    out, row = np.zeros((n, walks, PLACES), np.uint64), np.arange(n)[:, None]
    for first in range(0, walks, WALKS):
        trace = np.zeros((n, WALKS, 2 * width), np.uint64)
        at, walk = np.zeros((n, WALKS), np.int64), np.arange(first, first + WALKS, dtype=np.uint64)[None]
        for j in range(2 * width):
            here = padded[row, np.minimum(at, width)]
            trace[:, :, j] = here
            at += (mix64(here ^ (walk << np.uint64(32)), j) & np.uint64(1)).astype(np.int64)
        out[:, first : first + WALKS] = np.take_along_axis(trace, place[:, first : first + WALKS], axis=2)
    return out


class Index:
    """Items with their seeds and sampled embeddings."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        bounds, number = plain_words(pa.array(texts, pa.string()))
        kept = [k for k in range(len(ids)) if bounds[k + 1] > bounds[k]]
        self.ids = [ids[k] for k in kept]
        self.words = [number[bounds[k] : bounds[k + 1]] for k in kept]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.sample: list[np.ndarray] = [np.zeros((0, PLACES), np.uint64)] * len(kept)
        for level, group in self.by_width(self.size):
            found = sampled(self.padded([self.words[k] for k in group], int(self.size[group].max())), self.size[group], walks_of(level))
            for k, one in zip(group.tolist(), found):
                self.sample[k] = one
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        need = np.array([seed_size(n) for n in self.size], np.int64)
        for q in np.unique(need).tolist():
            own = np.flatnonzero(need == q)
            hashes = [_runs(self.words[k], q) for k in own]
            h = np.concatenate(hashes)
            item = np.repeat(own, [len(x) for x in hashes])
            offset = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITMAP, bool)
            bitmap[(h >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
            self.seeds[q] = h[order], item[order], offset[order], bitmap

    @staticmethod
    def by_width(size: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[int, np.ndarray]]:
        """(level, rows): groups of rows of at most 2 ** level words, each of a bounded number of words."""
        if not len(size):
            return
        level = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for x in np.unique(level):
            rows = np.flatnonzero(level == x)
            step = max(1, most >> int(x))
            for k in range(0, len(rows), step):
                yield int(x), rows[k : k + step]

    @staticmethod
    def padded(words: list[np.ndarray], width: int) -> np.ndarray:
        out = np.zeros((len(words), width), np.uint64)
        for k, w in enumerate(words):
            out[k, : len(w)] = w
        return out

    def windows(self, bounds: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Distinct (document, item, start) that a seed names; start may lie before the document."""
        found = []
        doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for q, (h, item, offset, bitmap) in self.seeds.items():
            runs = _runs(number, q)
            at = np.flatnonzero(bitmap[(runs >> np.uint64(64 - _BITMAP)).astype(np.int64)])
            at = at[doc_of[at] == doc_of[at + q - 1]]
            lo, hi = np.searchsorted(h, runs[at], "left"), np.searchsorted(h, runs[at], "right")
            n = hi - lo
            entry = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            at = np.repeat(at, n)
            doc = doc_of[at]
            found.append(np.stack([doc, item[entry], at - bounds[doc] - offset[entry]], 1))
        return np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)

    def matches(self, bounds: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, start, edits): the best match of each pair."""
        windows = self.windows(bounds, number)
        size = self.size[windows[:, 1]]
        close = np.zeros(len(windows), bool)
        for level, group in self.by_width(size):
            parts = []
            for d, k, s in windows[group]:
                lo, hi = bounds[d], bounds[d + 1]
                a, b = lo + max(s, 0), min(lo + s + self.size[k], hi)
                parts.append(number[a:b])
            got = sampled(self.padded(parts, int(size[group].max())), size[group], walks_of(level))
            own = np.stack([self.sample[k] for k in windows[group, 1].tolist()])
            close[group] = (got == own).all(axis=2).any(axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for d, k, s in windows[close].tolist():
            e = allowed(int(self.size[k]))
            if s - tried.get((d, k), s - e - 2) <= e // 2 and best.get((d, k), (1, 0))[0] == 0:
                continue  # an exact match just before
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            region = number[max(lo, lo + s - e) : min(hi, lo + s + int(self.size[k]) + e)]
            edits = fewest_edits(self.words[k], region)
            tried[d, k] = s
            if edits <= e and edits < best.get((d, k), (e + 1, 0))[0]:
                best[d, k] = edits, max(s, 0)
        return [(d, k, s, e) for (d, k), (e, s) in best.items()]


def fewest_edits(item: np.ndarray, region: np.ndarray) -> int:
    """Edits (words put in, left out or exchanged) from ``item`` to the closest part of ``region``."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for word in item:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (region != word))
        row = np.minimum.accumulate(step - place) + place
    return int(row.min())


def indexes(items: DataFrame, item_col: str, item_text: str) -> Iterator[Broadcast]:
    """The items as broadcast indexes of about BLOCK_BYTES of text each, whatever the benchmark holds."""
    sc = items.sparkSession.sparkContext
    given = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(blocks):
        some = given.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        yield sc.broadcast(Index([r["item"] for r in some], [r["text"] for r in some]))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage close to an item (see ``find_items``)."""
    ship(docs.sparkSession)
    for index in indexes(items, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                for some in parts(b, b.num_columns - 1, AT_ONCE):
                    hit = np.zeros(some.num_rows, bool)
                    hit[[m[0] for m in own.matches(*plain_words(some.columns[-1]))]] = True
                    yield some.filter(pa.array(~hit)).select(range(b.num_columns - 1))

        docs = docs.withColumn(free_name(docs, "__searched"), F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
    return docs


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, item, start, n_edits, n_words, similarity): documents with a passage that is within
    a fifth of an item's words of it; the best passage of each pair. start is its word number.

    Items without words match nothing, and so do null and empty texts. Repeated rows of
    ``docs`` and items come back repeated. Ids may be null.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["id"].dataType, items.schema[item_col].dataType
    item_type = to_arrow_type(item_kind)
    schema = f"id {kind.simpleString()}, item {item_kind.simpleString()}, start long, n_edits long, n_words long"
    found = None
    for index in indexes(items, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                for some in parts(b, 1, AT_ONCE):
                    hits = own.matches(*plain_words(some.column(1)))
                    doc, item, start, edits = (list(x) for x in zip(*hits)) if hits else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column(0).take(pa.array(doc, pa.int64())),
                            pa.array([own.ids[k] for k in item]).cast(item_type),
                            pa.array(start, pa.int64()),
                            pa.array(edits, pa.int64()),
                            pa.array(own.size[np.array(item, np.int64)]),
                        ],
                        ["id", "item", "start", "n_edits", "n_words"],
                    )

        one = rows.mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    return found.withColumn("similarity", 1 - F.col("n_edits") / F.col("n_words"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})
