"""Repeated passages, removed by suffix automata of reference shards.

A window of 35 words that also starts anywhere else goes. To find those windows without comparing
all documents with all others:

1. Every window names an anchor, the run of ANCHOR words with the smallest hash in it. Equal
   windows name the same run, at the same place. Neighbouring windows mostly share their anchor:
   a document is cut into overlapping segments, one per anchor, and each window lies in one.
2. Segments whose anchor occurs once hold no repeated window. Segments that occur twice as a
   whole are all repeated windows. What is left are segments with a common anchor and
   different surroundings: the ends of repeated passages.
3. The different segments of an anchor are a reference shard: a suffix automaton is built over
   their words, with the number of occurrences in each state, and the segments are streamed
   through it. The longest match that occurs at least twice ends behind word i with length l_i
   (matching statistics); the window that ends there is repeated if l_i is at least 35.

The automata are not broadcast: all of them together grow with the corpus, so each goes to the
task that holds its shard, and only segments that can match it are streamed there. An anchor with
very many different segments (a line in a third of all documents) is cut further: its windows
are counted one by one, by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.llm.common import Rolling, materialize, mix64, parts, ship, split_words, table

WINDOW, ANCHOR = 35, 12
#: Different segments of one anchor that go into one automaton.
SHARD = 256
AT_ONCE = 8 << 20


def _numbers(vocab: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocab.to_pylist()), np.uint64, len(vocab))


class Segments:
    """Segments of a text: for each anchor the first window that names it and how many do."""

    def __init__(self, window: int, anchor: int) -> None:
        self.window, self.anchor, self.rolling = window, anchor, Rolling()

    def cut(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first, count, anchor hash, segment hash, and the prefix sums they were made from."""
        prefix = self.rolling.prefix(number)
        n = len(number) - self.window + 1
        if n <= 0:
            return (*(np.zeros(0, np.int64),) * 4, prefix)
        start = np.arange(len(number) - self.anchor + 1)
        runs = self.rolling.runs(prefix, start, start + self.anchor)
        at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(runs, self.window - self.anchor + 1).argmin(axis=1)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, n])
        whole = self.rolling.runs(prefix, first, first + count + self.window - 1)
        # where the anchor lies within the segment is part of the segment
        whole = mix64(whole ^ (at[first] - first).astype(np.uint64), 1)
        return first, count, runs[at[first]].view(np.int64), whole.view(np.int64), prefix


def _segment_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(row, first, count, anchor, seg) of every segment of ``docs`` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(window, anchor)
        for b in batches:
            for part in parts(b, 1, AT_ONCE):
                bounds, codes, vocab = split_words(part.column(1))
                number = _numbers(vocab)[codes]
                found = [segments.cut(number[lo:hi])[:4] for lo, hi in zip(bounds[:-1], bounds[1:])]
                row = np.repeat(np.asarray(part.column(0)), [len(f[0]) for f in found])
                columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), *(pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64, np.int64)))],
                    ["row", "first", "count", "anchor", "seg"],
                )

    return docs.mapInArrow(run, "row long, first int, count int, anchor long, seg long")


class Automaton:
    """Suffix automaton of several word sequences, each with a number of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.times.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A copy of q for the strings that are only as long as p's and the symbol."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, symbols: list[int], times: int) -> None:
        last = 0
        for s in symbols:
            p = last
            q = self.next[p].get(s)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, s)
            else:
                last = self._state(self.length[p] + 1, 0, {})
                while p >= 0 and s not in self.next[p]:
                    self.next[p][s] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][s]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, s)
            self.times[last] += times

    def count(self) -> None:
        """Occurrences of each state's strings, from the longest down."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.times[self.link[v]] += self.times[v]

    def repeated(self, symbols: list[int]) -> list[int]:
        """For each position the length of the longest match that ends there and occurs twice."""
        out, v, n = [], 0, 0
        for s in symbols:
            while v and s not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if s in self.next[v]:
                v, n = self.next[v][s], n + 1
            w, m = v, n
            while w and self.times[w] < 2:
                w = self.link[w]
                m = self.length[w]
            out.append(m)
        return out


def shard_matches(words: list[str], times: list[int], window: int) -> list[list[int]]:
    """Offsets of the windows of each segment that occur at least twice in the shard."""
    code: dict[str, int] = {}
    sequences = [[code.setdefault(w, len(code)) for w in s.split("\x00")] for s in words]
    automaton = Automaton()
    for sequence, n in zip(sequences, times):
        automaton.add(sequence, n)
    automaton.count()
    return [[i - window + 1 for i, m in enumerate(automaton.repeated(s)) if m >= window] for s in sequences]


def _fetched(docs: DataFrame, wanted: DataFrame, window: int, anchor: int) -> DataFrame:
    """The words of chosen segments: (anchor, seg, times, hot, offset, words or hash). ``wanted`` has
    (row, first, count, anchor, seg, times, hot). Segments of hot anchors come as one row per window."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "count", "anchor", "seg", "times", "hot")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            for part in parts(b, 0, AT_ONCE):
                bounds, codes, vocab = split_words(part.column(0))
                number, words, out = _numbers(vocab), vocab.to_pylist(), []
                for lo, hi, want in zip(bounds[:-1], bounds[1:], part.column(1).to_pylist()):
                    own, prefix = codes[lo:hi], None
                    for w in want:
                        first, count = w["first"], w["count"]
                        head = (w["anchor"], w["seg"], w["times"], w["hot"])
                        if not w["hot"]:
                            text = "\x00".join([words[c] for c in own[first : first + count + window - 1].tolist()])
                            out.append((*head, 0, text, None, None))
                            continue
                        if prefix is None:
                            prefix = rolling.prefix(number[own])
                            other = rolling.prefix(mix64(number[own], 5))
                        at = np.arange(first, first + count)
                        one = rolling.runs(prefix, at, at + window).view(np.int64).tolist()
                        two = rolling.runs(other, at, at + window).view(np.int64).tolist()
                        out += [(*head, k, None, x, y) for k, (x, y) in enumerate(zip(one, two))]
                names = ["anchor", "seg", "times", "hot", "off", "words", "h1", "h2"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    rows = docs.join(lists, "row").select("text", "wanted")
    return rows.mapInArrow(
        run, "anchor long, seg long, times long, hot boolean, off int, words string, h1 long, h2 long"
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, starts): the starts of the windows of each document of ``docs`` (row, text) that
    occur more than once in all of them; documents without any are left out."""
    ship(docs.sparkSession)
    found = materialize(_segment_rows(docs, window, anchor), "segments")
    # Counts are written before they are joined: with a plain table on either side Spark can split
    # the rows of a hot anchor over tasks.
    often = materialize(found.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "often")
    common = materialize(found.join(often, "anchor", "left_semi"), "common")
    kinds = common.groupBy("anchor", "seg").agg(
        F.count("*").alias("times"), F.min(F.struct("row", "first")).alias("at"), F.max("count").alias("count")
    )
    kinds = materialize(kinds, "kinds")
    # Kinds that occur twice as a whole are repeated throughout; they are in a shard only as a
    # reference for those that occur once.
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("times").alias("least"))
    shards = materialize(sizes.filter("n > 1 and least = 1").drop("least"), "shards")
    needed = kinds.join(shards, "anchor")
    wanted = needed.select("at.row", "at.first", "count", "anchor", "seg", "times", (F.col("n") > SHARD).alias("hot"))
    fetched = materialize(_fetched(docs, wanted, window, anchor), "fetched")

    groups = (
        fetched.filter("not hot").groupBy("anchor").agg(F.collect_list(F.struct("seg", "times", "words")).alias("shard"))
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for key, shard in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = shard_matches([s["words"] for s in shard], [s["times"] for s in shard], window)
                for s, offsets in zip(shard, hits):
                    if s["times"] == 1 and offsets:
                        out[0].append(key)
                        out[1].append(s["seg"])
                        out[2].append(offsets)
            kinds_ = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds_)], ["anchor", "seg", "offsets"])

    by_automaton = groups.mapInArrow(stream, "anchor long, seg long, offsets array<int>")
    hot = fetched.filter("hot")
    twice = hot.groupBy("h1", "h2").agg(F.sum("times").alias("c")).filter("c > 1").select("h1", "h2")
    by_hash = (
        hot.filter("times = 1").join(twice, ["h1", "h2"], "left_semi").groupBy("anchor", "seg").agg(F.collect_list("off").alias("offsets"))
    )
    whole = kinds.filter("times > 1").select("anchor", "seg", F.sequence(F.lit(0), F.col("count") - 1).alias("offsets"))
    decided = whole.union(by_automaton).union(by_hash)
    return (
        common.join(decided, ["anchor", "seg"])
        .select("row", F.transform("offsets", lambda x: x + F.col("first")).alias("starts"))
        .groupBy("row")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of ``window`` words around it also starts anywhere else, in the same
    document or another; all windows are judged on the input. Null texts have no words; shorter
    texts keep all; repeated rows are documents of their own and repeat each other; ids may be null.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Equal rows share a number; that is no loss, as they have equal windows and a decision in common.
    numbered = rows.withColumn("row", F.xxhash64("id", F.xxhash64("text"), "text"))
    starts = repeated_windows(numbered.select("row", "text"), window, anchor)
    joined = numbered.join(starts, "row", "left").select("id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1, AT_ONCE):
                bounds, codes, vocab = split_words(part.column(1))
                words, lists = vocab.to_pylist(), part.column(2)
                n, removed, kept = [], [], []
                for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = codes[lo:hi]
                    if lists[k].is_valid:
                        at = np.asarray(lists[k].values)
                        edge = np.bincount(at, minlength=len(own) + 1) - np.bincount(np.minimum(at + window, len(own)), minlength=len(own) + 1)
                        own = own[np.cumsum(edge)[: len(own)] == 0]
                    n.append(hi - lo)
                    removed.append(hi - lo - len(own))
                    kept.append(" ".join([words[c] for c in own.tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["id", "n_words", "n_removed", "kept"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256 of the kept words) of each text, over a dictionary of all
    windows; for tests."""
    docs = [(t or "").encode().split() for t in texts]
    seen: dict[bytes, int] = {}
    keys = [[b" ".join(d[k : k + window]) for k in range(len(d) - window + 1)] for d in docs]
    for one in keys:
        for key in one:
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d, one in zip(docs, keys):
        gone = set()
        for k, key in enumerate(one):
            if seen[key] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(d) if k not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
