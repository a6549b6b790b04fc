"""Collocations by SON partitioning.

The texts are dealt into shards of SHARD bytes. Each shard is mined completely, level by level, for
the phrases that reach its share of the support (``least`` times its part of the language's
bytes, rounded up). A phrase that reaches ``least`` overall does so in one shard at least, so the
union of what the shards found holds every frequent phrase; phrases that cannot reach ``least`` even if all other
shards have them just below their local support leave it, and a second pass counts the rest exactly, as texts.

The share shrinks as shards grow in number, to one occurrence at last. What keeps the union from becoming
everything are two passes before it, over hashes of words and of pairs of words: a frequent phrase
holds no word and no pair below ``least``. What a phrase has in the shards of one task is added up, in bounded
memory, before it is sent. Sets of hashes travel as bit filters of a fixed largest
size; one that is too full lets more phrases be counted, and loses none. So each pass sends at most a few rows for a
word of text, whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenaria.llm.common import give_back, materialize, mix64, parts, ship, table

LONGEST, LEAST, FIRST, COVERED = 5, 100, 2000, 100
#: Bytes of text of a shard, and those that are taken apart at once.
SHARD, AT_ONCE = 9 << 20, 4 << 20
#: Rows of counts that a task adds up before it sends them on.
POOL = 1 << 18
#: Bits of a filter: 16 for each hash, between these powers of 2 (32 MB at most).
FEWEST_BITS, MOST_BITS = 20, 28
#: Slices of a language for the first ranking.
SLICES = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words of the texts in a row (as bytes, A-Z in lower case), whether each starts a piece, and the number of
    words of each text. Null texts count as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[data]
    inside = kind == 0
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    start = np.flatnonzero(start)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    size = np.flatnonzero(last) - start + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    piece = np.searchsorted(np.flatnonzero(kind == 2), start) + np.searchsorted(ends, start, side="right")
    fresh = np.ones(len(start), bool)
    fresh[1:] = piece[1:] != piece[:-1]
    return flat.dictionary_encode(), fresh, np.diff(np.searchsorted(start, ends))


@dataclass
class Shard:
    """Words of a shard as numbers: ``ids`` and whether each starts a piece; of each number its language, text and hash."""

    ids: np.ndarray
    fresh: np.ndarray
    lang: np.ndarray
    word: pa.Array
    hashes: np.ndarray
    langs: list[str]
    bytes_of: np.ndarray
    total_of: list[int]

    def least(self, support: int) -> np.ndarray:
        """The local support of each language: its share of ``support`` by bytes, rounded up."""
        return np.array([max(1, -(-support * int(b) // max(1, t))) for b, t in zip(self.bytes_of, self.total_of)], np.int64)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """Shards of about ``size`` bytes from rows (lang, total, text); total: bytes of the language in the whole table."""
    held: list[tuple] = []
    known: dict[str, tuple[int, int]] = {}
    bytes_of: dict[int, int] = {}
    got = 0

    def take() -> Shard:
        words = pa.chunked_array([w for w, _, _ in held]).unify_dictionaries()
        vocab = words.chunk(0).dictionary
        pair = np.concatenate([g * len(vocab) + np.asarray(c.indices) for c, (_, _, g) in zip(words.chunks, held)])
        if len(known) * len(vocab) <= 8 * len(pair):
            there = np.zeros(len(known) * len(vocab), bool)
            there[pair] = True
            ids = (np.cumsum(there, dtype=np.int32) - 1)[pair]
            pair = np.flatnonzero(there)
        else:
            pair, ids = np.unique(pair, return_inverse=True)
        lang, code = pair // max(1, len(vocab)), pair % max(1, len(vocab))
        word = vocab.take(pa.array(code))
        digest = xxhash.xxh3_64_intdigest
        names = np.array([digest(n.encode()) for n in known], np.uint64)
        plain = np.fromiter((digest(w.as_buffer()) for w in word), np.uint64, len(word))
        hashes = mix64(plain ^ mix64(names[lang], 1), 2) if len(word) else plain
        sizes = np.array([bytes_of.get(k, 0) for k in range(len(known))])
        return Shard(ids.astype(np.int32, copy=False), np.concatenate([f for _, f, _ in held]), lang, word, hashes, list(known), sizes, [t for _, t in known.values()])

    for b in (part for batch in batches for part in parts(batch, 2, min(AT_ONCE, size))):
        words, fresh, n = words_of(b.column(2))
        for name, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            known.setdefault(name, (len(known), total))
        lang = np.array([known[name][0] for name in b.column(0).to_pylist()], np.int64)
        length = np.asarray(pc.fill_null(pc.binary_length(b.column(2)), 0), np.int64)
        for k in np.unique(lang):
            bytes_of[int(k)] = bytes_of.get(int(k), 0) + int(length[lang == k].sum())
        held.append((words, fresh, np.repeat(lang, n)))
        got += int(length.sum())
        if got >= size:
            shard = take()
            held, known, bytes_of, got = [], {}, {}, 0
            yield shard
            del shard
            give_back()
    if held:
        yield take()


@dataclass
class Level:
    """The different phrases of one length: word numbers (one row a phrase), occurrences, hash."""

    words: np.ndarray
    count: np.ndarray
    hashes: np.ndarray

    def some(self, ok: np.ndarray) -> Level:
        return Level(self.words[ok], self.count[ok], self.hashes[ok])


def levels(shard: Shard, accept: Callable[[int, Level], np.ndarray], longest: int) -> Iterator[Level]:
    """The accepted phrases of 1 to ``longest`` words. A phrase is looked at if what is left of it without its first
    and without its last word was accepted."""
    n = len(shard.ids)
    first = Level(np.arange(len(shard.lang), dtype=np.int32)[:, None], np.bincount(shard.ids, minlength=len(shard.lang)), shard.hashes)
    ok = accept(1, first)
    level = first.some(ok)
    yield level
    word_of, width = np.flatnonzero(ok).astype(np.int32), max(1, int(ok.sum()))
    last_word = at = _numbers(ok)[shard.ids]
    for k in range(2, longest + 1):
        start = (at[:-1] >= 0) & (at[1:] >= 0)
        if k == 2:
            start &= ~shard.fresh[1:]
        start = np.flatnonzero(start[: max(0, n - k + 1)])
        key, back, count = np.unique(at[start] * np.int64(width) + last_word[start + k - 1], return_inverse=True, return_counts=True)
        head, tail = key // width, word_of[key % width]
        del key
        level = Level(np.column_stack([level.words[head], tail]), count, mix64(level.hashes[head] ^ mix64(shard.hashes[tail], k), k))
        ok = accept(k, level)
        level = level.some(ok)
        yield level
        at = np.full(n, -1, np.int32)
        at[start] = _numbers(ok)[back]


def _numbers(ok: np.ndarray) -> np.ndarray:
    """Place of each accepted row among the accepted ones, -1 for the others."""
    return np.where(ok, np.cumsum(ok, dtype=np.int32) - 1, -1).astype(np.int32)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter holds both places of each hash."""
    mask = np.uint64(len(bits) * 64 - 1)
    ok = np.ones(len(hashes), bool)
    for place in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        ok &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def bit_filter(hashes: DataFrame) -> Broadcast:
    """The rows of ``hashes`` (h) as a filter of two places each, of bounded size."""
    sc = hashes.sparkSession.sparkContext
    power = min(MOST_BITS, max(FEWEST_BITS, (16 * hashes.count()).bit_length()))
    place = F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")
    place = hashes.select(place).select(F.col("p").bitwiseAND(F.lit((1 << power) - 1)).alias("p"))
    found = place.groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got = found.toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[np.asarray(got["at"], np.int64)] = np.asarray(got["bits"], np.int64).view(np.uint64)
    return sc.broadcast(bits)


def pooled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with equal columns but for ``n`` as one, their n added up. ``most`` new rows are added at once; what is
    held is sent on when it is more than twice that."""
    held: list[pa.RecordBatch] = []
    new = 0

    def together() -> pa.Table:
        rows = pa.Table.from_batches(held)
        return rows.group_by([c for c in rows.column_names if c != "n"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(rows.column_names)

    for b in batches:
        held.append(b)
        new += b.num_rows
        if new >= most:
            rows, new = together(), 0
            held = rows.to_batches()
            if rows.num_rows > 2 * most:
                yield from held
                held = []
            del rows
            give_back()
    if held:
        yield from together().to_batches(max_chunksize=1 << 17)


def _hash_counts(rows: DataFrame, longest: int, accept: Callable[[int, Level], np.ndarray], size: int) -> DataFrame:
    """(h, n) of the phrases of ``longest`` words in each shard, while ``accept`` holds for shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            for level in levels(shard, accept, longest):
                pass
            yield pa.RecordBatch.from_arrays([pa.array(level.hashes.view(np.int64)), pa.array(level.count, pa.int64())], ["h", "n"])

    return rows.mapInArrow(run, "h long, n long")


def _frequent(counts: DataFrame, least: int) -> Broadcast:
    return bit_filter(materialize(counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"), "hashes"))


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """(lang, k, phrase, n): every phrase of 1 to ``longest`` words with ``least`` occurrences or more in its language, and
    for each language a row with k = 0, a null phrase and all its word occurrences."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    totals = materialize(given.groupBy("lang").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("total")), "bytes")
    whole = totals.agg(F.sum("total")).first()[0] or 0
    # a shard is SHARD bytes however the input is cut: its share of the support must not depend on that
    tasks = max(1, math.ceil(whole / size))
    given = given.join(totals, "lang").select("lang", "total", "text")
    rows = given.coalesce(tasks)
    # one task for each core takes its shards one by one, so that a phrase is sent once a task and not once a shard
    few = given.coalesce(min(tasks, spark.sparkContext.defaultParallelism))

    all_of = lambda k, level: np.ones(len(level.count), bool)
    words = _frequent(_hash_counts(rows, 1, all_of, size), least)
    in_words = lambda k, level: holds(words.value, level.hashes) if k == 1 else all_of(k, level)
    pairs = _frequent(_hash_counts(rows, 2, in_words, size), least)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            local = shard.least(least)

            def accept(k: int, level: Level, shard=shard, local=local) -> np.ndarray:
                ok = level.count >= local[shard.lang[level.words[:, 0]]]
                return ok & holds((words if k == 1 else pairs).value, level.hashes) if k <= 2 else ok

            names = pa.array(shard.langs, pa.string())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), names, pa.array(local - 1)], ["h", "lang", "n"])
            for level in levels(shard, accept, longest):
                lang = shard.lang[level.words[:, 0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(level.hashes.view(np.int64)), names.take(pa.array(lang)), pa.array(level.count - (local - 1)[lang])], ["h", "lang", "n"]
                )

    # A shard that doesn't report a phrase has its local support less one of it at most. So what the others have above
    # that must make up for the rest, or the phrase can't reach the support.
    mined = materialize(few.mapInArrow(lambda batches: pooled(mine(batches), POOL), "h long, lang string, n long"), "mined")
    most = mined.filter("h is null").groupBy("lang").agg((F.lit(least) - F.sum("n")).alias("missing"))
    above = mined.filter("h is not null").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    found = above.join(materialize(most, "missing"), "lang").filter(F.col("n") >= F.col("missing")).select("h")
    union = bit_filter(materialize(found.distinct(), "candidates"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            names = pa.array(shard.langs, pa.string())
            for k, level in enumerate(levels(shard, lambda k, level: holds(union.value, level.hashes), longest), 1):
                for at in range(0, len(level.count), 1 << 17):
                    some = level.words[at : at + (1 << 17)]
                    texts = [shard.word.take(pa.array(column)) for column in some.T]
                    phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())) if k > 1 else texts[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            names.take(pa.array(shard.lang[some[:, 0]])),
                            pa.array(np.full(len(some), k, np.int32)),
                            phrase.cast(pa.large_string()).cast(pa.string()),
                            pa.array(level.count[at : at + (1 << 17)], pa.int64()),
                        ],
                        ["lang", "k", "phrase", "n"],
                    )
            of_lang = np.bincount(shard.lang[shard.ids], minlength=len(names)) if len(shard.ids) else np.zeros(len(names), np.int64)
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.zeros(len(names), np.int32)), pa.nulls(len(names), pa.string()), pa.array(of_lang, pa.int64())], ["lang", "k", "phrase", "n"]
            )

    counted = few.mapInArrow(lambda batches: pooled(count(batches), POOL), "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("k") == 0) | (F.col("n") >= least))


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, k, phrase, words, a, l, r, n, score) of the phrases of two words and more, by their lowest-scoring cut."""
    total = frequent.filter("k = 0").select("lang", F.col("n").alias("all"))
    of = frequent.filter("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    found = frequent.filter("k > 1").select("lang", "k", "phrase", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    head, tail = F.array_join(F.slice("words", F.lit(1), F.col("cut")), " "), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " ")
    cuts = cuts.select("*", head.alias("head"), tail.alias("tail"))
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(total, "lang")
    exact = F.expr("(1000 * cast(a as decimal(20,0)) * cast(all as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(exact.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "k", "phrase", "words", "a", "all").agg(best).select("lang", "k", "phrase", "words", "a", "best.l", "best.r", F.col("all").alias("n"), "best.score")


def not_covered(phrases: DataFrame, percent: int) -> DataFrame:
    """``phrases`` without those inside a longer one that has ``percent`` of their occurrences or more."""
    inner = phrases.filter("k > 2").select("lang", "words", "k", "a", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "words", "a", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = phrases.join(longer, ["lang", "phrase"], "left")
    return rows.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame, least: int = LEAST, first: int = FIRST, percent: int = COVERED, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", size: int = SHARD
) -> DataFrame:
    """The ``first`` phrases of each language by score, occurrences and text: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``; null and blank texts have no words, repeated rows count as often
    as they occur, no language without a phrase has a row, and an empty table gives none. Columns other than
    language and text are not read.
    """
    found = not_covered(scored(materialize(frequent_phrases(docs, least, longest, lang_col, text_col, size), "frequent")), percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of a language are among the first of its slices, so that no task ranks a whole language
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= first)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return sliced.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT unnest(range(1, 6)) AS k),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS at FROM worded, sizes),
f AS (SELECT lang, k, array_to_string(w[at:at + k - 1], ' ') AS phrase, count(*) AS n FROM places GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 100),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
cut_scores AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.n AS l, r.n AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_sizes AS (SELECT lang, w, k, a, unnest(range(2, k)) AS size FROM cand),
inner_places AS (SELECT *, unnest(range(1, k - size + 2)) AS at FROM inner_sizes),
longer AS (SELECT lang, array_to_string(w[at:at + size - 1], ' ') AS phrase, max(a) AS most FROM inner_places GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.most IS NULL OR 100 * x.most < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
