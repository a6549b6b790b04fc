"""Scores of texts under a Brown class-based bigram model.

P(word | word before) = P(class | class before) * P(word | class). Exchange clustering assigns the classes:

1. Frequent words (a 1 / HEAD share of the tokens of a block of text or more; the HEAD most frequent of them) and
   the counts of their pairs, in all blocks, are exchanged between classes one word at a time, each
   to the class with the largest likelihood, until a sweep moves none.
2. Every other word of the training texts goes to the class with the largest gain of likelihood, from all its
   neighbours among the frequent words, counted over all texts.

Texts are encoded in blocks with a lexicon each (one row for a word of a block), so what is shuffled by word is
the lexicons. What is known of a word then comes back to the blocks that have it, and a block is scored with its
own lexicon alone: the vocabulary is never in one place.

Words not in the training texts are one type of one class. Its probability after a class is what words that
occur once take there; words once seen also say what follows an unknown word. So the model's probabilities of all
known words and of the unknown type sum to 1 after each class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scenaria.llm.collocations import bit_filter, holds
from scenaria.llm.common import give_back, materialize, parts, ship, split_words, table

CLASSES, HEAD, SWEEPS = 32, 4096, 12
#: Bytes of text of a block, and those that are taken apart at once.
BLOCK, AT_ONCE = 32 << 20, 8 << 20
#: Rows of lexicons for a task that assigns classes; blocks whose rows of a word are merged at once.
SHARD_ROWS, MERGED = 200_000, 4096
#: Pseudo-counts: of the base score, and of transitions.
ADD, PRIOR = 0.1, 10.0
#: Mark of a word that occurs once in the training texts, in a sequence of classes.
ONCE = 64


def _f(x: np.ndarray) -> np.ndarray:
    """x log x."""
    return x * np.log(np.maximum(x, 1))


def exchange(left: np.ndarray, right: np.ndarray, count: np.ndarray, words: int, classes: int) -> np.ndarray:
    """Classes of words 0..words-1 (ordered by frequency) from counts of pairs; number ``words`` is the end of a
    text, a class of its own. The first words have a class each, the others come in one at a time; then words move one
    at a time, each to the class with the largest likelihood."""
    ends = classes + 1
    of = np.append(np.arange(words), classes)
    of[:-1][of[:-1] >= classes] = ends  # not in yet: counts of its pairs wait in a last row and column
    both = np.zeros((classes + 2, classes + 2))
    np.add.at(both, (of[left], of[right]), count)
    both = both[:ends, :ends].copy()
    by_right, by_left = np.argsort(right, kind="stable"), np.argsort(left, kind="stable")
    at_right = np.searchsorted(right[by_right], np.arange(words + 1))
    at_left = np.searchsorted(left[by_left], np.arange(words + 1))
    for _ in range(SWEEPS):
        moved = 0
        for w in range(words):
            before, after = by_right[at_right[w] : at_right[w + 1]], by_left[at_left[w] : at_left[w + 1]]
            own = count[before[left[before] == w]].sum()
            before, after = before[left[before] != w], after[right[after] != w]
            a = np.bincount(of[left[before]], count[before], ends + 1)[:ends]
            b = np.bincount(of[right[after]], count[after], ends + 1)[:ends]
            old = of[w]
            if old < ends:
                both[:, old] -= a
                both[old, :] -= b
                both[old, old] -= own
            same = both.diagonal()[:classes]
            gain = (_f(both[:, :classes] + a[:, None]) - _f(both[:, :classes])).sum(0) + (_f(both[:classes] + b) - _f(both[:classes])).sum(1)
            gain += _f(same + a[:classes] + b[:classes] + own) + _f(same) - _f(same + a[:classes]) - _f(same + b[:classes])
            for total, more in ((both.sum(0)[:classes], a.sum() + own), (both.sum(1)[:classes], b.sum() + own)):
                gain -= _f(total + more) - _f(total)
            new = int(gain.argmax())
            new = old if old < ends and gain[new] <= gain[old] + 1e-9 else new
            both[:, new] += a
            both[new, :] += b
            both[new, new] += own
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of[:words]


def log_likelihood(left: np.ndarray, right: np.ndarray, count: np.ndarray, of: np.ndarray) -> float:
    """The part of the log-likelihood of the pairs that depends on the classes ``of``."""
    both = np.zeros((of.max() + 1, of.max() + 1))
    np.add.at(both, (of[left], of[right]), count)
    return float(_f(both).sum() - _f(both.sum(0)).sum() - _f(both.sum(1)).sum())


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Blocks of texts (id, held, text): ids, held, codes of the words, bounds of the texts, distinct words."""
    ids, held, codes, counts, got = [], [], [], [], 0

    def take() -> tuple:
        words = pa.chunked_array(codes).unify_dictionaries()
        flat = np.concatenate([np.asarray(c.indices, np.int32) for c in words.chunks])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
        return pa.concat_arrays(ids), np.concatenate(held), flat, bounds, words.chunk(0).dictionary

    give_back()
    for b in (part for batch in batches for part in parts(batch, 2, min(AT_ONCE, size))):
        bounds, flat, vocab = split_words(pc.ascii_lower(b.column(2)))
        ids.append(b.column(0))
        held.append(np.asarray(b.column(1), bool))
        codes.append(pa.DictionaryArray.from_arrays(pa.array(flat.astype(np.int32)), vocab.cast(pa.large_string())))
        counts.append(np.diff(bounds))
        got += pc.sum(pc.binary_length(b.column(2))).as_py() or 0
        if got >= size:
            yield take()
            ids, held, codes, counts, got = [], [], [], [], 0
            give_back()
    if ids:
        yield take()


def _sequence(codes: np.ndarray, bounds: np.ndarray, some: np.ndarray, end: int) -> np.ndarray:
    """The codes of the texts ``some`` in a row, each followed by ``end``."""
    full = np.insert(codes, bounds[1:], end)
    return full[np.repeat(some, np.diff(bounds) + 1)]


def _head_pairs(texts: DataFrame, head: int, size: int) -> DataFrame:
    """(a, b, n): counts over all training texts of pairs whose words are frequent in a block or more; the empty word is the end
    of a text, a null ``a`` any other word, so that the counts of a word ``b`` add up to its occurrences.

    Which words are frequent is known from all blocks before pairs are counted (a word with a share of 1 / ``head`` of all tokens has it in
    a block at least). They travel as a bit filter of bounded size, which may let a few more words be counted.
    """

    size = min(size, AT_ONCE)  # smaller blocks name more words, and take less memory

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, codes, bounds, vocab in _tokens(batches, size):
            s = _sequence(codes, bounds, ~held, len(vocab))
            count = np.bincount(s, minlength=len(vocab) + 1)[: len(vocab)]
            yield pa.RecordBatch.from_arrays([vocab.filter(pa.array((count > 0) & (count * head >= len(s)))).cast(pa.string())], ["word"])

    hashes = texts.mapInArrow(frequent, "word string").select(F.xxhash64("word").alias("h")).distinct()
    some = bit_filter(materialize(hashes, "frequent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, codes, bounds, vocab in _tokens(batches, size):
            words = len(vocab)
            s = _sequence(codes, bounds, ~held, words)
            if not len(s):
                continue
            known = np.append(holds(some.value, np.fromiter((xxhash.xxh64_intdigest(w.as_buffer(), 42) for w in vocab), np.uint64, words)), True)
            other = int(known.sum())
            number = np.where(known, np.cumsum(known) - 1, other)[s]
            before = np.concatenate([[other - 1], number[:-1]])  # the end is the last known one
            ok = number < other
            pair, n = np.unique(before[ok] * (other + 1) + number[ok], return_counts=True)
            names = pa.concat_arrays([vocab, pa.array([""], pa.large_string())]).take(pa.array(np.flatnonzero(known))).cast(pa.string())
            names = pa.concat_arrays([names, pa.nulls(1, pa.string())])
            a, b = (names.take(pa.array(x)) for x in np.divmod(pair, other + 1))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(n, pa.int64())], ["a", "b", "n"])

    return texts.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def head_classes(texts: DataFrame, classes: int, head: int, size: int) -> tuple[dict[str, int], np.ndarray]:
    """Classes of the frequent words, and the counts of pairs of their classes (the last one is the end of a text).

    At most ``head`` words and head ** 2 pairs whatever the texts hold; the exchange runs in one task. All other words
    get their classes from :func:`word_classes`.
    """
    pairs = materialize(_head_pairs(texts, head, size), "pairs")
    frequent = pairs.filter("b <> ''").groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "word").limit(head)
    names = {r.word: k for k, r in enumerate(frequent.collect())}
    words = len(names)
    known = texts.sparkSession.sparkContext.broadcast(pa.array([*names, ""], pa.string()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (pc.index_in(b.column(k), known.value) for k in (0, 1))
            ok = pc.and_(left.is_valid(), right.is_valid())
            yield pa.RecordBatch.from_arrays([left, right, b.column(2)], ["a", "b", "n"]).filter(ok)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches], pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
        left, right, n = (np.asarray(rows[c]) for c in ("a", "b", "n"))
        order = np.lexsort((right, left))
        left, right, n = left[order], right[order], n[order].astype(float)
        of = np.append(exchange(left, right, n, words, classes), classes)
        both = np.zeros((classes + 1, classes + 1))
        np.add.at(both, (of[left], of[right]), n)
        yield pa.RecordBatch.from_arrays([pa.array([of.tolist()], pa.list_(pa.int32())), pa.array([both.ravel().tolist()])], ["of", "both"])

    got = pairs.select("a", "b", "n").mapInArrow(numbered, "a int, b int, n long").coalesce(1).mapInArrow(cluster, "of array<int>, both array<double>").first()
    return dict(zip(names, got.of)), np.array(got.both).reshape(classes + 1, classes + 1)


_LEXICON = "code int, word string, n long, slots array<int>, counts array<int>"


def _encoded(texts: DataFrame, head: dict[str, int], classes: int, size: int) -> DataFrame:
    """Texts as codes, and lexicon rows: a word of a block, its occurrences in training texts, and how often a frequent word of
    each class stands before it (slots 0 to ``classes``) and after it (the next ones)."""
    kind = texts.schema["id"].dataType
    known = texts.sparkSession.sparkContext.broadcast((pa.array([*head], pa.string()), np.array([*head.values()], np.int64)))
    arrow = to_arrow_type(kind)
    width = 2 * classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of = known.value
        block = TaskContext.get().partitionId() << 32
        for ids, held, codes, bounds, vocab in _tokens(batches, size):
            words = len(vocab)
            at = np.asarray(pc.fill_null(pc.index_in(vocab.cast(pa.string()), names), -1), np.int64)
            kind_ = np.int32 if (words + 1) * width < 1 << 31 else np.int64
            cls = np.append(np.where(at >= 0, of[at] if len(of) else 0, -1), classes).astype(kind_)
            edge = lambda x: np.array([x], kind_)
            s = _sequence(codes, bounds, ~held, words)
            n = np.bincount(s, minlength=words + 1)[:words]
            before, after = (np.concatenate([edge(classes), cls[s[:-1]]]), np.concatenate([cls[s[1:]], edge(-1)])) if len(s) else (s, s)
            open_ = cls[s] < 0
            keys = [s[ok].astype(kind_) * width + more + side[ok] for side, more in ((before, 0), (after, classes + 1)) for ok in [open_ & (side >= 0)]]
            del before, after, open_, s
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            del keys
            cut = np.searchsorted(key, np.arange(words + 1) * width).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, pa.int32()))
            full = lambda m: pa.array(np.full(m, block))
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [full(words), pa.nulls(words, arrow), pa.nulls(words, pa.bool_()), pa.nulls(words, pa.list_(pa.int32())), pa.array(np.arange(words), pa.int32())]
                + [vocab.cast(pa.string()), pa.array(n, pa.int64()), lists(key % width), lists(times)],
                fields,
            )
            texts_of = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes, pa.int32()))
            none = [pa.nulls(m, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([full(m), ids.cast(arrow), pa.array(held), texts_of, *none], fields)
            block += 1

    fields = ["block", "id", "held", "codes", "code", "word", "n", "slots", "counts"]
    return texts.mapInArrow(run, f"block long, id {kind.simpleString()}, held boolean, codes array<int>, {_LEXICON}")


def _merged(rows: pa.Table, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their occurrences, and their entries: bounds, slots, counts."""
    coded = rows["word"].combine_chunks().dictionary_encode()
    code = np.asarray(coded.indices, np.int64)
    n = np.bincount(code, np.asarray(rows["n"]), len(coded.dictionary)).astype(np.int64)
    lists = rows["slots"].combine_chunks()
    owner = np.repeat(code, np.asarray(pc.list_value_length(lists)))
    slots, counts = np.asarray(lists.flatten()), np.asarray(rows["counts"].combine_chunks().flatten())
    key, back = np.unique(owner * width + slots, return_inverse=True)
    return coded.dictionary, n, np.searchsorted(key, np.arange(len(n) + 1) * width), key % width, np.bincount(back, counts, len(key)).astype(np.int64)


def best_classes(bounds: np.ndarray, slots: np.ndarray, counts: np.ndarray, both: np.ndarray, classes: int) -> np.ndarray:
    """For each word the class with the largest gain of likelihood from its entries; without entries class 0."""
    words = len(bounds) - 1
    gain = np.zeros((words, classes))
    owner = np.repeat(np.arange(words), np.diff(bounds))
    is_left = slots <= classes
    for lo in range(0, len(slots), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        cells = np.where(is_left[part, None], both[:, :classes][np.minimum(slots[part], classes)], both[:classes].T[np.maximum(slots[part] - classes - 1, 0)])
        more = _f(cells + counts[part, None]) - _f(cells)
        first = np.flatnonzero(np.r_[True, np.diff(owner[part]) > 0])
        gain[owner[part][first]] += np.add.reduceat(more, first)
    for totals, side in ((both.sum(0)[:classes], is_left), (both.sum(1)[:classes], ~is_left)):
        n = np.bincount(owner, counts * side, words)
        for lo in range(0, words, 1 << 16):
            gain[lo : lo + (1 << 16)] -= _f(totals + n[lo : lo + (1 << 16), None]) - _f(totals)
    return gain.argmax(1)


def word_classes(lexicons: DataFrame, head: dict[str, int], both: np.ndarray, classes: int) -> DataFrame:
    """(word, c, class) of every word of the training texts from the rows (block, word, n, slots, counts) of all blocks."""
    sc = lexicons.sparkSession.sparkContext
    known = sc.broadcast((pa.array([*head], pa.string()), np.array([*head.values()], np.int64), both))
    width = 2 * classes + 2
    size = lexicons.agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks")).first()
    shard = F.pmod(F.xxhash64("word"), F.lit(max(1, math.ceil(size.n / SHARD_ROWS)))).alias("shard")
    rows = lexicons.select(shard, "block", "word", "n", "slots", "counts")

    def merge(group: pa.Table) -> pa.Table:
        word, n, bounds, slots, counts = _merged(group, width)
        lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x, t)) for x, t in ((slots, pa.int32()), (counts, pa.int64()))]
        same = {c: pa.array(np.full(len(n), group[c][0].as_py())) for c in ("shard", "block")}
        return pa.table({**same, "word": word, "n": pa.array(n), "slots": lists[0], "counts": lists[1]})

    # one row of a word for each block: of very many blocks, some thousand at a time
    blocks = size.blocks
    rows = rows.withColumn("counts", F.col("counts").cast("array<long>"))
    while blocks > MERGED:
        blocks = math.ceil(blocks / MERGED)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(blocks)))
        rows = rows.groupBy("shard", "block").applyInArrow(merge, "shard long, block long, word string, n long, slots array<int>, counts array<long>")

    def assign(group: pa.Table) -> pa.Table:
        give_back()
        names, of, counted = known.value
        word, n, bounds, slots, counts = _merged(group, width)
        found = best_classes(bounds, slots, counts, counted, classes)
        at = np.asarray(pc.fill_null(pc.index_in(word, names), -1), np.int64)
        found = np.where(at >= 0, of[at] if len(of) else 0, found)
        return pa.table({"word": word, "c": pa.array(n), "class": pa.array(found, pa.int32())}).filter(pa.array(n > 0))

    return rows.drop("block").groupBy("shard").applyInArrow(assign, "word string, c long, class int")


def _class_sequences(encoded: DataFrame, words: DataFrame, n: int, v: int, n_end: int, of_class: dict[int, int], classes: int) -> DataFrame:
    """(id, held, n_tokens, n_known, base, emission, seq): a text's classes as bytes, the end of the text included."""
    lexicon = encoded.filter("word is not null").select("block", "code", "word").join(words, "word", "left").select(F.col("block").alias("of_block"), "code", "c", "class")
    docs = encoded.filter("codes is not null").select("block", "id", "held", "codes")
    kind = encoded.schema["id"].dataType
    totals = np.array([max(1, of_class.get(k, 0)) for k in range(classes)], float)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        lists = left["codes"].combine_chunks()
        codes, bounds = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        code = np.asarray(right["code"])
        size = int(code.max()) + 1 if len(code) else 0
        c, cls = np.zeros(size + 1), np.full(size + 1, classes + 1, np.int64)
        c[code] = np.asarray(pc.fill_null(right["c"], 0))
        cls[code] = np.asarray(pc.fill_null(right["class"], classes + 1))
        c[size], cls[size] = n_end, classes if n_end else classes + 1
        base = np.log10((c + ADD) / (n + ADD * (v + 1)))
        emission = np.where(cls < classes, np.log10(np.maximum(c, 1)) - np.log10(totals[np.minimum(cls, classes - 1)]), 0.0)
        marked = (cls + ONCE * ((c == 1) & (cls < classes))).astype(np.uint8)
        s = np.insert(codes, bounds[1:], size)
        starts = bounds[:-1] + np.arange(len(bounds) - 1)
        tokens = np.diff(bounds) + 1
        seq = marked[s]
        offsets = np.concatenate([starts, [len(s)]]).astype(np.int32)
        return pa.table(
            {
                "id": left["id"],
                "held": left["held"],
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0)[s].astype(np.int64), starts)),
                "base": pa.array(np.add.reduceat(base[s], starts)),
                "emission": pa.array(np.add.reduceat(emission[s], starts)),
                "seq": pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(offsets), pa.py_buffer(seq)]),
            }
        )

    schema = f"id {kind.simpleString()}, held boolean, n_tokens long, n_known long, base double, emission double, seq binary"
    return docs.groupBy("block").cogroup(lexicon.groupBy("of_block")).applyInArrow(lambda l, r: run(l, r) if l.num_rows else _nothing(l), schema)


def _nothing(docs: pa.Table) -> pa.Table:
    """No rows: a block without texts does not occur, but an empty side of a cogroup may."""
    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "emission": pa.float64(), "seq": pa.binary()}
    return pa.table({"id": docs["id"], "held": docs["held"], **{k: pa.array([], t) for k, t in kinds.items()}})


def _pairs(b: pa.RecordBatch, column: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of each token of the sequences, and where each text starts."""
    seqs = b.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    s = np.frombuffer(seqs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    starts = offsets[:-1] - offsets[0]
    before = np.concatenate([[end], s[:-1]])
    before[starts] = end
    return before, s, starts


def transitions(sequences: DataFrame, classes: int) -> np.ndarray:
    """Counts (before, class) with marks, 128 x 128, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total = np.zeros(128 * 128, np.int64)
        for b in batches:
            before, s, _ = _pairs(b, 0, classes)
            total += np.bincount(before * 128 + s, minlength=128 * 128)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], ["cell", "n"])

    out = np.zeros(128 * 128)
    for r in sequences.filter("not held").select("seq").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(128, 128)


def log_transitions(counts: np.ndarray, n: int, v: int, classes: int) -> np.ndarray:
    """log10 P(class | class before); the last class is that of unknown words. Each row sums to 1."""
    words = classes + 1
    once = np.zeros(128, bool)
    once[ONCE:] = True
    plain = counts.reshape(2, 64, 2, 64)
    by_class = plain.sum((0, 2))[: words, : words]
    new = counts[:, once].sum(1).reshape(2, 64).sum(0)[:words]
    after_new = plain[1].sum((0, 1))[:words]
    rows = np.vstack([by_class, after_new])
    fresh = np.append(new, counts[np.ix_(once, once)].sum())
    least = ADD / (n + ADD * (v + 1))
    of_all = rows[:-1].sum(0) / max(1.0, rows[:-1].sum())
    rate = min(0.5, max(least, new.sum() / max(1.0, by_class.sum())))
    size = rows.sum(1)
    unknown = (np.minimum(fresh, size / 2) + PRIOR * rate) / (size + PRIOR)
    known = (rows + PRIOR * of_all) / (size + PRIOR)[:, None]
    with np.errstate(divide="ignore"):
        return np.log10(np.column_stack([known * (1 - unknown)[:, None], unknown]))


def score_texts(
    docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, head: int = HEAD, size: int = BLOCK
) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base, score) of every row of ``docs``, learned from those that are not ``held``.

    Tokens are words (A-Z in lower case, runs without ASCII white space) and one end for each text. base is
    the log10 probability by smoothed counts of single tokens, score that of the class-based model. Null and
    blank texts are the end alone; a null ``held`` teaches; repeated rows count as often as they occur; an
    empty table gives none. If nothing teaches, score is base (0: all tokens are one unknown type). Other columns are
    not read.
    """
    if classes > 60:
        raise ValueError("at most 60 classes")
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    of, both = head_classes(texts, classes, head, size)
    encoded = materialize(_encoded(texts, of, classes, size), "encoded")
    words = materialize(word_classes(encoded.filter("word is not null").select("block", "word", "n", "slots", "counts"), of, both, classes), "words")
    of_class = {r["class"]: (r.n, r.v) for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_end = encoded.filter("codes is not null and not held").count()
    n = sum(x for x, _ in of_class.values()) + n_end
    v = sum(x for _, x in of_class.values()) + (n_end > 0)
    sequences = materialize(_class_sequences(encoded, words, n, v, n_end, {k: x for k, (x, _) in of_class.items()}, classes), "sequences")
    table_ = log_transitions(transitions(sequences, classes), n, v, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            before, s, starts = _pairs(b, 6, classes)
            of_text = np.add.reduceat(table_[before % ONCE, s % ONCE], starts) + np.asarray(b.column(5))
            score = of_text if n else np.asarray(b.column(4))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(4)), pa.array(np.full(b.num_rows, n)), b.column(4), pa.array(score)],
                ["id", "held", "n_tokens", "n_known", "train_tokens", "base", "score"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return sequences.mapInArrow(run, f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base double, score double")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held).withColumnsRenamed({"id": "doc_id", "held": "held_out", "base": "base_score"})
