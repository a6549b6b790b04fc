import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scenaria.llm import brown as b
from scenaria.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [END]


def plain(rows):
    """All columns but the model's score, by the contract."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    logp = lambda t: math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1)))
    return {(i, k): (held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(map(logp, tokens(x)))) for k, (i, x) in enumerate(rows)}


def scores(df, **how):
    held = b.F.crc32(b.F.col("doc_id").cast("string")) % 10 == 0
    return b.score_texts(df, held, **how)


def same(got, want):
    got = sorted(((r.id, r.held, r.n_tokens, r.n_known, r.train_tokens, r.base) for r in got), key=str)
    want = sorted(((i, *rest) for (i, _), rest in want.items()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want))


def grammar(rng, n):
    """Texts of two languages in which kinds of words follow each other."""
    kinds = {lang: [[f"{lang}{k}{j}" for j in range(40)] for k in range(4)] for lang in "ab"}
    rows = []
    for i in range(n):
        lang, k, words = rng.choice("ab"), rng.randrange(4), []
        for _ in range(rng.randrange(5, 120)):
            words.append(rng.choice(kinds[lang][k]) if rng.random() < 0.97 else f"odd{rng.randrange(10**6)}")
            k = (k + 1) % 4 if rng.random() < 0.9 else rng.randrange(4)
        rows.append((i, " ".join(words)))
    return rows


def brute_gain(left, right, count, of, w, new):
    moved = of.copy()
    moved[w] = new
    return b.log_likelihood(left, right, count, moved) - b.log_likelihood(left, right, count, of)


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(1)
    words, classes = 12, 3
    dense = rng.integers(0, 30, (words + 1, words + 1)) * (rng.random((words + 1, words + 1)) < 0.6)
    left, right = np.nonzero(dense)
    count = dense[left, right].astype(float)
    of = np.append(b.exchange(left, right, count, words, classes), classes)
    start = np.append(np.arange(words) % classes, classes)
    assert b.log_likelihood(left, right, count, of) > b.log_likelihood(left, right, count, start)
    for w in range(words):
        for new in range(classes):
            assert brute_gain(left, right, count, of, w, new) <= 1e-6


def test_exchange_finds_the_classes_of_a_grammar():
    """Words of one kind end up in one class."""
    rng = random.Random(2)
    rows = [x.split() for _, x in grammar(rng, 400)]
    c = Counter(w for x in rows for w in x if not w.startswith("odd"))
    names = {w: k for k, (w, _) in enumerate(c.most_common())}
    pairs = Counter((names[x], names[y]) for ws in rows for x, y in zip(ws, ws[1:]) if x in names and y in names)
    left, right = (np.array([p[k] for p in pairs]) for k in (0, 1))
    of = b.exchange(left, right, np.array([*pairs.values()], float), len(names), 8)
    found = {}
    for w, k in names.items():
        found.setdefault(w[:2], Counter())[of[k]] += 1
    assert sum(f.most_common(1)[0][1] for f in found.values()) >= 0.9 * len(names)


def test_pairs_are_counted_in_blocks_where_a_word_is_rare(spark):
    """Words that are frequent in one block alone: their pairs count in all."""
    fill = [[f"f{k}x{j}" for j in range(300)] for k in range(4)]
    rows = [(k, False, " ".join(["red apple"] * (40 if k == 0 else 2) + ["sour apple"] * (40 if k == 3 else 1) + fill[k])) for k in range(4)]
    rows += [(9, True, "red apple " * 50), (10, False, None)]
    df = spark.createDataFrame(rows, "id long, held boolean, text string").repartitionByRange(6, "id")
    got = {(r.a, r.b): r.n for r in b._head_pairs(df, 20, 1000).collect()}
    want = Counter()
    for _, held, text in rows:
        words = [w if w in ("red", "apple", "sour") else None for w in (text or "").split()]
        if not held:
            want.update((x, y) for x, y in zip(["", *words], [*words, ""]) if y is not None)
    assert got == want
    of, _ = b.head_classes(df, 2, 20, 1000)
    assert [*of] == ["apple", "red", "sour"]


def test_best_class_is_the_largest_gain():
    rng = np.random.default_rng(3)
    classes, words = 4, 50
    both = rng.integers(1, 200, (classes + 1, classes + 1)).astype(float)
    entries = [np.sort(rng.choice(2 * classes + 2, rng.integers(0, 7), replace=False)) for _ in range(words)]
    entries = [e[e != 2 * classes + 1] for e in entries]
    counts = [rng.integers(1, 40, len(e)) for e in entries]
    got = b.best_classes(np.concatenate([[0], np.cumsum([len(e) for e in entries])]), np.concatenate(entries), np.concatenate(counts), both, classes)
    f = lambda x: (b._f(x)).sum()
    level = lambda m: f(m) - f(m.sum(0)[:classes]) - f(m.sum(1)[:classes])
    for w in range(words):
        best = []
        for k in range(classes):
            gain = 0.0
            col, row = both.copy(), both.copy()
            for s, n in zip(entries[w], counts[w]):
                if s <= classes:
                    col[s, k] += n
                else:
                    row[k, s - classes - 1] += n
            gain = f(col) - f(both) + f(row) - f(both) - f(col.sum(0)[:classes]) + f(both.sum(0)[:classes]) - f(row.sum(1)[:classes]) + f(both.sum(1)[:classes])
            best.append(gain)
        assert math.isclose(best[got[w]], max(best), abs_tol=1e-6)


@pytest.mark.parametrize("how", [{}, {"size": 2000, "head": 200}])
def test_columns_and_gain_over_the_base(spark, how, monkeypatch):
    """In one block with all words exchanged, and in many blocks with a third of the words outside of the head."""
    rows = grammar(random.Random(4), 600) + [(7, "a00 A01 b02"), (7, "a00 A01 b02"), (None, "only here"), (601, None), (602, ""), (603, " \t\x0b ")]
    if how:
        monkeypatch.setattr(b, "MERGED", 4)
        monkeypatch.setattr(b, "SHARD_ROWS", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = scores(df.withColumns({c: b.F.lit("x") for c in ("id", "held", "word", "block", "codes", "c", "class")}), classes=10, **how).collect()
    same(got, plain(rows))
    held = [r for r in got if r.held]
    assert len(held) > 30 and sum(r.score for r in held) > sum(r.base for r in held) + 0.15 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    classes = 5
    counts = np.zeros((128, 128))
    of = np.r_[0 : classes + 1, 64 : 64 + classes]
    counts[np.ix_(of, of)] = rng.integers(0, 20, (len(of), len(of)))
    t = 10 ** b.log_transitions(counts, 10_000, 500, classes)
    assert t.shape == (classes + 2, classes + 2) and np.allclose(t.sum(1), 1) and (t > 0).all()


def test_nothing_to_learn_from_and_nothing_at_all(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "a b c"), (held, None)], "doc_id long, text string")
    got = scores(df).collect()
    assert [(r.n_known, r.train_tokens, r.base, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert scores(df.limit(0)).collect() == []


def test_a_text_of_a_million_words(spark):
    rows = [(1, "one two three four " * 250_000), (2, "one two"), (3, "five")]
    same(scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain(rows))


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = b.op12_lm_scores(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.withColumnsRenamed({"doc_id": "id", "held_out": "held", "base_score": "base"}).collect()
    same(got, plain(rows))
    held = [r for r in got if r.held]
    assert sum(r.score for r in held) > sum(r.base for r in held)
