import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from scenaria.llm import collocations as c
from scenaria.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def plain(rows, least, first=2000, percent=100):
    """The contract, row by row, for (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in cand.items():
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: B023, E731
        if any(la == lang and len(w) > len(words) and 100 * b >= percent * a and inside(w) for (la, w), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    res = []
    for lang, found in out.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            res.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(res)


def text_of(rng, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randrange(0, 120)))


def make(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "état", "Ünder", "x", "y z", "a\u0085b"]
    rows = [(rng.choice(["en", "fr", None, "und"]), text_of(rng, words)) for _ in range(n)]
    rows += [("en", "big red dog house")] * 40 + [("en", None), ("en", ""), (None, " ,. "), ("en", "alone")]
    rng.shuffle(rows)
    return rows


def test_words_and_pieces():
    texts = ["A b,c\td. E\x0bf\x00g", "", None, "no break", "x", "y", ". ", "é é ÉA"]
    words, fresh, n = c.words_of(pa.array(texts, pa.string()))
    flat = [w.decode() for w in words.to_pylist()]
    want = [(w, i == 0) for t in texts for p in pieces(t) for i, w in enumerate(p)]
    assert list(zip(flat, fresh.tolist())) == want
    assert n.tolist() == [sum(len(p) for p in pieces(t)) for t in texts]
    assert c.words_of(pa.array(texts, pa.string()).slice(3, 2))[0].to_pylist() == [b"no", b"break", b"x"]


@pytest.mark.parametrize("size", [1 << 30, 3000])
def test_equals_counting_everything(spark, size):
    """In one shard, and in many shards whose local support is down to one."""
    rows = make(1)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = c.collocations(df, least=12, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 12)


def test_percent_and_first(spark):
    rows = make(2)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({k: c.F.lit("x") for k in ("k", "phrase", "n", "total", "slice")})
    got = sorted(map(tuple, c.collocations(df, least=8, first=7, percent=60).collect()))
    assert got == plain(rows, 8, 7, 60) and len(got) > 7


def test_local_support_falls_with_the_share():
    shard = c.Shard(*[None] * 5, langs=["a", "b"], bytes_of=[30, 1], total_of=[100, 1000])
    assert shard.least(100).tolist() == [30, 1]


def test_the_union_holds_what_is_frequent_overall_only(spark):
    """A phrase that is rare in every shard but one, and one that just reaches the support over all shards."""
    rows = [("en", "filler words of all kinds here " * 3)] * 40 + [("en", "even spread")] * 20 + [("en", "just below")] * 19
    rng = random.Random(3)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = {r.phrase for r in c.collocations(df, least=20, size=400).collect()}
    assert "even spread" in got and "just below" not in got


def test_empty_and_long(spark):
    schema = "lang string, text string"
    assert c.collocations(spark.createDataFrame([], schema)).collect() == []
    assert c.collocations(spark.createDataFrame([(None, None), ("en", " ")], schema)).collect() == []
    long = "one two three " * 300_000
    got = sorted(map(tuple, c.collocations(spark.createDataFrame([("en", long)], schema)).collect()))
    assert got == plain([("en", long)], 100) and len(got) == 4


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", 0, None, 9 * big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    r = c.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).first()
    assert r.score == 1000 * (big - 1) * 9 * big // (big * (big + 1))


def test_whole_table(spark, sf_dir):
    rows = [(r.lang, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, c.op13_collocations(spark, sf_dir).collect())) == plain(rows, 100)


def test_a_task_sends_a_phrase_once(spark, monkeypatch):
    """Counts of the shards of a task are added up: the rows sent don't grow with the number of shards."""
    sent, real = spark.sparkContext.accumulator(0), c.pooled

    def noted(batches, most):
        for b in real(batches, most):
            sent.add(b.num_rows)
            yield b

    monkeypatch.setattr(c, "pooled", noted)
    rows = [("en", "big red dog house. new york city")] * 400
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert sorted(map(tuple, c.collocations(df, size=500).collect())) == plain(rows, 100)
    assert sent.value < 100


def test_pooled_rows_stay_bounded_and_whole():
    batch = lambda words: pa.RecordBatch.from_arrays([pa.array(words), pa.array([1] * len(words), pa.int64())], ["phrase", "n"])
    rng = random.Random(5)
    given = [[rng.choice([None, "a", "b", *map(str, range(60))]) for _ in range(7)] for _ in range(50)]
    total = Counter()
    for b in c.pooled(map(batch, given), 10):
        total.update(dict(zip(b["phrase"].to_pylist(), b["n"].to_pylist())))
    assert total == Counter(w for words in given for w in words)
    assert list(c.pooled(iter([]), 10)) == []
