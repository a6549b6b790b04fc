import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scenaria.llm import decontam


def brute(docs, items):
    """Every document against every item: edits of the best passage."""
    index = decontam.Index([i for i, _ in items], [t for _, t in items])
    bounds, number = decontam.plain_words(pa.array([t for _, t in docs], pa.string()))
    out = {}
    for d, (doc_id, _) in enumerate(docs):
        region = number[bounds[d] : bounds[d + 1]]
        for k, item in enumerate(index.ids):
            edits = decontam.fewest_edits(index.words[k], region)
            if edits <= decontam.allowed(len(index.words[k])):
                out[doc_id, item] = edits
    return out


def edits_plain(a, b):
    """Textbook edit distance of a to the closest part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_fewest_edits():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 15))]
        assert decontam.fewest_edits(np.array(a, np.uint64), np.array(b, np.uint64)) == edits_plain(a, b)


def test_table_equals_all_pairs(spark, sf_dir):
    docs, items = (pq.read_table(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()))
    items = list(zip(items["item_id"].to_pylist(), items["text"].to_pylist()))
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontam.op9_decontamination(spark, sf_dir).collect()}
    assert got == brute(docs, items) and got


def test_edited_passages_are_found(spark, docs_of, monkeypatch):
    """Passages with up to a fifth of the words changed, at random places: recall 0.98 and no false match."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 60)))) for k in range(60)]
    docs = []
    for d in range(300):
        words = items[d % 60][1].split()
        for _ in range(rng.randrange(decontam.allowed(len(words)) + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [word()][: rng.randrange(2)]
        docs.append((d, " ".join([word() for _ in range(rng.randrange(80))] + [w.title() + "," for w in words] + [word()])))
    table = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.id, r.item): r.n_edits for r in decontam.find_items(docs_of(*docs), table).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) >= 290


def test_odd_rows(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (3, " ... "), (None, "five six seven"), (4, "x")], "item_id long, text string")
    rows = [(1, "a one TWO three, four b"), (1, "a one TWO three, four b"), (2, None), (3, ""), (None, "five six seven"), (5, "x")]
    got = sorted(map(tuple, decontam.find_items(docs_of(*rows), items).select("id", "item", "n_edits").collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (None, None, 0), (5, 4, 0)], key=str)
    assert decontam.find_items(docs_of(*rows).limit(0), items).count() == 0
    assert decontam.find_items(docs_of(*rows), items.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["insert", "exchange", "any"])
def test_long_items_are_found_at_the_full_budget(kind):
    """Items of 200 to 500 words with a fifth of the words edited: recall of 0.95 and more."""
    rng = random.Random(kind)
    vocab = [f"w{k}" for k in range(3000)]
    hits, sizes = 0, [200, 260, 320, 400, 500] * 6
    for n in sizes:
        item = [rng.choice(vocab) for _ in range(n)]
        words = list(item)
        for _ in range(decontam.allowed(n)):
            at, how = rng.randrange(len(words)), kind if kind != "any" else rng.choice(["insert", "exchange", "leave out"])
            if how == "insert":
                words.insert(at, rng.choice(vocab))
            elif how == "exchange":
                words[at] = rng.choice(vocab)
            else:
                del words[at]
        text = " ".join([rng.choice(vocab) for _ in range(40)] + words + [rng.choice(vocab) for _ in range(40)])
        hits += bool(decontam.Index([0], [" ".join(item)]).matches(*decontam.plain_words(pa.array([text]))))
    assert hits >= 0.95 * len(sizes)
