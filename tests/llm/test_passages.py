import random

import pyarrow.parquet as pq
import pytest

from scenaria.llm import passages


def as_rows(df):
    from pyspark.sql import functions as F

    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()


def test_table(spark, sf_dir):
    data = pq.read_table(f"{sf_dir}/documents.parquet")
    want = dict(zip(data["doc_id"].to_pylist(), passages.brute_force(data["text"].to_pylist())))
    got = {r.doc_id: tuple(r)[1:] for r in passages.op3_repeated_passages(spark, sf_dir).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("shard,window,anchor", [(256, 6, 3), (2, 6, 3), (1, 5, 5), (256, 8, 1)])
def test_random_repeats(docs_of, monkeypatch, shard, window, anchor):
    """Passages repeated with different surroundings, within and across documents; the path of hot anchors too."""
    monkeypatch.setattr(passages, "SHARD", shard)
    rng = random.Random(shard * 10 + window)
    shared = [[str(rng.randrange(50)) for _ in range(rng.randrange(4, 14))] for _ in range(6)]
    docs = []
    for d in range(150):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(shared)[rng.randrange(3) :] if rng.random() < 0.5 else [str(rng.randrange(300)) for _ in range(rng.randrange(12))]
        docs.append((d, " ".join(words)))
    docs += [(200, "a a a a a a a a a a a a"), (201, "a b " * 8), (202, None), (203, ""), (204, docs[7][1]), (204, docs[7][1]), (None, docs[9][1])]
    got = sorted(map(tuple, as_rows(passages.remove_repeats(docs_of(*docs), window=window, anchor=anchor))), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(docs, passages.brute_force([t for _, t in docs], window))), key=str)
    assert got == want


def test_automaton_counts():
    rng = random.Random(2)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        times = [rng.randrange(1, 3) for _ in texts]
        a = passages.Automaton()
        for t, n in zip(texts, times):
            a.add(t, n)
        a.count()
        for t in texts:
            for i, m in enumerate(a.repeated(t)):
                def occurs(s):
                    return sum(n * sum(u[k : k + len(s)] == s for k in range(len(u))) for u, n in zip(texts, times))

                assert m == max(k for k in range(i + 2) if k == 0 or occurs(t[i + 1 - k : i + 1]) > 1)


def test_empty_table(docs_of):
    df = docs_of((1, "x"))
    assert passages.remove_repeats(df.limit(0)).count() == 0
    assert as_rows(passages.remove_repeats(df))[0].n_removed == 0
