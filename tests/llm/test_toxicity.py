import zlib

import numpy as np
import pyarrow as pa
import pytest

from scenaria.llm import toxicity


def brute_rows(word):
    """Rows of one word by a plain loop over word_rows of that word alone."""
    at, rows = toxicity.word_rows([word])
    return sorted(rows[at[0] : at[1]].tolist())


def test_rows_do_not_depend_on_neighbours():
    vocab = ["Straße", "...", "worthless!", "a", "worthles", "été", "", "x" * 50]
    at, rows = toxicity.word_rows(vocab)
    for k, w in enumerate(vocab):
        assert sorted(rows[at[k] : at[k + 1]].tolist()) == brute_rows(w)
    n = lambda w: sum(max(0, len(w) + 2 - g + 1) for g in toxicity.GRAMS) + 1
    assert len(brute_rows("Straße")) == n("straße") and len(brute_rows("...")) == 0
    assert len(set(brute_rows("worthless")) & set(brute_rows("wortthless"))) >= 5


def test_score_equals_plain_mean():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 3, toxicity.ROWS).astype(np.float32), -0.5)
    texts = [None, "", "One two, two\nthree!", "été " * 40, "..."]
    got = model.score(pa.array(texts))
    for t, s in zip(texts, got):
        rows = [r for w in (t or "").split() for r in brute_rows(w)]
        logit = model.row_logit[rows].astype(float).sum() / (len(rows) + toxicity.PRIOR) - 0.5
        assert s == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-6)


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = toxicity.op7_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit / sum(r.predicted for r in held) > 0.85 and hit / sum(r.toxic for r in held) > 0.65


def test_unseen_misspelling():
    toxic = ["you worthless fool " + "and the other one " * k for k in range(6)] * 10
    clean = ["a kind letter of and the other one " * (k + 1) for k in range(6)] * 10
    model = toxicity.fit(toxic + clean, np.array([1] * 60 + [0] * 60))
    a, b = model.score(pa.array(["you wworthles foool", "a kindly lettter"]))
    assert a > 0.7 > 0.3 > b


def test_odd_tables(spark, docs_of):
    docs = docs_of((1, None), (2, ""), (2, ""), (None, "x"))
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1 and 0 <= rows[0].score <= 1
    assert toxicity.score(docs.limit(0), model).count() == 0
