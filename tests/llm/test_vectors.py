import numpy as np
import pytest

from scenaria.llm import vectors


def brute(rows, cosine=vectors.COSINE):
    """(id, n_links, component, kept) per row, all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    dim = max((len(v) for _, v in rows if v), default=1)
    x = np.array([list(v) + [0.0] * (dim - len(v)) if k else [0.0] * dim for (_, v), k in zip(rows, ok)], float)
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        pair = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
    pair[~np.array(ok)] = pair[:, ~np.array(ok)] = False
    np.fill_diagonal(pair, False)
    label = np.arange(len(rows))
    grown = pair | np.eye(len(rows), dtype=bool)
    while True:
        new = np.where(grown, label, len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[k]) if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((i, int(pair[k].sum()), c, i == c))
    return sorted(out, key=str)


def noisy(rng, groups, dim, noise):
    rows = []
    for size in groups:
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            v = base + noise * rng.normal(size=dim) / np.sqrt(dim)
            rows.append(v.tolist())
    order = rng.permutation(len(rows))
    return [(int(k), rows[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize("noise,block", [(0.2, 1024), (0.2, 5), (0.235, 1024)])
def test_recall_and_exactness(spark, monkeypatch, noise, block):
    """No link below the threshold; at least 0.9 of the links (0.99 here), also of links near it."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = noisy(rng, [1] * 1500 + [2] * 100 + [5] * 40 + [60], 64, noise) + [(5000 + k, [0.1] * 64) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.similar_vectors(df).collect()}
    want = {w[0]: w for w in brute(rows)}
    assert set(got) == set(want)
    assert all(got[k].n_links <= want[k][1] for k in got)
    found, there = sum(r.n_links for r in got.values()), sum(w[1] for w in want.values())
    assert found >= 0.99 * there
    if noise == 0.2:
        assert all((got[k].component_id, got[k].kept) == want[k][2:] for k in got) or found < there


@pytest.mark.parametrize("noise", [0.1, 0.2])
def test_recall_in_a_large_group(spark, noise):
    """A third of 20,001 different vectors are near copies of one."""
    x = np.array([v for _, v in noisy(np.random.default_rng(5), [6667], 64, noise)] + np.random.default_rng(6).normal(size=(13334, 64)).tolist())
    unit = x[:6667] / np.linalg.norm(x[:6667], axis=1, keepdims=True)
    want = (unit @ unit.T >= vectors.COSINE).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = np.zeros(len(x), np.int64)
    for r in vectors.similar_vectors(df).collect():
        got[r.vec_id] = r.n_links
    assert (got[:6667] <= want).all() and not got[6667:].any()
    assert got.sum() >= 0.99 * want.sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    rows += [(9, [1.0, 0.0, 0.01]), (10, [2.0]), (11, [-1.0, 0.0]), (None, [0.0, 5.0]), (None, [0.0, 5.0]), (12, [0.1, 5.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = sorted((tuple(r) for r in vectors.similar_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert vectors.similar_vectors(df.limit(0)).count() == 0
    assert vectors.similar_vectors(df.filter("vec_id < 4")).count() == 3


def test_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in vectors.op4_vector_links(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
