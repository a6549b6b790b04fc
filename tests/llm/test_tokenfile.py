import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from scenaria.llm import tokencount, tokenfile
from scenaria.llm.tokens import vocab_path


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    h = tokenfile.PerfectHash.build(keys)
    assert sorted(h.number(keys).tolist()) == list(range(len(keys)))


def test_perfect_hash_searches_what_no_level_takes(monkeypatch):
    monkeypatch.setattr(tokenfile, "LEVELS", 1)
    keys = np.arange(500)
    assert sorted(tokenfile.PerfectHash.build(keys).number(keys).tolist()) == list(range(500))


def expected(pairs, end):
    t, at, out = Tokenizer.from_file(vocab_path()), 0, []
    for i, x in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    return out


def test_table_round_trip(spark, sf_dir):
    data = pq.read_table(f"{sf_dir}/documents.parquet")
    pairs = list(zip(data["doc_id"].to_pylist(), data["text"].to_pylist()))
    rows = tokenfile.op5_token_output(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(expected(pairs, 2))


def test_odd_rows_and_keyed_access(spark, docs_of):
    pairs = [(5, "e"), (None, "null key"), (3, None), (3, "twice"), (3, "twice"), (-7, ""), (2**62, "x " * 3000), (None, None)]
    manifest = tokenfile.write_shards(docs_of(*pairs), shards=3)
    rows = tokenfile.read_shards(manifest, with_ids=True).collect()
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted(expected(pairs, 2), key=key)
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in rows)
    shards = [tokenfile.Shard(r.path) for r in manifest.collect()]
    found = [s.get(5) for s in shards]
    assert [x.tolist() for x in found if x is not None] == [Tokenizer.from_file(vocab_path()).encode("e", add_special_tokens=False).ids + [2]]
    assert all(s.get(k) is None for s in shards for k in (4, 6, 0, 2**61))
    assert tokenfile.read_shards(tokenfile.write_shards(docs_of(*pairs).limit(0))).count() == 0


def test_rows_come_from_the_index(spark, docs_of, monkeypatch):
    """With the ordinals of two keys exchanged, their rows change: positions alone do not make the result."""
    docs = docs_of((1, "one"), (2, "two two"), (3, "three three three"))
    manifest = tokenfile.write_shards(docs, shards=1)
    path = manifest.first().path
    shard = tokenfile.Shard(path)
    good = shard.ordinals_of(0, 3).tolist()
    changed = shard.ordinals.copy()
    changed[shard.hash.number(np.array([1, 2], np.int64))] = [1, 0]
    shard.parts["ordinals"] = changed
    assert good == [0, 1, 2]
    with pytest.raises(ValueError, match="index"):
        shard.ordinals_of(0, 3)
    assert shard.ordinal(np.array([1, 2, 3, 4], np.int64)).tolist() == [1, 0, 2, -1]


def test_a_look_up_reads_a_few_words(spark, docs_of):
    docs = spark.range(20_000).selectExpr("id * 3 AS doc_id", "concat('t ', id) AS text")
    shard = tokenfile.Shard(tokenfile.write_shards(docs, shards=1).first().path)
    got = shard.get(300)
    assert not shard.parts and len(got) and got[-1] == 2
    at = int(shard.ordinal(np.array([300], np.int64))[0])
    assert got.tolist() == shard.ids(at, at + 1).tolist() and all(shard.get(k) is None for k in (1, 301, -5))


def test_one_key_of_a_third_of_the_rows_is_several_shards(spark, docs_of):
    docs = docs_of(*[(k, f"t {k}") for k in range(200)], *[(77, "same text")] * 100)
    manifest = tokenfile.write_shards(docs.repartition(6), shards=6)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 300 and max(sizes) < 100
    rows = tokenfile.read_shards(manifest).orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(300)]
    assert [r.id for r in rows] == sorted(r.id for r in rows)


def test_counts_of_table(spark, sf_dir):
    data = pq.read_table(f"{sf_dir}/documents.parquet")
    t = Tokenizer.from_file(vocab_path())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in zip(data["doc_id"].to_pylist(), data["text"].to_pylist())}
    got = tokencount.op10_token_counts(spark, sf_dir).collect()
    assert len(got) == len(want) and {r.doc_id: r.n_tokens for r in got} == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_of_any_size(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], []
    for f in range(4):
        ids = rng.choice([9, 5, 6, 7], size=[0, 1, 40, 200][f], p=[0.2, 0.3, 0.3, 0.2]).astype("<u2")
        (tmp_path / f"{f}.u2").write_bytes(ids.tobytes())
        files.append((f, f"file://{tmp_path}/{f}.u2"))
        ends = np.flatnonzero(ids == 9)
        sizes = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        want += [(f, k, int(n), k < len(ends)) for k, n in enumerate(sizes) if k < len(ends) or n]
    df = spark.createDataFrame(files, "file int, path string")
    assert sorted(map(tuple, tokencount.count_tokens(df, 9, block).collect())) == sorted(want)


def test_special_token_strings_are_text(docs_of):
    rows = [(1, "a <|endoftext|> b"), (2, None), (None, "c")]
    at = tokencount.write_flat(docs_of(*rows))
    got = tokencount.count_tokens(at.groupBy("file").agg({"path": "min"}).toDF("file", "path"))
    assert got.count() == 3 and got.filter("n_tokens = 0").count() == 1
    assert tokencount.count_tokens(tokencount.write_flat(docs_of(*rows).limit(0)).select("file", "path")).count() == 0
