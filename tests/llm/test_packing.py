import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scenaria.llm import packing
from scenaria.llm.tokens import vocab_path


def slots(histogram, capacity):
    out = {}
    for length, rank, k, n, seq, off in packing.plan(histogram, capacity):
        for t in range(n):
            assert (length, rank + t) not in out
            out[length, rank + t] = (seq + t // k, off + t % k * length)
    return out


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_is_best_fit(histogram):
    got = slots(histogram, 40)
    assert set(got) == {(n, r) for n, c in histogram.items() for r in range(c)}
    by = {}
    for (n, _), (seq, off) in got.items():
        by.setdefault(seq, []).append((off, n))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 40
    assert len(by) == best_fit([n for n, c in histogram.items() for _ in range(c)], 40)


def check(rows, texts, capacity=2048):
    """texts: (id, text) pairs; every document whole, every sequence gapless and within capacity."""
    t = Tokenizer.from_file(vocab_path())
    want = sorted(
        (i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4")))
        for i, x in texts
        for ids in [t.encode(x or "", add_special_tokens=False).ids + [0]]
        for k in range(0, len(ids), capacity)
        for part in [ids[k : k + capacity]]
    )
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(by) <= best_fit([w[3] for w in want], capacity) and len(by) >= -(-total // capacity)


def test_table(spark, sf_dir):
    data = pq.read_table(f"{sf_dir}/documents.parquet")
    check(packing.op8_packing(spark, sf_dir).collect(), list(zip(data["doc_id"].to_pylist(), data["text"].to_pylist())))


def test_small_tables(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "x " * 50), (5, "same size")] + [(k, "same size") for k in range(6, 20)]
    df = packing.pack(docs_of(*texts), capacity=10, with_ids=True)
    rows = df.collect()
    check(rows, texts, 10)
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in rows)
    assert packing.pack(docs_of(*texts).limit(0)).count() == 0
