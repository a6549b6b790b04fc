import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scenaria.llm import tokens

TOKENIZER = Tokenizer.from_file(tokens.vocab_path())
ENCODER = tokens.Encoder(tokens.vocab_path())


def same(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        want = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, repr(t)[:200]


def test_odd_texts():
    same(
        [
            None, "", " ", "\n\n", "It's 'RE we'll 'd 's's I'Mx", "a b c　d\x1cz\x85q", "é ́e É é́ é",
            "<|endoftext|> x<|startoftext|>y < |> <", "ΑΣ ΣΑΣ ß ẞ İ ı ſ K Å", "1234 ½ ² ٣ ⅷ", "𝄞𝄞 😀👍🏽 été", "x" * 5000, "!!..,,--__ %%%", "æ Þ ð ÿ Ÿ × ÷ ª º µ",
            "don''t '' 'S ’s", "﻿word ​z a­b", "가각 漢字かな", "a\x00b \x7f",
        ]
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'sStreÉß.,1²<|")), max_size=40), max_size=5))
def test_any_text(texts):
    same(texts)


def test_table(sf_dir):
    same(pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist())


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 4)
    e = tokens.Encoder(tokens.vocab_path())
    ids, bounds = e.encode(pa.array(["a b c", "d e f g", None]), end_id=2)
    again, _ = e.encode(pa.array(["a b c", "d e f g", None]), end_id=2)
    assert (ids == again).all() and bounds.tolist() == [0, 4, 9, 10] and (ids[bounds[1:] - 1] == 2).all()
    assert np.issubdtype(ids.dtype, np.unsignedinteger)
