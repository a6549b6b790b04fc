"""Token ids of whole texts, by the public tokenizers library, word by word.

The tokenizer cuts a text at white space before anything else and encodes each part on its own,
so a text's ids are its words' ids in a row. Words repeat: each worker encodes a word once and
keeps the ids. A batch's words are numbered by Arrow, so that Python sees distinct words only.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from scenaria.llm.common import split_words

VOCAB = "word_bpe_49k.json"
#: Words kept by a worker; beyond it, the memory starts anew (that of their parts a little later).
KEPT = 300_000
#: Bytes of text that are encoded at once (whole texts; one that is longer alone).
AT_ONCE = 4 << 20


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts; same ids as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Of a word that is plain (ASCII or Latin letters, digits, punctuation; the form of nearly all)
    the parts that the tokenizer's own pattern yields are given to its model; any other word goes
    through ``encode`` itself. Both are cached.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # composed letters of Latin-1 with simple lower case, and ASCII without the < of special tokens
        self.plain = regex.compile("[!-;=-~ß-öø-ÿÀ-ÖØ-Þ]*").fullmatch
        self.as_bytes = _byte_letters()
        self.ints = list(range(self.tokenizer.get_vocab_size()))  # one object for each id, however often kept
        self.piece: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        if len(self.piece) > KEPT:
            self.piece = {}
        self.start, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _piece(self, part: str) -> tuple[int, ...]:
        """Ids of a part of a plain word."""
        got = self.piece.get(part)
        if got is None:
            if len(self.piece) > 2 * KEPT:  # one batch of odd texts only
                self.piece = {}
            raw = part if part.isascii() else part.encode().decode("latin-1").translate(self.as_bytes)
            ints = self.ints
            got = self.piece[part] = tuple([ints[t.id] for t in self.model.tokenize(raw)])
        return got

    def _ids(self, word: str) -> tuple[int, ...] | list[int]:
        # Nearly all words are letters, with a full stop or comma behind them or not.
        low = word.lower()
        core = low[:-1] if low[-1:] in (".", ",") else low
        if core.isalpha() and (core.isascii() or max(core) <= "ÿ") and len(low) == len(word):
            return self._piece(core) if core is low else self._piece(core) + self._piece(low[-1])
        if not self.plain(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for part in self.parts.findall(low) for i in self._piece(part)]

    def _add(self, words: list[str]) -> None:
        new = [self._ids(w) for w in words]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        n, total = len(self.number), int(sizes.sum())
        while n + len(words) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + total] = [i for ids in new for i in ids]
        self.used += total
        self.number.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (null: none) and each text's bounds in them; ``end_id`` follows each text."""
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
        part = np.cumsum(size) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        done = [self._encode(texts.slice(a, b - a), end_id) for a, b in zip(cuts[:-1], cuts[1:])]
        pa.default_memory_pool().release_unused()
        before = np.cumsum([0, *(len(ids) for ids, _ in done)])
        bounds = [b[:-1] + k for (_, b), k in zip(done, before)]
        return np.concatenate([ids for ids, _ in done]), np.concatenate([*bounds, before[-1:]])

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        bounds, codes, vocab = split_words(texts)
        words = vocab.to_pylist()
        if len(self.number) + len(words) > KEPT:
            self.reset()
        get, n = self.number.get, len(self.number)
        at = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._add([words[k] for k in missing.tolist()])
            at[missing] = np.arange(n, n + len(missing))
        where = at[codes] if len(codes) else codes
        sizes = self.size[where]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.arange(ends[-1]) + np.repeat(self.start[where] - ends[:-1], sizes)
        ids, bounds = self.pool[flat], ends[bounds]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + k for k, b in enumerate(hidden)}


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; ``special_as_text``: the strings of special
    tokens in a text are ordinary text and never give those tokens' ids."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
