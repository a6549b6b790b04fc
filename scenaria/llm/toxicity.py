"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word ends) and itself, hashed to rows of an
embedding table; a text is the mean over all its words. A misspelling that was never seen shares
most n-grams with what was. As softmax and mean are linear in the embeddings, a trained model
is, for scoring, one number per row and class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenaria.llm.common import free_name, mix64, parts, ship, split_words, table

#: N-gram lengths, embedding rows and width.
GRAMS, ROWS, DIM = (4, 5, 6), 1 << 20, 16
#: N-grams without a say that each mean includes: a few words alone decide less.
PRIOR = 150
#: Rows that fewer labelled texts than this touch keep a zero embedding.
TEXTS = 8
#: Labelled rows that are learned from, at most: of class 1 and of class 0, with the smallest hash of
#: the id. The model is fitted in one task, so this bounds what comes there.
SAMPLE = {1: 500, 0: 1500}
#: Share of class 1 in the weight of the training texts, whatever its share in their number.
SHARE = 0.3
#: Training reads texts VISITS times in all (at most EPOCHS times each), in PARTS batches a time.
VISITS, EPOCHS, PARTS, RATE, DECAY, SEED = 80_000, 200, 8, 0.2, 1e-5, 7
#: A document is rejected from this score on.
REJECT = 0.7
#: Bytes of text that are scored at once (whole texts).
AT_ONCE = 2 << 20
_STRIP = ".,;:!?|*#$%&()[]{}<>\"'`~_-+=/\\"


def word_rows(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word's n-grams and of the word itself: bounds and flat rows.
    Words that are punctuation only have none."""
    words = [w.lower().strip(_STRIP) for w in vocab]
    some = [f"<{w}>" for w in words if w]
    size = np.array([len(w) + 2 if w else 0 for w in words], np.int64)
    points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    rows, owner = [], []
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = mix64(h ^ points[k : k + m], k)
        inside = word[:m] == word[n - 1 :]
        rows.append(h[inside])
        owner.append(word[:m][inside])
    whole = np.flatnonzero(size)
    rows.append(np.array([zlib.crc32(w.encode()) for w in some], np.uint64) + np.uint64(1 << 40))
    owner.append(whole)
    flat, owner = mix64(np.concatenate(rows)) % np.uint64(ROWS), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    return bounds, flat[order].astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Score of a text: softmax of the mean of ``row_logit`` over its n-grams, plus ``bias``."""

    row_logit: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        bounds, codes, vocab = split_words(texts)
        at, rows = word_rows(vocab.to_pylist())
        total = np.concatenate([[0.0], np.cumsum(self.row_logit[rows], dtype=np.float64)])
        word_sum, word_n = total[at[1:]] - total[at[:-1]], np.diff(at)
        sums = np.concatenate([[0.0], np.cumsum(word_sum[codes])])
        counts = np.concatenate([[0], np.cumsum(word_n[codes])])
        n = counts[bounds[1:]] - counts[bounds[:-1]]
        logit = (sums[bounds[1:]] - sums[bounds[:-1]]) / (n + PRIOR) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Joint training of embeddings and softmax by Adam on the cross entropy.

    Without both classes the model gives every text the share of class 1.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(ROWS, np.float32), float(np.log(share / (1 - share))))
    bounds, codes, vocab = split_words(pa.array(texts, pa.string()))
    at, rows = word_rows(vocab.to_pylist())
    # Each text as distinct rows with their share.
    docs = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        word, times = np.unique(codes[lo:hi], return_counts=True)
        n = at[word + 1] - at[word]
        flat = np.arange(n.sum()) + np.repeat(at[word] - np.cumsum(n) + n, n)
        row, back = np.unique(rows[flat], return_inverse=True)
        share = np.bincount(back, np.repeat(times, n), len(row)) if len(row) else np.zeros(0)
        docs.append((row.astype(np.int32), (share / (share.sum() + PRIOR)).astype(np.float32)))
    touched = np.zeros(ROWS, np.int64)
    for row, _ in docs:
        touched[row] += 1  # the rows of a text are distinct
    del codes, vocab, at, rows
    active = np.flatnonzero(touched >= min(TEXTS, len(docs)))
    compact = np.full(ROWS, -1, np.int32)
    compact[active] = np.arange(len(active))
    for d, (row, share) in enumerate(docs):
        here = compact[row] >= 0
        docs[d] = compact[row][here], share[here]
    n_rows = len(active)
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (n_rows, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [emb, out, bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(labels == 1, SHARE / labels.sum(), (1 - SHARE) / (len(labels) - labels.sum())) * len(labels)
    batches = []
    for part in np.array_split(rng.permutation(len(docs)), min(PARTS, len(docs))):
        size = np.array([len(docs[d][0]) + 1 for d in part])  # and an entry of weight 0, as a text may have none
        idx = np.concatenate([np.append(docs[d][0], np.int32(0)) for d in part])
        share = np.concatenate([np.append(docs[d][1], np.float32(0)) for d in part])
        batches.append((idx, share, size, labels[part], weight[part] / len(part)))
    epochs = min(EPOCHS, -(-VISITS // len(docs)))
    for _ in range(epochs):
        for idx, share, size, target, each in batches:
            # Two classes: the logits' difference decides, and the two gradients are opposite.
            row_diff = emb @ (out[:, 1] - out[:, 0])
            logit = np.add.reduceat(share * row_diff[idx], np.cumsum(size) - size, dtype=np.float64) + (bias[1] - bias[0])
            delta = (1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50))) - target) * each
            one = np.bincount(idx, share * np.repeat(delta.astype(np.float32), size), n_rows).astype(np.float32)
            both = np.stack([-one, one], 1)
            total = np.float32(delta.sum())
            grads = [both @ out.T + DECAY * emb, emb.T @ both + DECAY * out, np.array([-total, total])]
            t += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                step = (RATE * (1 - t / (epochs * len(batches) + 1)) / (1 - 0.9**t)) * first[k] / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
                params[k] -= step.astype(np.float32)
    diff = emb @ (out[:, 1] - out[:, 0])
    row_logit = np.zeros(ROWS, np.float32)
    row_logit[active] = diff
    return Model(row_logit, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample (SAMPLE) of the labelled texts of ``docs``.

    Rows with a null label, id or text, and labels other than 0 and 1, teach nothing.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    order = F.xxhash64(F.col("id").cast("string"))
    ids = None
    for label, n in SAMPLE.items():
        some = marked.filter(F.col("label") == label).orderBy(order, "id").limit(n)
        ids = some if ids is None else ids.union(some)
    # At most the sum of SAMPLE ids, hence the broadcast; one text of each, and one task that learns from them.
    found = rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = found.repartition(1).sortWithinPartitions(order, "id", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            marks += b.column(1).to_pylist()
        model = fit(texts, np.array(marks))
        yield pa.RecordBatch.from_arrays([pa.array([model.row_logit.tobytes()]), pa.array([model.bias])], ["row_logit", "bias"])

    ship(docs.sparkSession)
    got = found.select("text", "label").mapInArrow(learn, "row_logit binary, bias double").first()
    return fit([], np.zeros(0)) if got is None else Model(np.frombuffer(got["row_logit"], np.float32), got["bias"])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of class 1 of every text. Null and empty
    texts, and those without a known n-gram, get the score of the bias alone. All rows stay, and
    columns of any name but ``out``, which is replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.row_logit, model.bias))  # 4 MB at any size
    rows = docs.withColumn(free_name(docs, "__scored"), F.col(text_col).cast("string")).drop(out)
    kept = docs.drop(out)
    names = [*kept.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            for some in parts(b, b.num_columns - 1, AT_ONCE):
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(own.score(some.columns[-1]))], names)

    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``; see ``with_score``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select("id", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs, labels.filter(third != 1))
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )
