"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a linear layer and softmax
over {0, 1} follow. Averaging and the layer are both linear, so once training is over each bucket has one number, and
a document's score is the logistic function of the mean of its buckets' numbers: scoring is a pass of table look-ups
over whole texts.

Training reads at most TRAIN_ROWS labelled rows of each class (the smallest by a hash of the id, so the choice does
not depend on partitions) as bags of buckets, which are counted over their whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .workspace import text_batches

#: Bound of the training sample: rows of each class.
TRAIN_ROWS = 1500
BUCKETS = 1 << 16
DIM, EPOCHS, RATE, BATCH, SEED = 8, 12, 0.5, 32, 7
#: Lengths in bytes of the character n-grams.
GRAMS = (2, 3, 4)
THRESHOLD = 0.7
#: Each byte of text gives several 64-bit features, so chunks are smaller here than elsewhere.
CHUNK_BYTES = 1 << 18
_SALT = np.uint64(0xA0761D6478BD642F)


@dataclass
class Model:
    bucket: np.ndarray  # float32: the log-odds of label 1 that each bucket adds to the mean
    bias: float


def buckets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and character n-grams of a chunk of texts, and the number of them in each text.

    Case is kept. N-grams do not cross texts. Beside the words and n-grams, a word that repeats the one before it gives
    one common feature, as the bigram of a word with itself would if it carried over to words never seen in training;
    it is no part of the method by name, but without it one junk document in thirteen passes (see README).
    """
    n_docs, n = len(off) - 1, len(raw)
    s, e, doc = X.words(raw, off)
    word = X.block_hash(raw, s, e)
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
    parts, docs = [word, np.full(len(again), _SALT)], [doc, doc[again]]
    at = np.arange(n)
    of = np.repeat(np.arange(n_docs), np.diff(off))
    left = off[1:][of] - at
    for k in GRAMS:
        start = at[left >= k]
        g = np.zeros(len(start), np.uint64)
        for j in range(k):
            g = g << np.uint64(8) | raw[start + j]
        parts.append((g + np.uint64(k)) * _SALT)
        docs.append(of[start])
    out = (np.concatenate(parts) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    return out, np.concatenate(docs)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares, for each text."""
    raw, off = X.text_bytes(texts)
    out = []
    for i, j in X.chunks(off, CHUNK_BYTES):
        base = off[i]
        b, doc = buckets(raw[base : off[j]], off[i : j + 1] - base)
        key, count = np.unique(doc.astype(np.int64) * BUCKETS + b, return_counts=True)
        cut = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
        for k in range(j - i):
            x, w = key[cut[k] : cut[k + 1]] % BUCKETS, count[cut[k] : cut[k + 1]]
            out.append((x.astype(np.int32), (w / max(1, w.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent on the softmax loss, classes weighted equally, rate falling to nothing.

    Rows are taken in the order given, shuffled by a fixed seed. Without rows of both classes the score is the share of
    label 1 (one half without any).
    """
    n1, n = int(labels.sum()), len(labels)
    if n1 in (0, n):
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not n else (5.0 if n1 else -5.0))
    rng = np.random.default_rng(SEED)
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, n / (2 * n1), n / (2 * (n - n1))).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * -(-n // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            pick = order[k : k + BATCH]
            ids = np.concatenate([rows[i][0] for i in pick])
            share = np.concatenate([rows[i][1] for i in pick])[:, None]
            cut = np.cumsum([0] + [len(rows[i][0]) for i in pick])
            seg = np.repeat(np.arange(len(pick)), np.diff(cut))
            gathered = emb[ids]
            hidden = np.zeros((len(pick), DIM), np.float32)
            full = np.flatnonzero(np.diff(cut))
            if len(full):
                hidden[full] = np.add.reduceat(gathered * share, cut[:-1][full], axis=0)
            z = hidden @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - target[pick]) * weight[pick][:, None]
            step = g @ out.T
            out -= rate * hidden.T @ g
            bias -= rate * 0.1 * g.mean(axis=0)
            np.add.at(emb, ids, -rate * 30 * share * step[seg])
    log_odds = emb @ (out[:, 1] - out[:, 0])
    return Model(log_odds.astype(np.float32), float(bias[1] - bias[0]))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 of each whole text; an empty or null text has that of no feature."""
    raw, off = X.text_bytes(texts)
    mean = np.zeros(len(off) - 1)
    for i, j in X.chunks(off, CHUNK_BYTES):
        base = off[i]
        b, doc = buckets(raw[base : off[j]], off[i : j + 1] - base)
        count = np.bincount(doc, minlength=j - i)
        mean[i:j] = np.bincount(doc, model.bucket[b], minlength=j - i) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(mean + model.bias, -60, 60)))


def remainder(doc_id, n: int):
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on at most `rows` labelled rows of each class; labels (doc_id, label) with label 0 or 1.

    A document labelled twice counts with its larger label; null ids and labels, and labels of no document, are left
    out. Of several rows of an id the one with the least text is used, and equal texts once: copies would weigh more
    than their kind does.
    """
    one = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    one = one.join(docs.select(docs["doc_id"].cast("long").alias("doc_id")), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(SEED))
    few = [one.filter(one["label"] == k).select("doc_id", "label", order.alias("o")).orderBy("o", "doc_id").limit(rows) for k in (0, 1)]
    # 2 x rows narrow rows at most
    sample = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(few[0].unionByName(few[1]).drop("o")), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = bags(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in found], pa.list_(pa.float32()))], ["doc_id", "label", "ids", "shares"])

    held = sample.mapInArrow(bag, "doc_id long, label int, ids array<int>, shares array<float>").toArrow()
    held = held.sort_by("doc_id")
    seen, bag_rows, marks = set(), [], []
    for ids, shares, label in zip(held.column("ids"), held.column("shares"), held.column("label").to_pylist()):
        x, w = ids.values.to_numpy(zero_copy_only=False), shares.values.to_numpy(zero_copy_only=False)
        key = (x.tobytes(), w.tobytes())
        if key not in seen:
            seen.add(key)
            bag_rows.append((x, w))
            marks.append(label)
    return train(bag_rows, np.array(marks, np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a double column score (replacing one of that name)."""
    text_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    from pyspark.sql import types as T

    frame = docs.select(*kept)
    return frame.mapInArrow(run, T.StructType(frame.schema.fields + [T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, learnt from labels outside the held-out fold.

    Every row is scored by its whole text alone: a null or empty text as no feature (the bias), repeated rows alike. A
    null id is not held out. A score equal to THRESHOLD is predicted 1. Without labels every score is one half. Other
    columns of both tables are ignored, whatever their names.
    """
    seen = labels.filter(remainder(labels["doc_id"], 4) != 2).select("doc_id", labels[column].alias("label"))
    out = score(docs.select("doc_id", "text"), fit(docs, seen))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
