"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one hashed vector for each word and one for each of its character
n-grams (over code points), words being wrapped in "<" and ">". A softmax layer turns the average into a probability. Vectors and
layer are trained together by stochastic gradient descent in numpy, on the driver, from at most `train_docs`
labelled documents of at most `train_bytes` of text together (the documented bounds, filled in the order of a hash of the
identifier) of which every word counts. An identifier that many rows share teaches by one of them, that of the lowest hash
of its text; a document of more than a sixteenth of `train_bytes` teaches nothing.

The output layer is linear in the average, so after training every hashed slot is folded into one number, and
scoring needs one number for each different word of a batch: the sum over its slots. The folded table
(2^BUCKET_BITS floats, one megabyte) is all that is broadcast; its size does not depend on the data.

Labels are learned only from documents whose crc32(doc_id as text) mod 3 is not 1. Only the text enters a score.

Defined edge cases: a null or empty text has the score of the layer's bias alone; without labelled documents,
or with one class only, the score is the share of label 1 (0.5 if none); labels other than 0 and 1 teach nothing;
repeated rows are scored alike; rows with a null doc_id are never used for training; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, slices, split_words, table

BUCKET_BITS = 17
DIM = 8
NGRAMS = (1, 2, 3, 4)
EPOCHS = 6
RATE = 0.25
BATCH = 16
TRAIN_DOCS = 2_000
TRAIN_BYTES = 1 << 28
SEED = 7
#: Text scored at a time.
SCORE_BYTES = 3 << 20
#: Different words whose n-grams are held at once.
WORDS_AT_ONCE = 16_384
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, one number for each code point): its UTF-8 bytes, the first one highest."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    first = (raw & 0xC0) != 0x80
    first[(ends[:-1] - ends[0])[ends[1:] > ends[:-1]]] = True
    at = np.flatnonzero(first)
    data = raw[at].astype(np.uint64)
    if len(at) < len(raw):
        length = np.diff(np.append(at, len(raw)))
        for k in range(1, 4):
            more = length > k
            data[more] = data[more] << np.uint64(8) | raw[at[more] + k]
    return np.searchsorted(at, ends - ends[0]), data


def slots(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, slots): hashed slots of each word and of its character n-grams, over the code points of <word>."""
    wrapped = pc.binary_join_element_wise("<", words, ">", "") if len(words) else words
    if not len(wrapped):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    bounds, data = code_points(wrapped)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = bounds[1:][owner] - np.arange(len(data))  # code points from here to the end of the word
    prime = np.uint64(0x100000001B3)
    keys, owners = [], []
    running = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(data), np.uint64)
        fit = max(0, len(data) - n + 1)
        shifted[:fit] = data[n - 1 : n - 1 + fit]
        running = (running ^ shifted) * prime
        if n in NGRAMS:
            fits = left >= n
            keys.append(running[fits] + np.uint64(n))
            owners.append(owner[fits])
    place = (np.arange(len(data)) - bounds[:-1][owner]).astype(np.uint64)
    whole = np.add.reduceat(mix64(data + (place << np.uint64(32))), bounds[:-1])  # every word holds "<" and ">"
    keys.append(whole)
    owners.append(np.arange(len(lengths)))
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    hashed = (mix64(key[order]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(lengths))))), hashed


def _weighted_slots(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: different slots and the share of the text's features that each has."""
    out = []
    for first in range(0, len(texts), 32):
        offsets, codes, words = split_words(texts[first : first + 32])
        starts, hashed = slots(words)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            kinds, times = np.unique(codes[a:b], return_counts=True)
            n = starts[kinds + 1] - starts[kinds]
            at = np.repeat(starts[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found, back = np.unique(hashed[at], return_inverse=True)
            mass = np.bincount(back, np.repeat(times, n), len(found)) if len(at) else np.zeros(0)
            out.append((found.astype(np.int32), (mass / max(1.0, mass.sum())).astype(np.float32)))
    return out


class Model:
    """folded: what each slot adds to the logit of class 1; bias; whether anything was learned."""

    def __init__(self, folded: np.ndarray, bias: float):
        self.folded, self.bias = folded, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, words = split_words(texts)
        value, n = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for at in range(0, len(words), WORDS_AT_ONCE):
            starts, hashed = slots(words[at : at + WORDS_AT_ONCE])
            sums = np.concatenate(([0.0], np.cumsum(self.folded[hashed], dtype=np.float64)))
            here = slice(at, at + len(starts) - 1)
            value[here], n[here] = sums[starts[1:]] - sums[starts[:-1]], np.diff(starts)
        total = np.concatenate(([0.0], np.cumsum(value[codes])))
        count = np.concatenate(([0], np.cumsum(n[codes])))
        mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, count[offsets[1:]] - count[offsets[:-1]])
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def train(texts: list[str | None], labels: list[int], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Softmax over two classes on averaged vectors; gradient steps on small batches, the rate falling to 0.

    Both classes weigh the same in the loss, so the threshold 0.5 does not lean to the larger one; the bias is
    then set on the training documents to the point of best accuracy.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    examples = _weighted_slots(pa.array(texts, pa.string()))
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, done = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            chosen = order[at : at + BATCH]
            hidden = np.stack([examples[i][1] @ vectors[examples[i][0]] for i in chosen])
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            p *= weight[y[chosen]][:, None]
            back = p @ layer.T
            layer -= rate * hidden.T @ p
            bias -= rate * p.mean(0)
            for k, i in enumerate(chosen):
                # Shares of one slot are small; the step is scaled as if a text had few features.
                vectors[examples[i][0]] -= rate * 30 * examples[i][1][:, None] * back[k]
    folded, base = vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])
    raw = np.array([s @ folded[f] for f, s in examples])
    order = np.argsort(raw)
    ones = np.cumsum(y[order])
    right = np.concatenate(([ones[-1]], np.arange(1, len(y) + 1) - ones + ones[-1] - ones))  # cut before, or after each
    best = np.flatnonzero(right == right.max())
    cut = int(best[len(best) // 2])
    edges = np.concatenate(([raw[order][0] - 1], (raw[order][:-1] + raw[order][1:]) / 2, [raw[order][-1] + 1]))
    return Model(folded, -float(edges[cut]) if right.max() > right[0] else base)


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Learns from labelled documents that are not held out, bounded in number and in bytes."""
    use = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), "quality").where(remainder(F.col("_id")) != 1)
    use = use.groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(use), F.col("doc_id") == F.col("_id")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes // 16)
    one = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), one["text"].alias("text"))
    filled = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # train_docs rows at most
    rows = rows.withColumn("filled", filled).where(F.col("filled") <= train_bytes).select("doc_id", "text", "quality")
    rows = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or ""))
    return train([r[1] for r in rows], [int(r[2]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                p = shared.value.score(part.column("text"))
                held = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, SCORES)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is predicted to be of quality 1, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                yield part.filter(pa.array(shared.value.score(part.column("text")) >= 0.5))

    return map_arrow(docs, run, docs.schema)


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
