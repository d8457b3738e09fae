"""Operator 6: document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Every passage is encoded: shares of byte classes and of
pairs of neighbouring byte classes, word count, mean word length and share of distinct words, then a
learned layer h = tanh(xW + b). Gated attention a = softmax(w . (tanh(hV) * sigmoid(hU))) weighs the
passages, and the weighted sum of h gives the score of the text. All of it is learned from document
labels only, on a bounded sample: of the labelled rows whose crc32(id) mod FOLDS is not HELD_OUT, the
TRAIN_ROWS with the least hash, one text of each id, and of each text TRAIN_PASSAGES passages at most, evenly
spread. Texts of the sample reach the driver only as features. Scoring is one pass
without a shuffle; all passages of all texts are used and the memory of a task does not depend on their number.

Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text is one empty passage and gets a score like any other; a null id is
not held out; repeated rows get equal scores; rows of labels without a document or with a null label do
not count, of several labels of an id the rounded mean does; without any label or with one class
only, every score is the share of label 1 (0.5 without labels); empty tables give empty results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packed import column, prefix_hash, range_hash, slices, words

PASSAGE = 64
FOLDS, HELD_OUT = 4, 2
TRAIN_ROWS = 3000
#: Passages of a text that are trained on.
TRAIN_PASSAGES = 256
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 256, 0.01, 1e-4
CUT = 0.7

#: Classes of bytes.
_GROUPS = (" ", "\n", "\t\r\v\f", "aeiou", "bcdfg", "hjklm", "npqrs", "tvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", ".", ",", "!", "?", "|", "%", "#", "$", "&", "*", "'\"", "-_/\\", ":;", "()[]{}<>")
CLASSES = len(_GROUPS) + 3
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k
_CLASS[0x80:0xC0] = len(_GROUPS) + 1
_CLASS[0xC0:] = len(_GROUPS) + 2
FEATURES = CLASSES + CLASSES**2 + 3


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each row its first passage (one more at the end)."""
    starts, ends, lo, hi = words(data, offsets)
    n = np.maximum(1, -(-(hi - lo) // PASSAGE))
    first = np.r_[0, np.cumsum(n)]
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not total:
        return out, first
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(total) - first[row]
    # where each passage begins: its first word, the first one of a row at the row's first byte
    begin = offsets[:-1][row]
    later = rank > 0
    begin[later] = starts[lo[row[later]] + rank[later] * PASSAGE]
    size = np.diff(np.r_[begin, len(data)])
    of_byte = np.repeat(np.arange(total), size)
    kind = _CLASS[data]
    one = np.bincount(of_byte * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    inside = of_byte[1:] == of_byte[:-1]
    two = np.bincount((of_byte[1:] * CLASSES + kind[:-1])[inside] * CLASSES + kind[1:][inside], minlength=total * CLASSES**2).reshape(total, CLASSES**2)
    length = np.maximum(1, size)[:, None]
    out[:, :CLASSES] = np.sqrt(one / length)
    out[:, CLASSES:-3] = np.sqrt(two / length)
    of_word = np.repeat(first[:-1], hi - lo) + (np.arange(len(starts)) - np.repeat(lo, hi - lo)) // PASSAGE
    count = np.bincount(of_word, minlength=total)
    chars = np.bincount(of_word, ends - starts, total)
    h = range_hash(prefix_hash(data), starts, ends)
    order = np.lexsort((h, of_word))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])][: len(h)]
    distinct = np.bincount(of_word[order][fresh], minlength=total)
    out[:, -3] = count / PASSAGE
    out[:, -2] = chars / np.maximum(1, count) / 8
    out[:, -1] = distinct / np.maximum(1, count)
    return out, first


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Gated-attention network over bags of passages, trained by Adam on the log loss."""

    def __init__(self, features=FEATURES, seed=7):
        rnd = np.random.default_rng(seed)
        draw = lambda *s: (rnd.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": draw(features, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.scale, self.share = np.zeros(features, np.float32), np.ones(features, np.float32), None

    def forward(self, x, first):
        """Scores of the bags x[first[i]:first[i + 1]] and what the gradients need."""
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return _sigmoid(z @ p["c"] + p["d"]), (x, h, t, g, a, z, bag)

    def gradients(self, x, first, y, weight):
        p = self.p
        s, (x, h, t, g, a, z, bag) = self.forward(x, first)
        ds = ((s - y) * weight / len(y)).astype(np.float32)
        dz = ds[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz[bag] * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs=EPOCHS, seed=7):
        self.share = float(y.mean()) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            return self
        n = sum(map(len, bags))
        mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
        square = sum(np.square(b, dtype=np.float64).sum(0) for b in bags) / n
        self.mean = mean.astype(np.float32)
        self.scale = (1 / np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-2)).astype(np.float32)
        self.share = None
        rnd, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rnd.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                first = np.r_[0, np.cumsum([len(bags[i]) for i in pick])]
                grad = self.gradients(np.concatenate([bags[i] for i in pick]).astype(np.float32), first, y[pick], np.ones(len(pick), np.float32))
                step += 1
                for k, x in self.p.items():
                    got = grad[k] + DECAY * x
                    m[k] = 0.9 * m[k] + 0.1 * got
                    v[k] = 0.999 * v[k] + 0.001 * got * got
                    x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x, first):
        if self.share is not None:
            return np.full(len(first) - 1, self.share)
        return self.forward(x, first)[0].astype(np.float64)


def _encode(most):
    """The features of the passages of each text, most of them at most, evenly spread."""

    def encode(batches):
        for batch in batches:
            data, offsets = column(batch, "text")
            blobs = []
            for _, part, offs in slices(data, offsets, 1 << 20):
                x, first = passages(part, offs)
                x = x.astype(np.float16)
                for a, b in zip(first, first[1:], strict=False):
                    blobs.append(x[np.linspace(a, b - 1, min(b - a, most)).round().astype(np.int64)].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "y", "h")), pa.array(blobs, pa.binary())], ["id", "y", "h", "x"])

    return encode


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", label="quality", rows=TRAIN_ROWS, most=TRAIN_PASSAGES) -> Model:
    """Fit on at most rows labelled documents outside the held-out fold, most passages of each."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("q")).where("id is not null and q is not null")
    known = known.groupBy("id").agg(F.round(F.avg("q")).cast("double").alias("y")).where(~held_out("id"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # at most rows ids and labels, so they may be broadcast
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")
    # of a repeated id the text with the least hash counts, so no more than rows texts reach the driver
    chosen = texts.groupBy("id").agg(F.min(F.xxhash64("text")).alias("h"))
    kind = docs.schema[doc_id].dataType.simpleString()
    coded = texts.select("id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(_encode(most), f"id {kind}, y double, h long, x binary")
    got = coded.dropDuplicates(["id", "h"]).join(F.broadcast(chosen), ["id", "h"]).select("x", "y").collect()
    got = sorted(((r.x, r.y) for r in got), key=lambda r: (bytes(r[0]), r[1]))
    bags = [np.frombuffer(x, np.float16).reshape(-1, FEATURES) for x, _ in got]
    return Model().fit(bags, np.array([y for _, y in got], np.float32))


def score(docs: DataFrame, model: Model, text="text", doc_id="doc_id", cut=CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = column(batch, "text")
            s = [sent.value.score(*passages(part, offs)) for _, part, offs in slices(data, offsets, 1 << 20)]
            s = np.clip(np.concatenate(s), 0, 1) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
