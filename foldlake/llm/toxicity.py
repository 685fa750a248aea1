"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A text is lower-cased in A-Z and cut into overlapping segments of words. Every n-gram of 3 to 6 bytes inside a word
(the blank before and after belongs to it) has a hashed row in an embedding table; a segment is the average of its
rows, a linear softmax scores it, and table and softmax are trained jointly in numpy. Misspelt and unseen words share
most n-grams with their relatives. A document is as toxic as its worst segment, mapped to 0..1 by a logistic curve
fitted on labelled rows by tables that they were kept from in turn.

Training reads a bounded sample of labelled rows (``per_label`` rows a label, texts of at most ``train_bytes`` bytes,
in the order of a hash of the id); scoring covers every whole text in tasks that need one scalar an n-gram row.

Defined results: a null or blank text gets the score of the lowest segment score there is; without labels of both
kinds every score is the share of toxic labels (0 without labels); repeated rows are scored alike; null ids are never
trained on; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, table
from .hmm import split

ROWS, WIDTH = 1 << 17, 8
SIZES = (3, 4, 5, 6)
SEGMENT, STRIDE = 6, 3
PER_LABEL, TRAIN_BYTES = (1500, 2500), 20_000  # toxic, not toxic
THRESHOLD, RATE, FOLDS = 0.7, 0.3, 2


def grams(text: str | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, int]:
    """(byte positions, row numbers) of the n-grams of each size, the word starts, and the length in bytes."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return [], np.empty(0, np.int64), 0
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blank = a == 32
    inside = np.r_[0, np.cumsum(blank)]
    out, h, a64 = [], np.zeros(len(a), np.uint64), a.astype(np.uint64)
    for n in range(1, min(max(SIZES), len(a)) + 1):
        h = h[: len(a) - n + 1] * np.uint64(0x100000001B3) + a64[n - 1 :]
        if n in SIZES:
            pos = np.flatnonzero(inside[n - 1 : len(a)] == inside[1 : len(a) - n + 2])  # no blank but at the ends
            x = h[pos]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((pos, ((x >> np.uint64(40)) % np.uint64(ROWS)).astype(np.int32)))
    return out, np.flatnonzero(blank)[:-1], len(a)


def segments(starts: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 byte of each run of SEGMENT words."""
    first = np.arange(0, max(1, len(starts) - SEGMENT + stride), stride)
    return starts[first], np.r_[starts, length][np.minimum(first + SEGMENT, len(starts))]


def bags(doc, chosen=None) -> list[np.ndarray]:
    """Row numbers of each segment side by side, or of the chosen ones."""
    sizes, starts, length = doc
    a, b = segments(starts, length, SEGMENT)
    keep = range(len(a)) if chosen is None else chosen
    cuts = [(ids, np.searchsorted(pos, a), np.searchsorted(pos, b)) for pos, ids in sizes]
    return [np.concatenate([ids[i[k] : j[k]] for ids, i, j in cuts]) for k in keep]


def logits(doc, scalars: np.ndarray, stride: int) -> np.ndarray:
    """Mean logit of each segment."""
    sizes, starts, length = doc
    value, count = np.zeros(length + 1), np.zeros(length + 1)
    for pos, ids in sizes:
        value[pos + 1] += scalars[ids]
        count[pos + 1] += 1
    value, count = np.cumsum(value), np.cumsum(count)
    a, b = segments(starts, length, stride)
    return (value[b] - value[a]) / np.maximum(1, count[b] - count[a])


class Model:
    """Embeddings (ROWS x WIDTH), softmax weights (WIDTH x 2) and bias, and the logistic curve of documents."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
        self.out = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)
        self.past, self.out_past = np.zeros_like(self.table), np.zeros_like(self.out)
        self.bias = np.zeros(2, np.float32)
        self.curve = (1.0, 0.0)

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int, rate: float, seed: int, batch: int = 128) -> None:
        """Joint gradient steps of table, weights and bias, each scaled by its own past (Adagrad); labels weigh alike."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, len(y) / 2 / max(1, y.sum()), len(y) / 2 / max(1, (1 - y).sum())).astype(np.float32)
        for _ in range(rounds):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                sizes = np.array([len(bags[i]) for i in own])
                flat = np.concatenate([bags[i] for i in own])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                h = np.add.reduceat(self.table[flat], starts, axis=0) / sizes[:, None].astype(np.float32)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), y[own]] -= 1
                g = p * weight[own][:, None]
                back = np.repeat((g @ self.out.T) / sizes[:, None], sizes, axis=0)
                ids, inverse = np.unique(flat, return_inverse=True)
                grad = np.stack([np.bincount(inverse, weights=back[:, c], minlength=len(ids)) for c in range(WIDTH)], 1).astype(np.float32)
                self.past[ids] += grad**2
                self.table[ids] -= rate * grad / np.sqrt(self.past[ids] + 1e-6)
                grad = h.T @ g
                self.out_past += grad**2
                self.out -= rate / 4 * grad / np.sqrt(self.out_past + 1e-6)
                self.bias -= rate * g.mean(0)

    def scalars(self) -> tuple[np.ndarray, float]:
        """One logit an n-gram row, and the bias: all that scoring needs."""
        w = self.out[:, 1] - self.out[:, 0]
        return (self.table @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def worst(doc, scalars: np.ndarray, bias: float) -> float:
    """Largest logit of a segment; minus infinity without words."""
    return float(logits(doc, scalars, STRIDE).max()) + bias if doc[2] else -np.inf


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over x."""
    m, s = x.mean(), x.std() + 1e-6
    u, a, b = (x - m) / s, 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        a, b = a - 0.5 * (((p - y) * u).mean() + 0.002 * a), b - 0.5 * (p - y).mean()
    return a / s, b - a * m / s


def _learn(docs: list, rounds: int, again: int, seed: int) -> Model:
    """docs: (grams, toxic). Segments first learn the label of their document, then toxic documents are left with their worst ones."""
    model = Model(seed)
    for k in range(again + 1):
        own, y = [], []
        scalars, _ = model.scalars()
        for doc, label in docs:
            v = logits(doc, scalars, SEGMENT) if k else []
            got = bags(doc, np.argsort(-v)[: max(1, len(v) // 8)] if k and label else None)
            own += [g for g in got if len(g)]
            y += [label] * sum(1 for g in got if len(g))
        model.fit(own, np.array(y), rounds=rounds if not k else 1, rate=RATE, seed=seed + k)
    return model


def train(rows: list[tuple[str, int]], rounds: int = 2, again: int = 3, seed: int = 5, folds: int = FOLDS) -> Model:
    """rows: (text, toxic). The table learns from all rows; the curve from scores that each row gets of a table that
    the row's own fold was kept from."""
    docs = [(d, y) for d, y in ((grams(t), y) for t, y in rows) if d[2]]
    x, y = [], []
    for f in range(folds):
        own = [d for k, d in enumerate(docs) if k % folds != f]
        if 0 < sum(label for _, label in own) < len(own):
            scalars, bias = _learn(own, rounds, again, seed).scalars()
            for d, label in docs[f::folds]:
                x.append(worst(d, scalars, bias))
                y.append(label)
    model = _learn(docs, rounds, again, seed)
    model.curve = _logistic(np.array(x), np.array(y))
    return model


def _scored(logit, bias, curve, otherwise):
    def run(batches):
        for b in batches:
            v = np.array([worst(grams(t.as_py()), logit, bias) for t in b.column(1)]) if logit is not None else np.empty(len(b))
            if logit is not None:
                lowest = float(logit.min()) + bias
                p = 1 / (1 + np.exp(-np.clip(curve[0] * np.where(np.isfinite(v), v, lowest) + curve[1], -30, 30)))
            else:
                p = np.full(len(v), otherwise)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p)], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, training: Column, per_label=PER_LABEL, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score for every row; learns from rows of docs where ``training`` holds (null: it does not)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~F.coalesce(training, F.lit(False))).alias("held_out"))
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("l_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
    fits = d.filter(~F.col("held_out") & (F.octet_length("text") <= train_bytes)).select("doc_id", F.xxhash64("text").alias("o_text"))
    rows_of = fits.join(marks, F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "toxic").agg(F.min("o_text").alias("o_text")).withColumn("o", F.xxhash64("doc_id"))
    picked = [rows_of.filter(F.col("toxic") == y).orderBy("o", "doc_id").limit(most) for y, most in ((1, per_label[0]), (0, per_label[1]))]
    picked = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("p_id"), "toxic", "o_text", "o")  # per_label rows of each
    texts = d.filter(~F.col("held_out")).select("doc_id", "text").join(F.broadcast(picked), (F.col("doc_id") == F.col("p_id")) & (F.xxhash64("text") == F.col("o_text")))
    got = texts.groupBy("doc_id", "toxic", "o").agg(F.min("text").alias("text")).collect()  # one text a row of picked
    rows = [(r["text"], r["toxic"]) for r in sorted(got, key=lambda r: (r["o"], r["doc_id"], r["toxic"]))]
    toxic = sum(y for _, y in rows)
    if 2 <= toxic <= len(rows) - 2:
        m = train(rows)
        logit, bias = m.scalars()
        run = _scored(logit, bias, m.curve, 0.0)
    else:
        run = _scored(None, 0.0, None, toxic / len(rows) if rows else 0.0)
    return d.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double")


def op2_subword_toxicity(spark, sf_dir):
    s = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), split(3) != 1)
    return s.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
