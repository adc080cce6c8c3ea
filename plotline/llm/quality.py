"""Quality classifier by positive-unlabelled learning.

A linear model of what a text looks like (frequencies of pairs of character classes, repeated and shouted words, lengths)
minimises the non-negative unbiased risk: pi * R+ of trusted positives, plus what is left of the R- of unlabelled web text once
the share of positives in it, pi * R- of trusted positives, is taken off, never below zero. pi, the class prior, is
estimated from the labelled rows of the training folds. Labels, language, source and id are never inputs of a score.

Training reads a bounded sample: at most `positives` trusted rows and `unlabelled` rows, both those with the
lowest hash of their id and text outside the held-out fold; rows alike in both count once. Scores cover all rows and whole texts.

Null texts are empty texts and get a score as any other; a null id is never in the training sample and is not held
out. An id that is labelled both ways counts as trusted. Without trusted positives every score is 0.5. An empty table gives no rows.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

FOLDS = 5
POSITIVES, UNLABELLED = 4000, 8000
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\v\f", ".", ",", "!?", ";:", "'\"`", "()[]{}<>", "|", "*#", "$%&@", "/\\", "-_", "=+~^"]
KIND = np.full(256, len(CLASSES), np.uint8)  # others: control characters
KIND[128:] = 0  # letters beyond ASCII, nearly always
for _k, _s in enumerate(CLASSES):
    KIND[list(_s.encode())] = _k
N = len(CLASSES) + 1
EXTRA = 6
WIDTH = N * N + EXTRA


def features(text: str) -> np.ndarray:
    data = text.encode()
    out = np.zeros(WIDTH, np.float32)
    if not data:
        return out
    kinds = KIND[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kinds[:-1].astype(np.uint16) * N + kinds[1:], minlength=N * N)
    out[: N * N] = np.sqrt(pairs / max(1, len(kinds) - 1))
    words = data.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    out[N * N :] = (
        (same / n) ** 0.5,
        (sum(map(bytes.isupper, words)) / n) ** 0.5,
        (len(set(words)) / n) ** 0.5,
        np.log1p(len(words)) / 10,
        np.log1p(len(data) / n) / 10,
        np.log1p(data.count(b"\n")) / 10,
    )
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias for raw features, by full-batch Adam on the logistic loss."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0) + unlabelled.sum(0)) / n
    p, u = positive - mean, unlabelled - mean
    scale = np.sqrt((np.einsum("ij,ij->j", p, p) + np.einsum("ij,ij->j", u, u)) / n) + 1e-3
    p /= scale
    u /= scale
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda x, g: np.append(x.T @ g, g.sum()) / len(g)
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = grad(u, sigmoid(zu)) - prior * grad(p, sigmoid(zp))
        g = prior * grad(p, sigmoid(zp) - 1) + rest if negative >= 0 else -rest  # a negative risk is an overfit: undo it
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _featured(df: DataFrame) -> DataFrame:
    """doc_id, h, trusted, features of one row of each key."""
    key = ["doc_id", "h", "trusted"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array([features(x).astype(np.float16).tobytes() for x in b.column("text").to_pylist()], pa.binary())], [*key, "features"])

    return df.select(*key, "text").mapInArrow(run, "doc_id long, h long, trusted boolean, features binary").groupBy(*key).agg(F.first("features").alias("features"))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """docs: doc_id, text. labels: doc_id, quality (1: trusted), of which only the training folds are read."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long"), "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not good:
        return np.zeros(WIDTH), 0.0
    prior = good / n
    key = ["doc_id", "h"]
    keyed = docs.where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("text"))
    every = keyed.select(*key).distinct()
    trusted = every.join(known.where("quality = 1").select("doc_id"), "doc_id").orderBy(F.xxhash64(*key), *key).limit(positives).withColumn("trusted", F.lit(True))
    others = every.orderBy(F.xxhash64(*key, F.lit(1)), *key).limit(unlabelled).withColumn("trusted", F.lit(False))
    chosen = spark.createDataFrame(trusted.union(others).toArrow())  # at most positives + unlabelled keys
    rows = _featured(keyed.join(F.broadcast(chosen), key)).toArrow()
    is_trusted, order = rows.column("trusted").to_numpy(), np.lexsort([rows.column(c).to_numpy() for c in (*key, "trusted")])
    x = np.frombuffer(b"".join(rows.column("features").to_pylist()), np.float16).reshape(-1, WIDTH)
    del rows
    sides = [x[order[is_trusted[order] == side]].astype(np.float64) for side in (True, False)]
    del x
    return nn_pu_fit(*sides, prior) if all(map(len, sides)) else (np.zeros(WIDTH), 0.0)


def keep_good(df: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df, with all their columns, whose text scores at least the threshold. Null texts score as empty ones."""

    def run(batches):
        for b in batches:
            z = np.array([features(x or "").astype(np.float64) @ weights for x in b.column(text_col).to_pylist()]) + bias
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= threshold, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            z = np.array([features(x).astype(np.float64) @ weights for x in b.column("text").to_pylist()]) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    docs = id_text(df, id_col, text_col)
    return score(docs, *train(docs, labels), threshold)
