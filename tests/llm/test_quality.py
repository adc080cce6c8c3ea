import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from plotline.llm import quality as classifier
from plotline.llm.common import id_text
from plotline.llm.quality import features, keep_good, nn_pu_fit, quality, train

from .helpers import edges, empty, rows

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = quality(docs, labels)
    assert got.count() == docs.count()
    known = got.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").toPandas()
    assert auc(known.score.to_numpy(), known.quality.to_numpy()) >= 0.9
    good = known[known.quality == 1]
    assert (good.predicted == 1).mean() >= 0.95
    assert ((known.predicted == known.quality).mean()) >= 0.8
    assert ((got.where("(score >= 0.3) <> (predicted = 1)").count())) == 0


def test_folds_and_inputs(spark):
    docs, labels = tables(spark)
    got = quality(docs, labels).select("doc_id", "held_out", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    # labels of the held-out fold and other columns change nothing
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), other).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_risk_never_goes_negative_far():
    rng = np.random.default_rng(0)
    p = rng.normal(1.5, 1, (400, 6))
    u = np.concatenate([rng.normal(1.5, 1, (300, 6)), rng.normal(-1.5, 1, (300, 6))])
    w, b = nn_pu_fit(p, u, 0.5)
    s = 1 / (1 + np.exp(-(u @ w + b)))
    assert (s[:300] > 0.5).mean() > 0.95 and (s[300:] < 0.5).mean() > 0.95


def test_fit_is_the_plain_risk():
    """The same steps, each row's loss and gradient worked out by itself."""
    rng = np.random.default_rng(5)
    p, u, prior, steps, decay = rng.normal(1, 1, (13, 3)), rng.normal(0, 1, (17, 3)), 0.4, 40, 1e-5
    every = [list(map(float, r)) for r in (*p, *u)]
    mean = [sum(r[j] for r in every) / len(every) for j in range(3)]
    scale = [(sum((r[j] - mean[j]) ** 2 for r in every) / len(every)) ** 0.5 + 1e-3 for j in range(3)]
    plain = lambda rows: [[(r[j] - mean[j]) / scale[j] for j in range(3)] + [1.0] for r in rows]
    ps, us = plain(p), plain(u)
    w, m, v = [0.0] * 4, [0.0] * 4, [0.0] * 4
    for t in range(1, steps + 1):
        z = lambda r: sum(a * b for a, b in zip(w, r))
        as_negative = lambda rows: sum(math.log(1 + math.exp(z(r))) for r in rows) / len(rows)
        slope = lambda rows, shift: [sum((1 / (1 + math.exp(-z(r))) - shift) * r[j] for r in rows) / len(rows) for j in range(4)]
        rest = [a - prior * b for a, b in zip(slope(us, 0), slope(ps, 0))]
        up = slope(ps, 1)
        g = [prior * a + b for a, b in zip(up, rest)] if as_negative(us) - prior * as_negative(ps) >= 0 else [-b for b in rest]
        g = [a + decay * b * (j < 3) for j, (a, b) in enumerate(zip(g, w))]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g)]
        w = [a - 0.1 * (b / (1 - 0.9**t)) / ((c / (1 - 0.999**t)) ** 0.5 + 1e-8) for a, b, c in zip(w, m, v)]
    weights, bias = nn_pu_fit(p, u, prior, steps)
    want = [a / s for a, s in zip(w, scale)]
    assert np.allclose(weights, want, atol=1e-8) and abs(bias - (w[3] - sum(a * b for a, b in zip(want, mean)))) < 1e-8


def test_the_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(classifier, "nn_pu_fit", lambda p, u, prior, *a: taken.append((len(p), len(u))) or (np.zeros(p.shape[1]), 0.0))
    many = spark.range(5000).select(F.lit(2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    same = spark.range(3000).select(F.lit(3).alias("doc_id"), F.lit("one text").alias("text"))
    rest = spark.range(10, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(2, 1), (3, 1), (11, 0), (12, 1)], "doc_id long, quality int")
    docs = many.union(same).union(rest)
    outside = [i for i in range(10, 60) if zlib.crc32(str(i).encode()) % 5]
    train(docs, labels)
    train(docs, labels, positives=40, unlabelled=70)
    ids = [i for i in (2, 3, 12) if zlib.crc32(str(i).encode()) % 5]
    assert taken == [(4000 if 2 in ids else len(ids), (5000 if 2 in ids else 0) + (3 in ids) + len(outside)), (40 if 2 in ids else len(ids), 70 if 2 in ids else len(outside) + 1)]


def test_edges_and_empty_tables(spark):
    docs, labels = tables(spark)
    weights, bias = train(id_text(docs), labels)
    df = edges(spark)
    got = quality(df.unionByName(docs, allowMissingColumns=True), labels)
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert set(keep_good(df, weights, bias).columns) == set(df.columns)
    assert rows(quality(empty(spark), labels)) == []
    assert {r.score for r in quality(df, labels.where("false")).collect()} == {0.5}


def test_features_of_odd_texts():
    for t in ["", " ", "a", "\x00\x7f", "é" * 10, "x" * 100_000]:
        assert np.isfinite(features(t)).all()
