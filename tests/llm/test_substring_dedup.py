import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from plotline.llm import substring_dedup as module
from plotline.llm.substring_dedup import Parsed, Words, substring_dedup

from .helpers import documents, edges, empty, rows, texts


def brute(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, window=35):
    return sorted((tuple(r) for r in substring_dedup(df, window).collect()), key=str)


def test_documents(spark):
    df = documents(spark)
    assert got(df) == brute(texts(df), 35)


def test_edges(spark):
    # a row that is repeated with its text is one document twice over: all of its windows repeat
    df = edges(spark)
    assert got(df) == brute(texts(df), 35)


@pytest.mark.parametrize("seed", range(4))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    alphabet = [f"w{k}" for k in range([2, 5, 40, 2000][seed])]
    passages = [[rng.choice(alphabet) for _ in range(rng.randint(10, 90))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
            w += rng.choice(passages)[rng.randint(0, 5) :]
        docs.append((i, " ".join(w)))
    docs += [(100, " ".join(["same"] * 200)), (101, " ".join(["same"] * 36)), (102, " ".join(["one"] * 35))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(df) == brute(docs, 35)


def test_kept_text(spark):
    text = " ".join(f"t{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"alpha {text} beta"), (2, f"gamma {text}")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substring_dedup(df, with_text=True).collect()} == {1: "alpha beta", 2: "gamma"}


def test_anchors_do_not_depend_on_the_place_in_a_chunk():
    rng = random.Random(3)
    hashes = Words()
    for _ in range(50):
        text, other = (hashes([b"v%d" % rng.randrange(500) for _ in range(60)]) for _ in range(2))
        alone, behind = Parsed([text]), Parsed([other, text])
        held = behind.doc == 1
        assert alone.key.tolist() == behind.key[held].tolist() and alone.at.tolist() == behind.at[held].tolist()


def test_repeated_texts_first_in_small_batches(spark):
    rng = random.Random(4)
    texts_ = [" ".join(f"v{rng.randrange(500)}" for _ in range(40)) for _ in range(30)]
    # each text comes first in a batch of its own, and again inside another document
    docs = [(k, t) for k, t in enumerate(texts_)] + [(100 + k, f"lead {k} {t} tail") for k, t in enumerate(texts_)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs, 35)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("parts", [1, 4, 37, 211])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = documents(spark).select("doc_id", "text")
    want = brute(texts(df), 35)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got(df.repartition(parts)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("held,remembered,tasks", [(400_000, 4_000_000, 1), (30, 10, 3), (1, 0, 2), (200, 50, 5)])
def test_tasks_that_forget(monkeypatch, held, remembered, tasks):
    """The steps by hand: what a task remembers and gathers at once does not change what is found."""
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "REMEMBERED", remembered)
    rng = random.Random(held)
    passages = [[f"w{rng.randrange(9)}" for _ in range(rng.randint(4, 14))] for _ in range(5)] + [["same"] * 9]
    docs = []
    for i in range(80):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages) + [f"v{rng.randrange(1000)}"] * rng.randint(0, 2)
        docs.append((i, " ".join(words)))

    def batches(rows, schema, size=7):
        for k in range(0, len(rows), size):
            yield pa.RecordBatch.from_pylist(rows[k : k + size], schema)

    def dealt(rows, by, key):
        return [sorted((r for r in rows if key(r) % tasks == t), key=by) for t in range(tasks)]

    def run(step, parts, schema):
        return [r for part in parts for b in step(batches(part, schema)) for r in b.to_pylist()]

    text = pa.schema([("uid", pa.int64()), ("text", pa.string())])
    rows_ = [{"uid": i, "text": t} for i, t in docs]
    window = 5
    asked = run(module._anchors(window), dealt(rows_, lambda r: r["uid"], lambda r: r["uid"]), text)
    if tasks == 1:
        assert max(Counter(r["key"] for r in asked if not r["told"]).values()) == 1
    found = run(module._repeated_anchors, dealt(asked, lambda r: 0, lambda r: r["key"]), pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("at", pa.int32()), ("told", pa.bool_())]))
    places = {}
    for r in found:
        places.setdefault(r["uid"], set()).add(r["at"])
    again = [r | {"places": sorted(places[r["uid"]])} for r in rows_ if r["uid"] in places]
    runs = run(module._regions(window), dealt(again, lambda r: r["uid"], lambda r: r["uid"]), text.append(pa.field("places", pa.list_(pa.int32()))))
    spans = run(module._repeated_windows, dealt(runs, lambda r: r["key"], lambda r: r["key"]), pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("at", pa.int32()), ("count", pa.int32()), ("hashes", pa.binary())]))
    covered = {}
    for r in spans:
        covered.setdefault(r["uid"], set()).update(range(r["first"], r["last"] + window))
    assert [(i, len(covered.get(i, ()))) for i, _ in docs] == [(w[0], w[2]) for w in sorted(brute(docs, window))]


def test_empty_table(spark):
    assert rows(substring_dedup(empty(spark))) == []
