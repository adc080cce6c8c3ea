import random
import re

import pytest

from plotline.llm.decontaminate import decontaminate

from .helpers import SMALL, documents, edges, empty, rows, texts

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and then meets Alice near the bridge after 3 hours of travel today"),
    (2, "How many apples does the farmer sell when 12 boxes of 7 kg each are carried to the market by Maria on Monday"),
    (3, "short item only"),
    (4, None),
    (None, "an item without an id cannot be named by any row of the result at all"),
    (1, "A train leaves Boston at 60 km per hour and then meets Alice near the bridge after 3 hours of travel today"),
]
DOCS = [
    (10, "Some words first. A train leaves Boston at 60 km per hour and then meets Alice near the bridge after 3 hours of travel today. More."),
    (11, "Intro. A train leaves Denver at 85 miles per hour and then meets Bob near the bridge after 4 hours of travel today"),
    (12, "This text has a train and a bridge and apples and the market, but none of the questions in it at all, nor many boxes."),
    (13, "How many apples does the farmer sell"),
    (14, "how MANY apples does the farmer sell when 5 boxes of 9 kg each are carried to the market by Maria on Monday"),
    (14, "how MANY apples does the farmer sell when 5 boxes of 9 kg each are carried to the market by Maria on Monday"),
    (None, "How many apples does the farmer sell when 12 boxes of 7 kg each are carried to the market by Maria on Monday"),
]


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_other_numbers_names_and_units(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(docs, items)
    assert pairs(got) == {(10, 1), (11, 1), (14, 2)}
    same = {r.doc_id: r.same_words for r in got.collect()}
    assert same == {10: True, 11: False, 14: False}


def test_slots_have_to_correspond(spark):
    item = "we add 5 apples to 7 pears and then take 5 apples from 7 pears and count 5 apples with 7 pears again and 5 plums"
    good = item.replace("5", "8").replace("7", "9")
    numbers = iter(range(100, 200))
    bad = re.sub(r"\d+", lambda m: str(next(numbers)), item)
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert pairs(decontaminate(docs, items)) == {(1, 7)}


def spelled(words):
    """Template and words of a text without sentence ends: numbers, names and units behind numbers are slots."""
    out = []
    for k, w in enumerate(words):
        kind = "number" if w.isdigit() else "unit" if w in ("km", "kg") and k and words[k - 1].isdigit() else "name" if k and w[0].isupper() else None
        out.append((kind or w.lower(), w.lower(), kind is not None))
    return out


def held(doc, item, size, least, covered):
    """The most words of any stretch of a document that the item holds at the same distance, with one value for one value. By trying all of them."""
    d, t = spelled(doc), spelled(item)
    s = min(size, len(t))
    if s < least:
        return 0
    best = 0
    for shift in range(-len(t), len(d)):
        on = set()
        for p in range(len(t) - s + 1):
            q = p + shift
            if q < 0 or q + s > len(d):
                continue
            both = list(zip(t[p : p + s], d[q : q + s]))
            bare = all(x[2] for x, _ in both)
            if all(x[0] == y[0] for x, y in both) and all(y[2] for _, y in both) == bare and (not bare or all(x[1] == y[1] for x, y in both)):
                on |= set(range(p, p + s))
        for a in on:
            pairs, b = set(), a
            while b in on:
                if t[b][2]:
                    pairs |= {(t[b][1], d[b + shift][1])}
                    if len({x for x, _ in pairs}) < len(pairs) or len({y for _, y in pairs}) < len(pairs):
                        break
                b += 1
                best = max(best, b - a)
    return best if best and best >= min(covered, len(t)) else 0


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 5), (3, 1)])
def test_against_all_stretches(spark, seed, least):
    rng = random.Random(seed)
    word = lambda: rng.choice(["red", "green", "blue", "house", "river"] + ["Alice", "Bob", "Carol"] + [str(rng.randint(1, 4))] * 2)

    def text(n):
        out = ["the"]
        while len(out) < n:
            out.append(word())
            if out[-1].isdigit() and rng.random() < 0.5:
                out.append(rng.choice(["km", "kg"]))
        return out

    def renamed(words):
        names, numbers = dict(zip(["Alice", "Bob", "Carol"], rng.sample(["Dora", "Eve", "Frank", "Alice"], 3))), dict(zip("1234", rng.sample("56789123", 4)))
        return [names.get(w, numbers.get(w, w)) for w in words]

    items = {k: text(rng.randint(1, 30)) for k in range(12)} | {12: [*"1234123412341", "km"], 13: ["the", *"1111222233334444"]}
    docs = []
    for i in range(40):
        words = text(rng.randint(0, 12))
        for _ in range(rng.randint(0, 3)):
            x = items[rng.randrange(14)]
            a = rng.randrange(len(x))
            part = x[a : a + rng.randint(1, 30)]
            part = renamed(part) if rng.random() < 0.6 else list(part)
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = word()
            words += part + text(rng.randint(1, 6))
        docs.append((i % 33, words))
    want = {}
    for i, d in docs:
        for k, x in items.items():
            if n := held(d, x, 6, least, 7):
                want[i, k] = max(n, want.get((i, k), 0))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in decontaminate(df, bench, size=6, least=least, covered=7).collect()}
    assert got == want and len(want) > 10


def test_unlike_texts_under_one_id(spark):
    """Each of the texts of a document or an item gives its pairs."""
    a, b = ITEMS[0][1], ITEMS[1][1]
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " " + b)], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (8, b), (9, a), (9, b)], "item_id long, text string")
    assert pairs(decontaminate(docs, items)) == {(d, i) for d in (1, 2) for i in (7, 8, 9)}


def test_short_items_where_they_are_asked_for(spark):
    docs = spark.createDataFrame([(1, "there is a short item only in here"), (2, "short of item only")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert pairs(decontaminate(docs, items, least=1)) == {(1, 3)}


def test_verbatim_items_are_found(spark):
    """Every document that holds an item's words one after the other is reported."""
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    df = documents(spark)
    got = pairs(decontaminate(df, bench))
    items = {r.item_id: " " + " ".join((r.text or "").split()) + " " for r in bench.collect()}
    want = {(i, k) for i, t in texts(df) for k, x in items.items() if len(x.split()) >= 5 and x in " " + " ".join((t or "").split()) + " "}
    assert want <= got
    words = {k: set(x.lower().split()) for k, x in items.items()}
    for i, k in got - want:  # partly or changed: at least a third of the item's words are there
        t = set(dict(texts(df))[i].lower().split())
        assert len(words[k] & t) * 3 >= min(len(words[k]), 13), (i, k)


def test_edges_and_empty_tables(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert rows(decontaminate(edges(spark), bench)) == []
    assert rows(decontaminate(empty(spark), bench)) == []
    assert rows(decontaminate(edges(spark), bench.where("false"))) == []
