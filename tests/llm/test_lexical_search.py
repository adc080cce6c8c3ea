import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plotline.llm import lexical_search
from plotline.llm.lexical_search import TERM, search

from .helpers import CLASHING, SMALL, documents, edges, empty, rows

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(docs, items, k):
    """Every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // length
            s = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def plain(found):
    return sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in found)


def test_whole_table(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert plain(search(docs, items).collect()) == plain(want)


@pytest.mark.parametrize("k, seeds, pairs, size", [(1, 1, 50, 2), (3, 2, 1000, 5), (7, 1, 1000, 64)])
def test_small_blocks_and_turns(spark, monkeypatch, k, seeds, pairs, size):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", size)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = documents(spark).repartition(3)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert plain(search(docs, items, k, seeds=seeds, pairs=pairs).collect()) == plain(want)


def test_edges(spark):
    docs = edges(spark)
    items = spark.createDataFrame(
        [(1, "one SHORT text"), (2, None), (3, ""), (4, "-- !"), (5, "emoji 🎉🎉 the text gęślą ZAŻÓŁĆ"), (None, "text"), (6, "word1 word2"), (6, "a b c d"), (7, "one short text"), (7, "one short text"), (8, "nowhere-else")],
        "item_id long, text string",
    ).withColumns({c: F.lit(1) for c in CLASHING})
    got = rows(search(docs, items))
    assert plain(got) == plain(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, (r.text or "").translate(LOWER)) for r in items.collect()], 50))
    ranks = defaultdict(list)
    for item, rank, *_ in got:
        ranks[item].append(rank)
    assert sorted(ranks[7]) == list(range(1, len(ranks[7]) + 1)) and None in ranks and 8 not in ranks


def test_many_equal_documents(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300)] + [(1000, "other words")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same"), (2, "words")], "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "same"), (2, "words")], 50)
    assert plain(search(docs, items).collect()) == plain(want)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(search(empty(spark), items)) == []
    assert rows(search(edges(spark), items.where("false"))) == []
