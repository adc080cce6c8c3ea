import os
import random
import re

import pytest

from plotline.llm.common import discard, stash
from plotline.llm.ngram_join import components, max_difference, ngram_components

from .helpers import documents, edges, empty, rows, texts

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n, percent):
    docs = [d for d in docs if d[0] is not None]
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    best = {}
    for k, (i, _) in enumerate(docs):
        if i not in best or len(sets[k]) > len(sets[best[i]]):
            best[i] = k
    return sorted((i, len(sets[k]), least[find(k)]) for i, k in best.items())


@pytest.mark.parametrize(("make", "n", "percent"), [(documents, 4, 85), (documents, 5, 80), (edges, 4, 85)])
def test_matches_brute_force(spark, make, n, percent):
    df = make(spark)
    assert rows(ngram_components(df, n, percent)) == brute(texts(df), n, percent)


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies(spark, seed):
    """Copies at similarities around the threshold, in chains, of short and long texts."""
    rng = random.Random(seed)
    docs = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 6, 9, 14, 40, 200]))]
        for _ in range(rng.randint(1, 5)):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [f"n{rng.randint(0, 99)}"] * rng.choice([0, 1])
                words = words or ["x"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(ngram_components(df, 4, 85)) == brute(docs, 4, 85)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    assert rows(components(e)) == [(k, 1) for k in (1, 2, 3, 7, 8, 9)] + [(20, 20), (21, 20)]
    assert rows(components(e.where("false"))) == []


def test_bound_on_differences():
    for a in range(1, 60):
        for b in range(a, 80):
            most = max((a + b - 2 * i for i in range(a + 1) if 100 * i >= 85 * (a + b - i)), default=-1)
            assert most <= max_difference(a, b, 85) or most < 0


def held(spark):
    """Files of shuffles on the disk but those of a single row, and tables in the shared folder, by their names."""
    from plotline.llm.common import shared_dir

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = {n for k in range(blocks.size()) if (n := blocks.apply(k).getName()).endswith(".data") and blocks.apply(k).length() > 200}
    return files, {f for f in os.listdir(shared_dir(spark).removeprefix("file:"))}


def test_what_is_shuffled_and_stashed_goes_as_soon_as_it_is_used(spark):
    df = stash(documents(spark).select("doc_id", "text").repartition(3))
    before = held(spark)
    ngram_components(df, 5, 80)
    after = held(spark)
    assert not after[0] - before[0]
    left = {f.rpartition("-")[0] for f in after[1] - before[1]}
    assert {"nodes", "sets", "roots"} <= left and not left & {"keys", "scores", "members", "cuts", "placed"}
    discard(df)
    assert len(held(spark)[1]) == len(after[1]) - 1


def test_empty_table(spark):
    assert rows(ngram_components(empty(spark))) == []
