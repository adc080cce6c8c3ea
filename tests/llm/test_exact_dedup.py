import hashlib
from collections import defaultdict

import numpy as np
import pytest

from plotline.llm.exact_dedup import QuotientFilter, exact_dedup, repeated_fingerprints

from .helpers import documents, edges, empty, rows, texts

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for i, t in docs:
        norm = (t or "").translate(UPPER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("make", [documents, edges])
def test_matches_brute_force(spark, make):
    df = make(spark)
    want = sorted(brute(texts(df)), key=str)
    assert sorted((tuple(r) for r in exact_dedup(df).collect()), key=str) == want


def test_empty_table(spark):
    assert rows(exact_dedup(empty(spark))) == []


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 60, 500, dtype=np.uint64)
    parts = [rng.choice(pool, 300) for _ in range(4)]
    merged = [QuotientFilter.unpack(QuotientFilter.build(p, 6, 60).pack()) for p in parts]
    whole = merged[0].merge(*merged[1:])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(whole.fingerprints(), keys)
    assert np.array_equal(whole.counts.astype(int), counts)


@pytest.mark.parametrize("blocks", [1, 16])
def test_counts_of_repeated_fingerprints(spark, blocks):
    values = [-5, -5, 7, 1 << 62, 1 << 62, 1 << 62, 3]
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    assert rows(repeated_fingerprints(df, blocks)) == [(-5, 2), (1 << 62, 3)]
