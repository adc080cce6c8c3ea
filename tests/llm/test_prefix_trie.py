import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import prefix_trie
from plotline.llm.prefix_trie import Louds, _keys, rebuilt_trie
from plotline.llm.prefix_trie import prefix_trie as plain_trie

from .helpers import CLASHING, LONG, SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def grouped(found):
    own = defaultdict(list)
    for c, turn, role, text in found:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(np.fmod(c, 5))
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, last = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        last[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    return sorted(
        str((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(last[node]))).encode()).hexdigest())) for node, m in members.items()
    )


def got(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


SCHEMA = "conv_id long, turn long, role string, text string"
EDGES = [
    (None, 0, "user", "nobody's"),
    (10, None, "user", "first, as its turn is null"),
    (10, 0, None, None),
    (10, 0, "", ""),
    (10, 7, "user", LONG),
    (11, 1, "user", "b"),
    (11, 0, "user", "żółć 🎉"),
    (12, 0, "user", "żółć 🎉"),
    (12, 1, "user", "b"),
    (12, 1, "user", "b"),
    (13, 0, "use", "rb"),
    (-3, 0, "user", "below zero"),
    (-5, 0, "user", "below zero"),
    (4, 0, "user", "alone, its first does not exist"),
]


@pytest.mark.parametrize("heavy", [None, 0, 3, 1 << 40])
def test_whole_table(spark, heavy):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    own = grouped([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got(rebuilt_trie(df, heavy=heavy)) == brute(rebuilt(own))


@pytest.mark.parametrize("heavy", [None, 0])
def test_edges(spark, heavy):
    df = spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit(1) for c in (*CLASHING, "depth", "k1", "h", "first", "length", "root")})
    assert got(rebuilt_trie(df, heavy=heavy)) == brute(rebuilt(grouped(EDGES)))
    assert got(plain_trie(df, heavy=heavy)) == brute(grouped(EDGES))


@pytest.mark.parametrize("heavy, chunk", [(0, 4), (5, 7), (50, 1024)])
def test_shared_beginnings_and_long_conversations(spark, monkeypatch, heavy, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    found = [(int(c), t, "user" if t % 2 else "assistant", f"{'ab'[rng.integers(2)]}") for c in range(60) for t in range(rng.integers(1, 9))]
    found += [(100, t, "user", "a") for t in range(40)] + [(101, t, "user", "a") for t in range(41)] + [(200 + c, 0, "user", "hot") for c in range(80)]
    df = spark.createDataFrame(found, SCHEMA).repartition(5)
    assert got(plain_trie(df, heavy=heavy)) == brute(grouped(found))
    assert got(rebuilt_trie(df, heavy=heavy)) == brute(rebuilt(grouped(found)))


def test_empty_tables(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    assert got(rebuilt_trie(df.where("false"))) == [] and got(plain_trie(df.where("conv_id is null"))) == []


def test_louds_of_a_forest():
    #      7       8        roots of unlike depths
    #     / \      |
    #    1   2     4
    #    |
    #    3
    depth = np.array([2, 2, 3, 6, 1, 5])
    k = np.array([1, 2, 3, 4, 7, 8], np.int64)
    p = np.array([7, 7, 1, 8, 0, 0], np.int64)
    root = p == 0
    trie, rows = Louds.build(depth, _keys(depth, k, k), _keys(depth - 1, p, p), root)
    assert k[rows].tolist() == [7, 8, 1, 2, 4, 3]
    assert trie.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0, 0]
    assert trie.parent[1:].tolist() == [0, 0, 1, 1, 2, 3] and trie.children.tolist() == [2, 2, 1, 1, 0, 0, 0]
    assert trie.rollup(np.array([0, 1, 10, 100, 1000, 10000, 100000])).tolist()[1:] == [101101, 10010, 100100, 1000, 10000, 100000]
