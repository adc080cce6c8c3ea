"""Conversation prefix tries: every distinct beginning of conversations as a node, with what its subtree shares.

Turns travel as digests. The key of a beginning is the exclusive or of its turns' digests, each mixed with its place
(128 bits), so keys are prefix sums: long conversations are cut into chunks whose sums are joined on, and no
conversation has to lie in one task.

A node under which more than `heavy` turns hang is heavy; the root always is. Heavy nodes are few and closed upwards:
they are counted by partial sums and rolled up among themselves, by doubling the reach of each sum. What hangs below a
heavy node are light subtrees. They are dealt whole to shards, and a shard builds one level-order trie of all its
subtrees in numpy: nodes in breadth-first order, a LOUDS bit vector (for each node a one per child, then a zero), and
arrays of labels. Parents and children are read off the bits, and sums go up in reverse breadth-first order by add.at.
The light roots' sums then join the heavy nodes above them.

Turns are ordered by turn, null first; equal ones by their digests. A null role or text is empty. Rows without
conv_id belong to no conversation and are left out. Ids of the conversations that end in a node are hashed in ascending
order as a stream, from pieces that a sort over all tasks makes. An empty table gives no nodes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stash

CHUNK = 1024
#: Most turns below a light root, and the least that `heavy` falls to on small inputs.
HEAVY, LIGHT = 200_000, 64
#: Nodes that a shard has, about; and up to how many rows the heavy nodes are sent to all tasks.
SHARD_NODES, SENT = 200_000, 500_000
KEY = ["depth", "k1", "k2"]
NODES = "depth int, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, root boolean"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _chunk_base(df: DataFrame, chunk: str, value: Column, total, name: str) -> DataFrame:
    """conv_id, chunk, name: what the chunks of a conversation before this one come to. A conversation of one chunk has no row."""
    before = Window.partitionBy("conv_id").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("conv_id", chunk).agg(value.alias("sum"))
    return sums.withColumn(name, total("sum").over(before)).where(F.col(name).isNotNull()).drop("sum")


def turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (digests), bytes (of the text) of each turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"), F.octet_length(text).alias("bytes")
    )
    rows = stash(rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))), "turns")
    base = _chunk_base(rows, "chunk", F.count("*"), F.sum, "base")
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "t1", "t2"))
    pos = (F.col("place") + F.coalesce("base", F.lit(0))).cast("int")
    return rows.withColumn("place", place).join(base, ["conv_id", "chunk"], "left").select("conv_id", pos.alias("pos"), "t1", "t2", "bytes")


def lengths(placed: DataFrame) -> DataFrame:
    """conv_id, length of each conversation with a turn."""
    return placed.groupBy("conv_id").agg(F.max("pos").alias("length"))


def rebuilt(placed: DataFrame, group: int = 5, span: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does: turns, and conv_id, length of all, turnless ones too.

    Conversation c takes its first h = crc32(c) % span turns from c - c % group, and its own after the first h.
    """
    sizes = lengths(placed)
    own = sizes.select("conv_id", "length", (F.crc32(F.col("conv_id").cast("string")) % span).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("first"))
    heads = sizes.select(F.col("conv_id").alias("first"), F.col("length").alias("there"))
    convs = own.join(heads, "first", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stash(convs.select("conv_id", "first", "h", "lent", (F.col("lent") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "convs")
    head = placed.where(F.col("pos") < span).withColumnRenamed("conv_id", "first")
    lent = head.join(convs, "first").where("pos <= lent").select("conv_id", "pos", "t1", "t2", "bytes")
    rest = placed.join(convs.select("conv_id", "h", "lent"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "t1", "t2", "bytes")
    return lent.union(rest), convs.select("conv_id", "length")


def beginnings(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (key of the first depth turns), p1, p2 (of one less), bytes, left (turns from here on)."""
    own = F.xxhash64(F.lit(3), "pos", "t1", "t2").alias("h1"), F.xxhash64(F.lit(4), "t2", "t1", "pos").alias("h2")
    rows = placed.select("conv_id", F.col("pos").alias("depth"), *own, "bytes", F.floor(F.col("pos") / CHUNK).alias("chunk"))
    total = lambda c: F.bit_xor(F.col(c))
    long = rows.join(convs.where(F.col("length") >= CHUNK).select("conv_id"), "conv_id", "left_semi")
    bases = _chunk_base(long, "chunk", F.bit_xor("h1"), total, "b1").join(_chunk_base(long, "chunk", F.bit_xor("h2"), total, "b2"), ["conv_id", "chunk"])
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    rows = rows.withColumns({"x1": F.bit_xor("h1").over(so_far), "x2": F.bit_xor("h2").over(so_far)}).join(bases, ["conv_id", "chunk"], "left").join(convs, "conv_id")
    key = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)]
    return rows.select("conv_id", "depth", key[0].alias("k1"), key[1].alias("k2"), key[0].bitwiseXOR(F.col("h1")).alias("p1"), key[1].bitwiseXOR(F.col("h2")).alias("p2"), F.col("bytes").cast("long").alias("bytes"), (F.col("length") - F.col("depth") + 1).cast("long").alias("left"))


class Louds:
    """A forest in level order under one super-root (node 0): a one for each child and a zero for each node; labels (input rows) by node from 1 on."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray, top: int):
        self.bits, self.labels = bits, labels
        ones, zeros = np.flatnonzero(bits), np.flatnonzero(~bits)
        #: Of node i (from 1): zeros before its one are nodes whose children are all told.
        self.parent = np.r_[-1, ones - np.arange(len(ones))]
        self.children = np.diff(np.r_[-1, zeros]) - 1
        self.top = top  # nodes 1 .. top are roots

    @classmethod
    def build(cls, depth: np.ndarray, key: np.ndarray, parent_key: np.ndarray, root: np.ndarray) -> tuple["Louds", np.ndarray]:
        """The forest of nodes given in any order, and the input row of each node. Keys as _keys() gives them."""
        order = np.argsort(key)
        level = np.flatnonzero(root)
        level = level[np.argsort(key[level])]
        inner = np.flatnonzero(~root)
        above = order[np.searchsorted(key[order], parent_key[inner])] if len(inner) else inner  # the row of each inner node's parent
        by_parent = np.argsort(above, kind="stable")
        inner, above = inner[by_parent], above[by_parent]
        starts, ends = np.searchsorted(above, np.arange(len(key))), np.searchsorted(above, np.arange(len(key)), side="right")
        rows, counts = [], [np.array([len(level)])]
        while len(level):
            rows.append(level)
            n = (ends - starts)[level]
            counts.append(n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            level = inner[np.repeat(starts[level], n) + place]
        rows, counts = np.concatenate(rows), np.concatenate(counts)
        bits = np.ones(counts.sum() + len(counts), bool)
        bits[np.cumsum(counts + 1) - 1] = False
        return cls(bits, rows, int(counts[0])), rows

    def rollup(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values by node (0 the super-root), level by level from the lowest."""
        total = own.copy()
        edges = [1]
        end = 1 + self.top
        ends = np.cumsum(self.children)  # children of nodes 0 .. i end before node 1 + ends[i]
        while edges[-1] < end:
            edges.append(end)
            end = 1 + int(ends[end - 1])
        for a, b in zip(edges[-2::-1], edges[:0:-1]):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total


def _keys(depth: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Comparable keys: depth and both halves as big-endian bytes."""
    top = np.uint64(1 << 63)
    parts = [depth.astype(">u8"), (k1.view(np.uint64) ^ top).astype(">u8"), (k2.view(np.uint64) ^ top).astype(">u8")]
    return np.ascontiguousarray(np.stack(parts, 1)).view("S24").ravel()


def _shard(table: pa.Table) -> pa.Table:
    """One shard's nodes, with their sums."""
    c = {n: table.column(n).to_numpy() for n in ("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "bytes")}
    root = table.column("depth").to_numpy() == table.column("root_depth").to_numpy()
    trie, rows = Louds.build(c["depth"], _keys(c["depth"], c["k1"], c["k2"]), _keys(c["depth"] - 1, c["p1"], c["p2"]), root)
    n_convs, conv_id = c["n_convs"][rows], c["conv_id"][rows]
    leaves = trie.rollup(np.r_[0, (trie.children[1:] == 0).astype(np.int64)])[1:]
    saved = trie.rollup(np.r_[0, (n_convs - 1) * c["bytes"][rows]])[1:]
    above = np.r_[0, conv_id][trie.parent[1:]]
    out = {k: c[k][rows] for k in ("depth", "k1", "k2", "p1", "p2")} | {"conv_id": conv_id, "parent_conv_id": pa.array(above, mask=root[rows]), "n_convs": n_convs, "n_children": trie.children[1:].astype(np.int64), "n_leaves": leaves, "saved": saved, "root": root[rows]}
    return pa.table(out)


def _rolled(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes with n_leaves and saved summed over their subtrees; each round doubles how far down the sums reach."""
    nodes = nodes.withColumns({"a1": F.col("p1"), "a2": F.col("p2")})
    reach = 1
    while reach <= depth:
        up = nodes.where(F.col("depth") >= reach)
        sums = up.groupBy((F.col("depth") - reach).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = nodes.select((F.col("depth") + reach).alias("depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("j1"), F.col("a2").alias("j2"))
        nodes = nodes.join(sums, KEY, "left").join(jump, ["depth", "a1", "a2"], "left").select(
            *(c for c in nodes.columns if c not in ("n_leaves", "saved", "a1", "a2")),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            F.coalesce("j1", "a1").alias("a1"),
            F.coalesce("j2", "a2").alias("a2"),
        )
        nodes, reach = stash(nodes, "heavy-sums"), 2 * reach
    return nodes.drop("a1", "a2")


def ends(ended: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of conv_id and key: the hash of a node's ids in ascending order, joined by commas."""
    key = ["k1", "k2", "depth"]

    def pieces(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], 1)
            ids = batch.column("conv_id").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            runs = np.split(np.arange(len(ids)), cuts) if len(ids) else []
            first = [r[0] for r in runs]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[first, i]) for i in range(3)), pa.array(ids[first]), pa.array([",".join(map(str, ids[r].tolist())) for r in runs])], [*key, "start", "ids"])

    def hashed(batches):
        last, held = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if k != last:
                    if last:
                        out.append((*last, held.hexdigest()))
                    last, held = k, hashlib.sha256(ids.encode())
                else:
                    held.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*key, "ends_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, held.hexdigest())], [*key, "ends_sha256"])

    n = partitions(ended.sparkSession)
    rows = ended.select(*key, "conv_id").withColumn("depth", F.col("depth").cast("long")).repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    found = rows.mapInArrow(pieces, "k1 long, k2 long, depth long, start long, ids string")
    return found.repartition(n, *key).sortWithinPartitions(*key, "start").mapInArrow(hashed, "k1 long, k2 long, depth long, ends_sha256 string").withColumn("depth", F.col("depth").cast("int"))


def trie(placed: DataFrame, convs: DataFrame, heavy: int | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    placed: as turns() gives them. convs: conv_id, length of every conversation.
    heavy: None takes half of what a task has of all turns, HEAVY at most.
    """
    spark = placed.sparkSession
    convs = stash(convs, "lengths")
    rows = stash(beginnings(placed, convs), "beginnings")
    n, members, first = convs.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*"), F.min("conv_id")).head()
    if heavy is None:
        heavy = max(LIGHT, min(HEAVY, n // (2 * partitions(spark))))
    counts = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes")]
    upper = rows.groupBy(*KEY).agg(*counts, F.sum("left").alias("weight")).where(F.col("weight") > heavy).drop("weight")
    root = spark.createDataFrame([(0, 0, 0, members, first, 0, 0, 0)], "depth int, k1 long, k2 long, n_convs long, conv_id long, p1 long, p2 long, bytes long").where(F.lit(members > 0))
    upper = stash(root.unionByName(upper.withColumn("depth", F.col("depth").cast("int"))), "upper")
    many, deepest = upper.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).head()
    send = F.broadcast if many <= SENT else (lambda df: df)

    # each conversation's first beginning that is light: the root of the subtree that has the rest of it
    marked = rows.join(send(upper.select(*KEY)), KEY, "left_anti")
    light_root = marked.groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("root"))
    light = marked.join(light_root, "conv_id").groupBy("root", *KEY).agg(*counts)
    shards = max(partitions(spark), -(-n // shard_nodes))
    placed_nodes = light.select(F.pmod(F.xxhash64("root"), F.lit(shards)).alias("shard"), F.col("root.depth").cast("int").alias("root_depth"), F.col("depth").cast("int").alias("depth"), "k1", "k2", "p1", "p2", "conv_id", "n_convs", "bytes")
    lower = stash(placed_nodes.groupBy("shard").applyInArrow(_shard, NODES), "lower")

    # what hangs below each heavy node
    below = lower.where("root").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("light"), F.sum("n_leaves").alias("l_leaves"), F.sum("saved").alias("l_saved"))
    within = upper.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("grave"))
    sums = upper.join(below, KEY, "left").join(within, KEY, "left").na.fill(0, ["light", "l_leaves", "l_saved", "grave"])
    sums = sums.select(*KEY, "p1", "p2", "conv_id", "n_convs", (F.col("light") + F.col("grave")).alias("n_children"), F.when((F.col("light") + F.col("grave")) == 0, 1).otherwise(F.col("l_leaves")).alias("n_leaves"), (F.col("l_saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = stash(_rolled(stash(sums, "heavy-sums"), deepest), "heavy")
    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    columns = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    top = sums.join(send(parents), ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    roots = lower.where("root").join(send(parents), ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("above")).select(*columns)
    every = top.union(roots).union(lower.where("not root").select(*columns))

    ended = rows.where("left = 1").select(*KEY, "conv_id").union(convs.where("length = 0").select(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), "conv_id"))
    out = every.join(ends(ended), KEY, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", heavy: int | None = None) -> DataFrame:
    """The trie of the conversations as they are."""
    placed = stash(turns(df, id_col, turn_col, role_col, text_col), "placed")
    return trie(placed, lengths(placed), heavy)


def rebuilt_trie(df: DataFrame, group: int = 5, span: int = 9, heavy: int | None = None) -> DataFrame:
    """The trie of the conversations as rebuilt() makes them."""
    return trie(*rebuilt(stash(turns(df), "placed"), group, span), heavy)
