"""N-gram Jaccard join by vertical partitioning, and the connected components of its links.

A document's set holds the hashes of its distinct word n-grams (of the whole sequence if it has fewer words). The hash
order is the global order of n-grams; it is cut into fragments, and a set into the parts that fall into each.

Candidates. If two sets are as similar as asked, they differ in at most D n-grams, D following from their sizes. With more
than D fragments one of them is the same in both sets. So each fragment of a set is a key, and sets that share a
key are candidates; a passage that many documents share makes no key, as a fragment holds n-grams from the whole
text. More than one fragment has to be the same, as there are SLACK more than needed; so of its keys a set may leave out as many of
the most frequent ones, and two linked sets still share one. Fragments are made for classes of sizes; a set also has the keys of the next lower class if a partner may be in it.
A set with so many empty fragments that the argument may fail has its prefix (the first n-grams in the global order, enough to
meet any partner's) as keys too.

Links. Of the sets of a key the pivot is that which shares most keys with others, as the text that others were edited from does;
each other one makes a pair with it. The overlap of a pair is counted fragment by fragment and summed. After that only sets of a
key that are still in different components meet, one of each pair not of the key's largest component, so a group of copies
makes few pairs. Sets meet only if their signatures allow it: a signature has for each of 512 classes of n-grams whether a set has
an even or odd number of it, so two signatures differ in no more bits than the sets differ in n-grams. No pair that can be
linked and could join two components is left out.

Null texts and texts without words have empty sets, which are linked with nothing. Rows with a null id are left out, as
a component is named by ids. Rows that repeat an id all take part in links, each for itself; one row is returned for the id, that of
its row with the most n-grams. An empty table gives no rows.
"""

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, stash
from .substring_dedup import HELD, Words, chunks, mix

GROWTH = 1.4  # from a class of sizes to the next
SLACK = 4  # fragments beyond those that sets as similar as asked may differ in
CUTS = 4  # fragments for counting overlaps
SIGNS = [f"s{i}" for i in range(8)]  # the longs of a signature
U = np.uint64


def max_difference(a: int, b: int, percent: int) -> int:
    """The largest size of the symmetric difference at which sets of sizes a and b are linked."""
    return (a + b) * (100 - percent) // (100 + percent)


class Scheme:
    """Classes of sizes: class c holds sizes from low[c] up to low[c + 1]; fragments[c] and slack[c] go with it."""

    def __init__(self, percent: int, largest: int):
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
        self.low = np.array(low)
        fragments, slack = [], []
        for lo, hi in zip(low, low[1:]):
            d = max(max_difference(a, a * 100 // percent, percent) for a in range(lo, hi)) if hi - lo < 64 else max_difference(hi - 1, (hi - 1) * 100 // percent, percent)
            s = SLACK + d // 16
            fragments.append(d + 1 + s)
            slack.append(s)
        self.fragments, self.slack = np.array(fragments), np.array(slack)


_schemes: dict[tuple[int, int], Scheme] = {}


def scheme(percent: int, largest: int) -> Scheme:
    top = 1 << max(10, int(largest).bit_length())
    if (percent, top) not in _schemes:
        _schemes[percent, top] = Scheme(percent, top)
    return _schemes[percent, top]


class Sets:
    """The n-gram sets of several documents: `h` sorted by document, then hash; `size` and `first` by document; `id` of each set."""

    def __init__(self, docs: list[np.ndarray], n: int):
        with np.errstate(over="ignore"):
            sizes = np.array([len(d) for d in docs], np.int64)
            words = np.concatenate([*docs, np.zeros(0, np.uint64)])
            many = np.where(sizes == 0, 0, np.maximum(sizes - n + 1, 1))
            doc = np.repeat(np.arange(len(docs)), many)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(sizes) - sizes, many)
            length = np.minimum(sizes, n)[doc]
            h = length.astype(np.uint64)
            for k in range(n):
                on = k < length
                h = np.where(on, mix(h * U(0x9E3779B97F4A7C15) + words[np.minimum(at + k, max(len(words) - 1, 0))], 21), h) if len(h) else h
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            self.h, self.doc = h[new], doc[new]
            self.size = np.bincount(self.doc, minlength=len(docs)).astype(np.int64)
            self.first = np.cumsum(self.size) - self.size
            total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(self.h, 22))])
            self.id = mix(total[self.first + self.size] - total[self.first] + self.size.astype(np.uint64), 23)

    def signatures(self) -> np.ndarray:
        """A row of longs for each set."""
        bits = 64 * len(SIGNS)
        count = np.bincount(self.doc * bits + (mix(self.h, 27) % U(bits)).astype(np.int64), minlength=len(self.size) * bits)
        return np.packbits((count & 1).astype(np.uint8).reshape(len(self.size), bits), axis=1).view(np.int64)

    def keys(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, document, tag: 64 times the class and how many of the set's most frequent keys of it may be left out; -1 for keys of a prefix."""
        if not len(self.h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        s = scheme(percent, int(self.size.max()))
        own = np.searchsorted(s.low, np.maximum(self.size, 1), side="right") - 1
        out_k, out_d, out_t = [], [], []
        sparse = np.zeros(len(self.size), bool)
        with np.errstate(over="ignore"):
            hashed = mix(self.h, 24)
            for back in (0, 1):
                c = own - back
                # a partner in the class below has at most low[own] - 1 n-grams, and at least this many percent of ours
                on = (self.size > 0) & (c >= 0) & ((s.low[own] - 1) * 100 >= percent * self.size if back else True)
                if not on.any():
                    continue
                rows = on[self.doc]
                h, doc, cls = hashed[rows], self.doc[rows], np.maximum(c, 0)[self.doc[rows]]
                count = s.fragments[cls].astype(np.uint64)
                part = ((self.h[rows] >> U(32)) * count) >> U(32)
                new = np.ones(len(doc), bool)
                new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                key = mix(np.add.reduceat(h, at) + part[at] * U(0xA24BAED4963EE407) + cls[at].astype(np.uint64), 25)
                filled = np.bincount(doc[at], minlength=len(self.size))
                spare = s.slack[np.maximum(c, 0)] - (s.fragments[np.maximum(c, 0)] - filled)
                out_k.append(key)
                out_d.append(doc[at])
                out_t.append((cls[at] * 64 + np.clip(spare, 0, 63)[doc[at]]).astype(np.int32))
                sparse |= on & (spare < 0)
            need = self.size - (self.size * percent + 99) // 100 + 1
            rank = np.arange(len(self.h)) - self.first[self.doc]
            prefix = sparse[self.doc] & (rank < need[self.doc])
            out_k.append(mix(self.h[prefix], 26))
            out_d.append(self.doc[prefix])
            out_t.append(np.full(int(prefix.sum()), -1, np.int32))
        return np.concatenate(out_k), np.concatenate(out_d), np.concatenate(out_t)

    def of(self, k: int) -> np.ndarray:
        return self.h[self.first[k] : self.first[k] + self.size[k]]


_words: list[Words] = []


def _sets(batch: pa.RecordBatch, n: int):
    """(first row, sets) of groups of rows; A-Z are lower-cased."""
    if not _words:
        _words.append(Words())
    lower = pa.array([None if x is None else x.lower() for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
    for first, docs in chunks(pa.RecordBatch.from_arrays([lower], ["text"]), _words[0]):
        yield first, Sets(docs, n), len(docs)


def _nodes(n: int, batches):
    for b in batches:
        for first, s, many in _sets(b, n):
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[first : first + many], pa.array(s.id.view(np.int64)), pa.array(s.size), *(pa.array(x) for x in np.ascontiguousarray(s.signatures().T))], ["doc_id", "set_id", "n", *SIGNS])


def _keys(n: int, percent: int, batches):
    for b in batches:
        for _, s, _many in _sets(b, n):
            key, doc, tag = s.keys(percent)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s.id[doc].view(np.int64)), pa.array(tag)], ["key", "set_id", "tag"])


def _shared(batches):
    """key, set_id, tag of the keys that unlike sets have. A task holds its unlike keys with the first set of each, not all of their sets."""
    kinds = (np.int64, np.int64, np.int32, bool)
    keys, firsts, tags, told = (np.zeros(0, k) for k in kinds)
    held, n = [], 0

    def flush():
        nonlocal keys, firsts, tags, told
        key, x, t = (np.concatenate(c) for c in zip(*held))
        unlike, first, back = np.unique(key, return_index=True, return_inverse=True)
        near = np.searchsorted(keys, unlike)
        fresh = (keys[np.minimum(near, len(keys) - 1)] != unlike) if len(keys) else np.ones(len(unlike), bool)
        at = near[fresh]
        keys, firsts, tags, told = np.insert(keys, at, unlike[fresh]), np.insert(firsts, at, x[first[fresh]]), np.insert(tags, at, t[first[fresh]]), np.insert(told, at, False)
        place = np.searchsorted(keys, unlike)[back]
        other = x != firsts[place]
        new = np.unique(place[other])
        new = new[~told[new]]
        told[new] = True
        rows = np.unique(np.stack([np.concatenate([key[other], keys[new]]), np.concatenate([x[other], firsts[new]]), np.concatenate([t[other], tags[new]]).astype(np.int64)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], ["key", "set_id", "tag"])

    for b in batches:
        held.append((b.column("key").to_numpy(), b.column("set_id").to_numpy(), b.column("tag").to_numpy()))
        n += b.num_rows
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _cut(n: int, batches):
    """set_id, size, cut, part: the hashes of a set that fall into each of CUTS fragments; a row whose text has another set gives none."""
    for b in batches:
        ids = b.column("set_id").to_pylist()
        for first, s, many in _sets(b, n):
            out = []
            for k in np.flatnonzero(s.id.view(np.int64) == np.array(ids[first : first + many])).tolist():
                h = s.of(k)
                at = np.searchsorted(h, np.arange(1, CUTS).astype(np.uint64) << U(64 - CUTS.bit_length() + 1))
                out += [(ids[first + k], len(h), c, x.tobytes()) for c, x in enumerate(np.split(h, at))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["set_id", "size", "cut", "part"])


def _overlaps(batches):
    for b in batches:
        common = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b.column("part_a").to_pylist(), b.column("part_b").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "size_a", "size_b")), pa.array(common, pa.int64())], ["a", "b", "size_a", "size_b", "common"])


def signed(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("set_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *SIGNS)))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether the signatures of two sets and their sizes allow the similarity."""
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}"))) for c in SIGNS))
    sizes = F.col(f"n_{a}") + F.col(f"n_{b}")
    similar = F.least(f"n_{a}", f"n_{b}") * 100 >= F.greatest(f"n_{a}", f"n_{b}") * percent
    return similar & (differ * (100 + percent) <= sizes * (100 - percent))


def linked(pairs: DataFrame, cuts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose overlap is large enough. cuts: as _cut gives."""
    able = pairs
    both = able.join(cuts.select(F.col("set_id").alias("a"), F.col("size").alias("size_a"), "cut", F.col("part").alias("part_a")), "a").join(
        cuts.select(F.col("set_id").alias("b"), F.col("size").alias("size_b"), "cut", F.col("part").alias("part_b")), ["b", "cut"]
    )
    counted = both.select("a", "b", "size_a", "size_b", "part_a", "part_b").mapInArrow(_overlaps, "a long, b long, size_a long, size_b long, common long")
    sums = counted.groupBy("a", "b").agg(F.sum("common").alias("i"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return sums.where(F.col("i") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("i")) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it is connected with) of each node of the edges (a, b), by alternating large and small stars."""

    def sums(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = sums(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, e = e, stash(small.where("u <> v").distinct(), "edges")
        discard(last)
        after = sums(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links: only the graph of the roots is walked again."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    up = stash(components(met), "roots")
    old = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(up.join(roots, "node", "left_anti"))


def cross_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets of one key under different roots that may be linked. One side is never of the key's largest root."""
    placed = stash(members.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root")), "placed")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    split = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max_by("root", F.struct("c", "root")).alias("largest")).where("k > 1").select("key", "largest")
    open_keys = stash(placed.join(split, "key").join(sets.select("set_id", "n", *SIGNS), "set_id"), "open")
    side = lambda df, c: df.select(F.col("key").alias(f"key_{c}"), F.col("set_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("root", "largest", "n", *SIGNS)))
    discard(placed)
    x, y = side(open_keys.where("root <> largest"), "x"), side(open_keys, "y")
    met = x.join(y, (F.col("key_x") == F.col("key_y")) & ((F.col("root_y") == F.col("largest_y")) | (F.col("root_x") < F.col("root_y"))) & may_link("x", "y", percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def ngram_components(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), one row for each id of df."""
    spark = df.sparkSession
    n = partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    found = stash(docs.mapInArrow(partial(_nodes, words), "doc_id long, set_id long, n long, " + ", ".join(f"{c} long" for c in SIGNS)), "nodes")
    one = found.groupBy("doc_id").agg(F.max(F.struct("n", "set_id")).alias("s")).select("doc_id", "s.n", "s.set_id")
    sets = stash(found.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", *SIGNS))), "sets")

    keys = docs.mapInArrow(partial(_keys, words, percent), "key long, set_id long, tag int").repartition(n, "key")
    members = stash(keys.mapInArrow(_shared, "key long, set_id long, tag int").distinct(), "keys")
    sizes = members.groupBy("key").agg(F.count_distinct("set_id").alias("m"))
    common_first = Window.partitionBy("set_id", "tag").orderBy(F.col("m").desc(), F.col("key").desc())
    ranked = members.join(sizes, "key").withColumn("rank", F.row_number().over(common_first))
    shared, members = members, stash(ranked.where("tag < 0 OR rank > tag % 64").groupBy("key", "set_id").agg(F.first("m").alias("m")), "keys")
    discard(shared)
    scores = stash(members.groupBy("set_id").agg(F.sum("m").alias("score")), "scores")
    shared, members = members, stash(members.join(scores, "set_id").select("key", "set_id", "score"), "members")
    discard(shared)
    pivots = members.groupBy("key").agg(F.max_by("set_id", F.struct("score", "set_id")).alias("pivot"))
    pairs = members.join(pivots, "key").where("set_id <> pivot")
    pairs = pairs.select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b")).distinct()
    pairs = stash(pairs.join(signed(sets, "a"), "a").join(signed(sets, "b"), "b").where(may_link("a", "b", percent)).select("a", "b"), "pairs")

    # the sets of candidates, each from one of the documents that have it
    wanted = scores.select("set_id")
    texts = docs.join(wanted.join(sets.select("set_id", F.col("least").alias("doc_id")), "set_id"), "doc_id")
    cuts = stash(texts.mapInArrow(partial(_cut, words), "set_id long, size long, cut int, part binary").dropDuplicates(["set_id", "cut"]), "cuts")

    roots = stash(components(linked(pairs, cuts, percent)), "roots")
    fresh = stash(cross_pairs(members, roots, sets, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    roots = stash(joined_roots(roots, linked(fresh, cuts, percent)), "roots")
    discard(members, scores, pairs, cuts, fresh)

    # a component's name: the least id of its sets' documents
    named = sets.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = named.join(names, "root").select("set_id", "component_id")
    out = one.join(of_set, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
