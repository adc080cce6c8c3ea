"""Ranked lexical search with block-max pruning over a forward index.

The index is a table with a row for each block: documents that follow each other, at most BLOCK_DOCS of them or about
BLOCK_TERMS terms. A block holds its vocabulary, for each of its terms the largest impact in the block and the number of
its documents, and for each document the places of its terms in that vocabulary with their impacts. An impact is what
one document's occurrences of a term count before the term's weight; it needs the number of documents and terms of the
whole table, which one pass counts beforehand.

A search takes its items in blocks of at most PAIRS (item, term) pairs. For such a block of items
1. the documents of each of their terms are counted, over all blocks;
2. each index block's bound for an item is the sum of the terms' weights times their largest impacts; the SEEDS blocks
   of the highest bound are scored, and the k-th score among them is the item's threshold;
3. every index block whose bound reaches the threshold is scored, highest bound first; thresholds rise on the way,
   and an item is done with a batch of blocks once their bounds stay below its threshold.
Only blocks whose bound lies below what k documents reach are left out, so the result is that of scoring everything.

Texts without terms, null or empty, count neither as documents nor as hits. Rows that repeat a doc_id are documents of
their own; a null doc_id comes after all others of its score. Rows of items that are alike in id and text (but for
the case of A-Z) are one item; unlike texts of one id are ranked each for itself. Items without terms, empty tables: no rows.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, stash

#: Maximal runs of these are terms: letters, digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text to bytes of its terms: A-Z in lower case, what no term holds as spaces.
FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
BLOCK_DOCS, BLOCK_TERMS = 64, 60_000
SEEDS = 4
PAIRS = 200_000
#: Stands for a null doc_id inside; sorts last.
NO_ID = (1 << 63) - 1

INDEX = "block long, ids binary, terms binary, maxima binary, dfs binary, starts binary, places binary, impacts binary"


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches):
        for batch in batches:
            n = [len(text.translate(FOLDED).split()) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))]), pa.array([sum(n)])], ["documents", "terms"])

    r = docs.select("text").mapInArrow(run, "documents long, terms long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms"))).head()
    return r[0], r[1]


def impact(tf: np.ndarray, n: int, documents: int, terms: int) -> np.ndarray:
    """Of tf occurrences in a document of n terms, in billionths of a whole: integer division throughout."""
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Block:
    """Documents gathered until the block is full."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.places, self.impacts, self.size = [], [], [], 0

    def add(self, doc_id: int, counts: Counter, n: int, documents: int, terms: int) -> None:
        known = self.known
        self.ids.append(doc_id)
        self.places.append(np.array([known.setdefault(t, len(known)) for t in counts], np.int32))
        self.impacts.append(impact(np.fromiter(counts.values(), np.int64, len(counts)), n, documents, terms).astype(np.int32))
        self.size += len(counts)

    def packed(self, block: int) -> tuple:
        places, impacts = np.concatenate(self.places), np.concatenate(self.impacts)
        maxima = np.zeros(len(self.known), np.int32)
        np.maximum.at(maxima, places, impacts)
        starts = np.cumsum([0, *map(len, self.places)], dtype=np.int32)
        dfs = np.bincount(places, minlength=len(self.known)).astype(np.int32)
        return (block, np.array(self.ids, np.int64).tobytes(), b" ".join(self.known), *(x.tobytes() for x in (maxima, dfs, starts, places, impacts)))


def build_index(docs: DataFrame, documents: int, terms: int) -> DataFrame:
    """The index of doc_id, text. A task holds one block at a time."""
    kinds = pa.schema([("block", pa.int64()), *((x.split()[0], pa.binary()) for x in INDEX.split(", ")[1:])])

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                counts = Counter(text.translate(FOLDED).split())
                if not counts:
                    continue
                held.add(NO_ID if doc_id is None else doc_id, counts, counts.total(), documents, terms)
                if len(held.ids) >= BLOCK_DOCS or held.size >= BLOCK_TERMS:
                    out.append(held.packed(base + made))
                    made, held = made + 1, _Block()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds.types)], schema=kinds)
        if held.ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held.packed(base + made), kinds.types)], schema=kinds)

    return docs.mapInArrow(run, INDEX)


class Queries:
    """A block of items: their terms as places in one vocabulary, item after item; weights once they are known."""

    def __init__(self, terms_of: list[list[bytes]]):
        vocabulary = dict.fromkeys(t for terms in terms_of for t in terms)
        self.known = {t: i for i, t in enumerate(vocabulary)}
        self.terms = np.array([self.known[t] for terms in terms_of for t in terms], np.int64)
        self.starts = np.cumsum([0, *map(len, terms_of)])
        self.weights = np.zeros(len(self.known), np.int64)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        for i, n in df.items():
            self.weights[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))

    def places(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of the block's terms those asked for: their places there, and here."""
        here = np.array([self.known.get(t, -1) for t in terms.split(b" ")], np.int64)
        there = np.flatnonzero(here >= 0)
        return there, here[there]

    def bounds(self, there: np.ndarray, here: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """For each item what no document of the block exceeds."""
        most = np.zeros(len(self.known), np.int64)
        most[here] = maxima[there] * self.weights[here]
        return np.add.reduceat(most[self.terms], self.starts[:-1])

    def scorer(self, row: dict, there: np.ndarray, here: np.ndarray):
        """ids, and a function from an item to its scores of the block's documents."""
        ids = np.frombuffer(row["ids"], np.int64)
        starts, places, impacts = (np.frombuffer(row[x], np.int32) for x in ("starts", "places", "impacts"))
        column = np.full(row["terms"].count(b" ") + 1, -1)
        column[there] = np.arange(len(there))
        at = column[places]
        asked = at >= 0
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))[asked]
        table = np.zeros((len(there) + 1, len(ids)), np.int64)
        table[at[asked], doc] = impacts[asked]
        table[:-1] *= self.weights[here][:, None]
        row_of = np.full(len(self.known), len(there))  # terms that the block lacks: a row of zeros
        row_of[here] = np.arange(len(there))
        return ids, lambda item: table[row_of[self.terms[self.starts[item] : self.starts[item + 1]]]].sum(axis=0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by id."""
    order = np.lexsort((ids, -scores))[:k]
    return order[scores[order] > 0]


def _frequencies(index: DataFrame, queries: Queries) -> dict[int, int]:
    def run(batches):
        total = np.zeros(len(queries.known), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                there, here = queries.places(row["terms"])
                total[here] += np.frombuffer(row["dfs"], np.int32)[there]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "df"])

    counted = index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counted.collect()}  # at most one row for each term asked for


def _seeds(index: DataFrame, queries: Queries, seeds: int) -> DataFrame:
    """block, items: for each item the blocks of its highest bounds."""

    def run(batches):
        most, block = np.zeros((0, len(queries.starts) - 1), np.int64), np.zeros((0, len(queries.starts) - 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                there, here = queries.places(row["terms"])
                new = queries.bounds(there, here, np.frombuffer(row["maxima"], np.int32))
                most, block = np.vstack([most, new]), np.vstack([block, np.full_like(new, row["block"])])
                if len(most) > 4 * seeds:
                    top = np.argsort(-most, axis=0, kind="stable")[:seeds]
                    most, block = np.take_along_axis(most, top, 0), np.take_along_axis(block, top, 0)
        if len(most):
            top = np.argsort(-most, axis=0, kind="stable")[:seeds]
            most, block = np.take_along_axis(most, top, 0), np.take_along_axis(block, top, 0)
        level, item = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(block[level, item]), pa.array(most[level, item])], ["item", "block", "bound"])

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    bounds = index.select("block", "terms", "maxima").mapInArrow(run, "item long, block long, bound long")
    return bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= seeds).groupBy("block").agg(F.collect_list("item").alias("items"))


def _thresholds(index: DataFrame, queries: Queries, k: int, seeds: int) -> np.ndarray:
    """For each item a score that k documents reach, 1 where the seeds don't hold so many."""

    def run(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                ids, score = queries.scorer(row, *queries.places(row["terms"]))
                for item in row["items"]:
                    scores = score(item)
                    found += [(item, s) for s in scores[best(scores, ids, k)].tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["item", "score"])

    chosen = stash(_seeds(index, queries, seeds), "seeds")  # at most seeds rows for each item
    scored = index.drop("maxima", "dfs").join(F.broadcast(chosen), "block").mapInArrow(run, "item long, score long")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") == k)
    least = np.ones(len(queries.starts) - 1, np.int64)
    for r in ranked.collect():  # a row for each item
        least[r.item] = r.score
    return least


def _scored(index: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the best of each task, all that can be among an item's k best."""

    def run(batches):
        threshold, held = least.copy(), {}

        def keep(item: int, ids: np.ndarray, scores: np.ndarray) -> None:
            old = held.get(item)
            if old is not None:
                ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
            if len(ids) > k:
                top = best(scores, ids, k)
                ids, scores = ids[top], scores[top]
                threshold[item] = max(threshold[item], scores[-1])
            held[item] = ids, scores

        for batch in batches:
            rows = batch.to_pylist()
            matches = [queries.places(r["terms"]) for r in rows]
            bounds = np.stack([queries.bounds(*m, np.frombuffer(r["maxima"], np.int32)) for m, r in zip(matches, rows)])
            scorers: dict = {}
            for item in np.flatnonzero((bounds >= threshold).any(axis=0)).tolist():
                of = bounds[:, item]
                for b in np.argsort(-of, kind="stable").tolist():
                    if of[b] < threshold[item]:
                        break
                    if b not in scorers:
                        scorers[b] = queries.scorer(rows[b], *matches[b])
                    ids, score = scorers[b]
                    scores = score(item)
                    hit = np.flatnonzero(scores >= threshold[item])
                    if len(hit):
                        keep(item, ids[hit], scores[hit])
        for item, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return index.select("block", "ids", "terms", "maxima", "starts", "places", "impacts").mapInArrow(run, "item long, doc_id long, score long")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, terms: the distinct terms of each item that has any."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), lower.alias("text")).distinct()
    return rows.select("item_id", F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("terms")).where("size(terms) > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", seeds: int = SEEDS, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    pairs: how many (item, term) pairs, about, are sent to the tasks at once; more items go through the index in turns.
    """
    spark = docs.sparkSession
    texts = id_text(docs, doc_id, doc_text)
    documents, terms = statistics(texts)
    asked = stash(item_terms(items, item_id, item_text), "items")
    wanted = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()[0]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not documents or not wanted:
        return out
    index = stash(build_index(texts, documents, terms), "index")
    turns = -(-wanted // pairs)
    for turn in range(turns):
        some = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(turns)) == turn).orderBy("item_id", "terms").collect()
        if not some:
            continue
        queries = Queries([[t.encode() for t in r.terms] for r in some])
        queries.weigh(_frequencies(index, queries), documents)
        least = _thresholds(index, queries, k, seeds)
        found = _scored(index, queries, least, k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(some)], "item long, item_id long")
        out = out.union(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return out
