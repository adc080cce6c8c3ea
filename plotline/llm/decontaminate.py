"""Benchmark decontamination by templates.

Words are stripped of outer punctuation and lower-cased; numbers, names (capitalised inside a sentence) and units (after a number)
become typed placeholders. Windows of template words of documents are hash-joined to those of the benchmark, and the
windows of a document and an item that lie on one diagonal form runs. A run counts if its slots are consistent:
along it, each value of the item stands for one value of the document and the other way round. So a
question with other numbers, names or units is caught, and one whose slots do not correspond is not. A window of nothing but
slots says nothing as a template and is compared by its words; so rows of numbers don't meet all rows of numbers.

A document holds an item if a consistent run covers `covered` template words, or the whole item if it is shorter. Items
of fewer than `least` words are not looked for, as most texts could hold them; with 1 all are.

Null and empty texts hold nothing; rows with null ids (of documents or items) can't be named and are left out; a
repeated row gives its pairs once. Unlike texts under one id are compared each for itself, and the longest run of any of them is told.
Either table may be empty. What is gathered for a document, an item and a diagonal is no more than the item's windows.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memory
from .common import id_text

WINDOW, LEAST, COVERED = 8, 5, 13
#: As many window hashes of a benchmark are sent to every task as a filter; a larger benchmark is joined without it.
FILTER_ROWS = 2_000_000

#: Units that follow a number.
UNITS = "% km m cm mm mi ft in kg g mg lb oz l ml s ms min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year usd eur gbp $ € £ dollars euros cents mph kmh km/h hz khz mhz ghz kb mb gb tb w kw v a c f °c °f".split()

ENDS, NAME, NUMBER, UNIT, FLAGS = 1, 2, 4, 8, 15
SLOT = {kind: np.uint64(xxhash.xxh3_64_intdigest(kind.encode()) & ~FLAGS) for kind in ("number", "name", "unit")}
STRIP = b"\"'`.,;:!?()[]{}<>|*#$%&@~^_=+-/\\"
NUMERIC = re.compile(rb"[+-]?\d+(?:[.,:/-]\d+)*(?:e[+-]?\d+)?(st|nd|rd|th|s)?%?$")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000


def word_code(word: bytes) -> int:
    """The hash of the lower-cased word, with flags in its lowest bits."""
    core = word.strip(STRIP) or word
    low = core.decode("utf-8", "replace").lower().encode()
    flags = ENDS * (word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":"))
    text = core.decode("utf-8", "replace")
    flags |= NAME * (len(text) > 1 and text[0].isupper() and text[1:].islower())
    flags |= NUMBER * bool(NUMERIC.match(low)) | UNIT * (low.decode("utf-8", "replace") in _UNITS)
    return xxhash.xxh3_64_intdigest(low) & ~FLAGS | flags


_UNITS = frozenset(UNITS)
_words = Memory(CACHE, "templates")


def codes(text: str) -> np.ndarray:
    out, new = _words.many(text.encode().split())
    if new:
        fresh = {w: word_code(w) for w in set(new)}
        for w, x in fresh.items():
            if len(w) < 60:
                _words.put(w, x)
        found = map(fresh.__getitem__, new)
        out = [next(found) if x is None else x for x in out]
    return np.array(out, np.uint64)


def template(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The template's word hashes, the plain word hashes, and whether each place is a slot."""
    plain = code & ~np.uint64(FLAGS)
    flag = (code & np.uint64(FLAGS)).astype(np.uint8)
    number = (flag & NUMBER) > 0
    unit = np.r_[False, number[:-1]] & ((flag & UNIT) > 0) if len(code) else number
    first = np.r_[True, (flag[:-1] & ENDS) > 0] if len(code) else number
    name = ((flag & NAME) > 0) & ~first & ~number & ~unit
    out = np.where(number, SLOT["number"], np.where(unit, SLOT["unit"], np.where(name, SLOT["name"], plain)))
    return out, plain, number | unit | name


def windows(template_words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words; size is part of it."""
    n = len(template_words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(size), np.uint64)
        for k in range(size):
            h = (h ^ template_words[k : k + n]) * MULTIPLY
            h ^= h >> np.uint64(29)
    return h


def keys(template_words: np.ndarray, plain: np.ndarray, slot: np.ndarray, size: int) -> np.ndarray:
    """As windows, with the words themselves where a window has no other than slots."""
    h = windows(template_words, size)
    if len(h):
        held = np.concatenate([np.zeros(1, np.int64), np.cumsum(slot)])
        bare = np.flatnonzero(held[size:] - held[:-size] == size)
        if len(bare):
            h[bare] = ~windows(plain[bare[:, None] + np.arange(size)].ravel(), size)[::size]
    return h


SCHEMA = "{0} long, uid long, hash long, pos int, size int, words binary, slots binary{1}"


def _windowed(df: DataFrame, name: str, sizes: list[int] | None, only: np.ndarray | None, size: int, least: int) -> DataFrame:
    """A row for each window (of documents: of those in `only` if it is given). sizes: None for the benchmark, whose items have windows of one size each."""
    item = sizes is None
    kinds = {name: pa.int64(), "uid": pa.int64(), "hash": pa.int64(), "pos": pa.int32(), "size": pa.int32(), "words": pa.binary(), "slots": pa.binary()} | ({"total": pa.int32()} if item else {})

    def run(batches):
        for b in batches:
            out = []
            for i, uid, text in zip(b.column("doc_id").to_pylist(), b.column("uid").to_pylist(), b.column("text").to_pylist()):
                t, plain, slot = template(codes(text))
                for s in [min(size, len(t))] if item else sizes:
                    if s < least or len(t) < s:
                        continue
                    h = keys(t, plain, slot, s)
                    at = np.arange(len(h))
                    if only is not None:
                        near = np.searchsorted(only, h)
                        at = np.flatnonzero(only[np.minimum(near, len(only) - 1)] == h)
                    out += [(i, uid, int(h[p].view(np.int64)), p, s, plain[p : p + s].tobytes(), slot[p : p + s].tobytes(), len(t))[: len(kinds)] for p in at.tolist()]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, v) for c, v in zip(columns, kinds.values())], list(kinds))

    named = df.where("doc_id IS NOT NULL").withColumn("uid", F.xxhash64("text"))
    return named.mapInArrow(run, SCHEMA.format(name, ", total int" if item else ""))


def longest_run(hits: list, total: int, covered: int) -> tuple[int, int, int, bool] | None:
    """hits: (pos in item, pos in document, item's words, document's words, slots) of one diagonal.

    The longest run of matched words whose slots are consistent, the first of several, as (words, start in document, start in
    item, whether all words are equal). Both ends of the run move on: its start as far as a slot at its end asks for.
    """
    places: list[tuple[int, int, int, int, bool]] = []  # pos in item, pos in document, item's word, document's word, slot
    for p, q, a, b, slots in sorted(hits):
        a, b = np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist()
        seen = places[-1][0] if places else -1
        places += [(p + k, q + k, a[k], b[k], bool(slots[k])) for k in range(max(0, seen + 1 - p), len(a))]
    best, start = None, 0
    there: dict[int, list[int]] = {}  # item's value: [document's value, how often in the run]
    here: dict[int, int] = {}
    for end, (p, q, x, y, slot) in enumerate(places):
        while start < end and (p > places[end - 1][0] + 1 or slot and (there.get(x, [y])[0] != y or here.get(y, x) != x)):
            _, _, u, v, was_slot = places[start]
            start += 1
            if was_slot:
                there[u][1] -= 1
                if not there[u][1]:
                    del there[u], here[v]
        if slot:
            there.setdefault(x, [y, 0])[1] += 1
            here[y] = x
        if best is None or end + 1 - start > best[1] - best[0]:
            best = (start, end + 1)
    if best is None or best[1] - best[0] < min(covered, total):
        return None
    run = places[best[0] : best[1]]
    return len(run), run[0][1], run[0][0], all(x == y for _, _, x, y, _ in run)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = WINDOW, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """doc_id, item_id, n_words, doc_start, item_start (in words), same_words: one row for each document and item it holds."""
    docs, items = id_text(df, id_col, text_col), id_text(benchmark, item_col, text_col)
    known = _windowed(items, "item_id", None, None, size, least).dropDuplicates(["item_id", "uid", "pos"]).withColumnRenamed("uid", "item_uid")
    hashes = known.select("hash", "size").distinct().limit(FILTER_ROWS + 1).toArrow()
    only = np.unique(np.array(hashes.column("hash").to_numpy(), np.int64).view(np.uint64)) if len(hashes) <= FILTER_ROWS else None
    sizes = sorted(set(range(least, size + 1))) if only is None else sorted(set(hashes.column("size").to_pylist()))
    found = _windowed(docs, "doc_id", sizes, only if only is None or len(only) else np.zeros(1, np.uint64), size, least)
    pairs = found.dropDuplicates(["doc_id", "uid", "pos", "size"]).join(known.withColumnsRenamed({"pos": "item_pos", "words": "item_words", "slots": "item_slots"}), ["hash", "size"])
    diagonals = pairs.groupBy("doc_id", "uid", "item_id", "item_uid", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_list(F.struct("item_pos", "pos", "item_words", "words", "slots")).alias("hits"), F.max("total").alias("total")
    )

    def judge(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                got = longest_run([tuple(bytes(x) if isinstance(x, bytearray) else x for x in h.values()) for h in r["hits"]], r["total"], covered)
                if got:
                    out.append((r["doc_id"], r["item_id"], *got))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], ["doc_id", "item_id", "n_words", "doc_start", "item_start", "same_words"])

    runs = diagonals.mapInArrow(judge, "doc_id long, item_id long, n_words int, doc_start int, item_start int, same_words boolean")
    best = F.max_by(F.struct("n_words", "doc_start", "item_start", "same_words"), F.struct("n_words", -F.col("doc_start"), -F.col("item_start")))
    return runs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
