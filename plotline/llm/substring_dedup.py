"""Substring dedup by recompression: words in windows that occur more than once are removed.

A document is a sequence of words. In each round runs of equal neighbours, then pairs of neighbours, get the name of what
they hold: a 64-bit hash, so that all partitions give equal substrings equal names without a shared dictionary. Which
neighbours form a pair is decided by one bit of each name (a left and a right half of the alphabet), so the symbols
inside equal substrings agree but for some at the edges. With each symbol goes the span of words that it and the decisions
about it depend on; a window holds a symbol if it holds its span. Of the symbols a window holds, that of the lowest
hash is its anchor: equal windows have equal anchors at equal places.

1. Anchors (the hash of the span's words) are dealt by their hash; those that occur once are dropped, and so are all
   windows with them.
2. The windows left are dealt by their anchor and compared, among those of one anchor, by the hash of their words: two windows count as equal
   if anchor and window agree, each in 64 bits.
3. The places of repeated windows go back to their documents, where the words they cover are removed.

What a task has met before it need not ask for: of an anchor, and of a run of windows with one anchor, only the first in a task goes to the task
that compares (others are known to be repeated, and so is the first then). So a passage that stands everywhere is sent once by each task, not once for
each copy. What tasks remember is bounded; what is forgotten is only asked for again.

Null texts have no words. A document of fewer words than a window stays whole. Rows are told apart by id and text, so null
and repeated ids are documents of their own, and a row that is repeated with its text is a copy. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memory
from .common import id_text, partitions

WINDOW, ROUNDS, LONGEST = 35, 2, 8
CHUNK = 250_000  # words handled at once; more only for a document that is longer
HELD = 400_000  # windows or anchors gathered before they are compared with what a task has seen
REMEMBERED = 4_000_000  # anchors or runs of windows a task knows of those it has sent
BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ U(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Words:
    """Hashes of words, remembered."""

    def __init__(self, size: int = 200_000):
        self.known = Memory(size, "words")

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out, new = self.known.many(words)
        if new:
            fresh = {w: word_hash(w) for w in set(new)}
            for w, x in fresh.items():
                if len(w) < 60:
                    self.known.put(w, x)
            found = map(fresh.__getitem__, new)
            out = [next(found) if x is None else x for x in out]
        return np.array(out, np.uint64)


class Parsed:
    """Several documents' words, each between end marks, with the windows and their anchors.

    The mark before the first document bars its first symbol from windows, as the mark of the document before does in others:
    so anchors don't depend on where batches and chunks are cut. Windows with one anchor that follow each other are a region; regions are what tasks exchange.
    """

    def __init__(self, docs: list[np.ndarray], window: int = WINDOW, rounds: int = ROUNDS, longest: int = LONGEST):
        self.window = window
        sizes = np.array([len(d) for d in docs], np.int64)
        self.first = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        n = 1 + int((sizes + 1).sum())
        self.h = np.zeros(n, np.uint64)
        mark = np.zeros(n, bool)
        mark[0] = True
        mark[self.first + sizes] = True
        self.h[~mark] = np.concatenate([*docs, np.zeros(0, np.uint64)])
        with np.errstate(over="ignore"):
            self.sums()
            self.symbols(mark, rounds, longest)
            self.regions(sizes)

    def sums(self) -> None:
        """Prefix sums of hash * BASE ** place, by which any span's words are hashed."""
        n = len(self.h)
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        back = np.full(n + 1, inverse, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(self.h, 1) * self.power[:n])])

    def span(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.back[a] + (b - a).astype(np.uint64), salt)

    def symbols(self, mark: np.ndarray, rounds: int, longest: int) -> None:
        n = len(self.h)
        start = np.arange(n)
        name, low, high, end, barred = self.h.copy(), start.copy(), start + 1, start + 1, mark.copy()
        name[mark] = mix(np.flatnonzero(mark).astype(np.uint64), 99)
        for r in range(rounds):
            # runs
            k = len(name)
            new = np.ones(k, bool)
            new[1:] = (name[1:] != name[:-1]) | barred[1:] | barred[:-1]
            a = np.flatnonzero(new)
            b = np.append(a[1:], k) - 1
            joined = (b > a) & (end[b] - start[a] <= longest)
            run = np.cumsum(new) - 1
            head = new | ~joined[run]
            at, run = np.flatnonzero(head), run[head]
            last = np.where(joined[run], b[run], at)
            count = (last - at + 1).astype(np.uint64)
            name, start, end, barred = np.where(count > 1, mix(name[at] + count, 2), name[at]), start[at], end[last], barred[at]
            low, high = low[np.maximum(a - 1, 0)][run], high[np.minimum(b + 1, k - 1)][run]
            # pairs
            k = len(name)
            right = (mix(name, 10 + r) >> U(63)).astype(bool)
            pair = np.zeros(k, bool)
            pair[:-1] = ~right[:-1] & right[1:] & ~barred[:-1] & ~barred[1:] & (end[1:] - start[:-1] <= longest)
            head = np.ones(k, bool)
            head[1:] = ~pair[:-1]
            at = np.flatnonzero(head)
            two = pair[at]
            nxt, prev = np.minimum(at + 1, k - 1), np.maximum(at - 1, 0)
            left = ~right[at]
            name, start, end, barred = np.where(two, mix(name[at] * BASE + name[nxt], 3), name[at]), start[at], np.where(two, end[nxt], end[at]), barred[at]
            low, high = np.where(left, low[at], low[prev]), np.where(left, high[nxt], high[at])
        low, high = low.copy(), high.copy()
        low[barred], high[barred] = np.maximum.accumulate(low)[barred], high[barred]
        self.low, self.high, self.name, self.barred = low, high, name, barred

    def regions(self, sizes: np.ndarray) -> None:
        """Arrays of regions: doc, at (first window, from the document's start), count, key; and of windows: hash."""
        w, n = self.window, len(self.h)
        many = np.maximum(sizes - w + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), many)
        i = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + self.first[doc]
        self.hash = self.span(i, i + w, 5)
        # symbols from a to b have their spans inside the window; spans begin and end in order
        a = np.cumsum(np.bincount(self.low + 1, minlength=n + 2))[i]
        b = np.cumsum(np.bincount(self.high, minlength=n + 2))[i + w] - 1
        best = mix(self.name, 7)
        best[self.barred] = U((1 << 64) - 1)
        anchor = np.full(len(i), -1, np.int64)
        some = np.flatnonzero(b >= a)
        if len(some):
            size = (b - a + 1)[some]
            level = np.floor(np.log2(size)).astype(np.int64)
            table = np.arange(len(best))
            for k in range(int(level.max()) + 1):
                if k:
                    half = 1 << (k - 1)
                    other = table[np.minimum(np.arange(len(best)) + half, len(best) - 1)]
                    table = np.where(best[other] < best[table], other, table)
                here = some[level == k]
                x, y = table[a[here]], table[b[here] - (1 << k) + 1]
                anchor[here] = np.where(best[y] < best[x], y, x)
        new = np.ones(len(i), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (anchor[1:] < 0)
        first = np.flatnonzero(new)
        held = anchor[first]
        self.doc, self.at, self.count, self.start = doc[first], i[first] - self.first[doc[first]], np.diff(np.append(first, len(i))), first
        low, high = self.low[np.maximum(held, 0)], self.high[np.maximum(held, 0)]
        if len(held):
            none = held < 0
            low, high = np.where(none, 0, low), np.where(none, 0, high)
            self.key = np.where(none, mix(self.hash[first], 8), self.span(low, high, 6))
        else:
            self.key = np.zeros(0, np.uint64)

    def runs(self, start: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
        """A hash of each run of windows: of their hashes in order, their number and their anchor."""
        if not len(start):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            of = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            total = np.add.reduceat(mix(self.hash[of] + inner.astype(np.uint64) * BASE, 12), np.cumsum(count) - count)
            return mix(total ^ mix(key + count.astype(np.uint64), 13), 14)


def chunks(batch: pa.RecordBatch, hashes: Words) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of a batch in groups of about CHUNK words: the first row, and the hashes of each row's words."""
    held, first, n = [], 0, 0
    for k, text in enumerate(batch.column("text").cast(pa.binary())):
        words = (text.as_py() or b"").split()
        held.append(hashes(words))
        n += len(words)
        if n >= CHUNK:
            yield first, held
            held, first, n = [], k + 1, 0
    if held:
        yield first, held


_hashes: list[Words] = []


def hasher() -> Words:
    if not _hashes:
        _hashes.append(Words())
    return _hashes[0]


class Seen:
    """Unlike keys a task has met, each with its first place until the key comes again."""

    def __init__(self, places: int):
        self.key, self.again, self.place = np.zeros(0, np.uint64), np.zeros(0, bool), [np.zeros(0, np.int64) for _ in range(places)]

    def holds(self, key: np.ndarray) -> np.ndarray:
        near = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return self.key[near] == key if len(self.key) else np.zeros(len(key), bool)

    def add(self, key: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the new ones are repeated (here or before), and the first places of those seen once until now."""
        unlike, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        near = np.minimum(np.searchsorted(self.key, unlike), max(len(self.key) - 1, 0))
        known = self.key[near] == unlike if len(self.key) else np.zeros(len(unlike), bool)
        repeated = known | (n > 1)
        old = near[known]
        late = old[~self.again[old]]
        freed = [x[late] for x in self.place]
        self.again[old] = True
        fresh = ~known
        order = np.searchsorted(self.key, unlike[fresh])
        self.key = np.insert(self.key, order, unlike[fresh])
        self.again = np.insert(self.again, order, (n > 1)[fresh])
        self.place = [np.insert(x, order, y[first[fresh]]) for x, y in zip(self.place, place)]
        return repeated[back], freed


class Sent:
    """What a task has sent: tells what it meets again, with the place where it was met first, and forgets all when it is too much."""

    def __init__(self):
        self.seen = Seen(3)

    def __call__(self, key: np.ndarray, uid: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which rows are to be sent (the first of each key), and (uid, at, count) of all that is now known to be repeated."""
        if len(self.seen.key) > REMEMBERED:
            self.seen = Seen(3)
        fresh = np.zeros(len(key), bool)
        unlike, first = np.unique(key, return_index=True)
        fresh[first[~self.seen.holds(unlike)]] = True
        on, freed = self.seen.add(key, uid, at, count)
        return fresh, [np.concatenate([x[on], y]) for x, y in zip((uid, at, count), freed)]


def _spread(uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys for rows that may go to any task."""
    with np.errstate(over="ignore"):
        return mix(uid.view(np.uint64) + at.astype(np.uint64), 11).view(np.int64)


def _anchors(window: int):
    """key, uid, at of each region, and whether its anchor is known to be repeated; of the others each key stands once for each task."""

    def run(batches):
        hashes, sent = hasher(), Sent()
        for b in batches:
            uid = b.column("uid").to_numpy()
            for first, docs in chunks(b, hashes):
                p = Parsed(docs, window)
                at, u = p.at, uid[first + p.doc]
                ask, (known_u, known_at, _) = sent(p.key, u, at, p.count)
                told = np.repeat([False, True], [ask.sum(), len(known_u)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p.key[ask].view(np.int64), _spread(known_u, known_at)])), pa.array(np.concatenate([u[ask], known_u])), pa.array(np.concatenate([at[ask], known_at]).astype(np.int32)), pa.array(told)],
                    ["key", "uid", "at", "told"],
                )

    return run


def _repeated_anchors(batches):
    seen, held, n = Seen(2), [], 0

    def flush():
        key, uid, at, told = (np.concatenate(x) for x in zip(*held))
        on, (u, a) = seen.add(key[~told].view(np.uint64), uid[~told], at[~told])
        on = np.concatenate([np.flatnonzero(~told)[on], np.flatnonzero(told)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([uid[on], u])), pa.array(np.concatenate([at[on], a]).astype(np.int32))], ["uid", "at"])

    for b in batches:
        held.append((b.column("key").to_numpy(), b.column("uid").to_numpy(), b.column("at").to_numpy(), b.column("told").to_numpy(zero_copy_only=False)))
        n += b.num_rows
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _regions(window: int):
    """The regions at the places in `places`: key, uid, at, count and the hashes of their windows, or none where all of these are known to be repeated."""

    def run(batches):
        hashes, sent = hasher(), Sent()
        for b in batches:
            uid, places = b.column("uid").to_numpy(), b.column("places")
            for first, docs in chunks(b, hashes):
                p = Parsed(docs, window)
                wanted = [np.asarray(places[first + k].values) for k in range(len(docs))]
                on = np.zeros(len(p.h) + 1, bool)
                on[np.concatenate([w + f for w, f in zip(wanted, p.first)])] = True
                here = np.flatnonzero(on[p.at + p.first[p.doc]])
                start, count, u, at, key = p.start[here], p.count[here], uid[first + p.doc[here]], p.at[here], p.key[here]
                ask, (known_u, known_at, known_n) = sent(p.runs(start, count, key), u, at, count)
                size = count[ask]
                of = np.repeat(start[ask], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size) * 8, np.full(len(known_u), size.sum() * 8)]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(p.hash[of].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key[ask].view(np.int64), _spread(known_u, known_at)])),
                        pa.array(np.concatenate([u[ask], known_u])),
                        pa.array(np.concatenate([at[ask], known_at]).astype(np.int32)),
                        pa.array(np.concatenate([size, known_n]).astype(np.int32)),
                        held,
                    ],
                    ["key", "uid", "at", "count", "hashes"],
                )

    return run


def _spans(uid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """uid, first, last of windows that follow each other."""
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (at[1:] - at[:-1] > 1)
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(uid)) - 1 if len(s) else s
    return pa.RecordBatch.from_arrays([pa.array(uid[s]), pa.array(at[s].astype(np.int32)), pa.array(at[e].astype(np.int32))], ["uid", "first", "last"])


def _repeated_windows(batches):
    """The spans of repeated windows. Rows come sorted by key, so windows of one anchor are together; only those of the last one are kept for the next rows."""
    key_now, seen, held, n = None, Seen(2), [], 0

    def flush():
        nonlocal key_now, seen
        key, hashes, uid, at = (np.concatenate(x) for x in zip(*held))
        found = []
        a = int(np.searchsorted(key, key_now, "right")) if key_now is not None and key[0] == key_now else 0
        b = int(np.searchsorted(key, key[-1], "left"))
        if a:
            on, freed = seen.add(hashes[:a], uid[:a], at[:a])
            found += [(uid[:a][on], at[:a][on]), tuple(freed)]
        if a < b:
            order = a + np.lexsort((hashes[a:b], key[a:b]))
            same = (key[order][1:] == key[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
            on = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            found.append((uid[on], at[on]))
        if a <= b:
            key_now, seen = key[-1], Seen(2)
            on, freed = seen.add(hashes[b:], uid[b:], at[b:])
            found += [(uid[b:][on], at[b:][on]), tuple(freed)]
        return _spans(*(np.concatenate(x) for x in zip(*found)))

    for b in batches:
        size = b.column("count").to_numpy().astype(np.int64)
        uid, at, key = b.column("uid").to_numpy(), b.column("at").to_numpy().astype(np.int64), b.column("key").to_numpy()
        column = b.column("hashes")
        hashes = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        told = np.array(pa.compute.binary_length(column)) == 0
        if told.any():
            yield pa.RecordBatch.from_arrays([pa.array(uid[told]), pa.array(at[told].astype(np.int32)), pa.array((at + size - 1)[told].astype(np.int32))], ["uid", "first", "last"])
            uid, at, key, size = uid[~told], at[~told], key[~told], size[~told]
        if len(key):
            inner = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
            held.append((np.repeat(key, size), hashes, np.repeat(uid, size), np.repeat(at, size) + inner))
            n += len(hashes)
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _removed(window: int, with_text: bool):
    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                words = (text or b"").split()
                n = len(words)
                if spans:
                    on = np.zeros(n + 1, np.int64)
                    for s in spans:
                        on[s["first"]] += 1
                        on[min(n, s["last"] + window)] -= 1
                    keep = np.cumsum(on)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            cols = list(zip(*rows)) or [()] * 4
            out = [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array(cols[3], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def substring_dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each row of df."""
    n = partitions(df.sparkSession)
    docs = id_text(df, id_col, text_col).withColumn("uid", F.xxhash64("doc_id", "text"))
    anchors = docs.select("uid", "text").mapInArrow(_anchors(window), "key long, uid long, at int, told boolean")
    repeated = anchors.repartition(n, "key").mapInArrow(_repeated_anchors, "uid long, at int")
    places = repeated.groupBy("uid").agg(F.collect_set("at").alias("places"))
    regions = docs.join(places, "uid").select("uid", "text", "places").mapInArrow(_regions(window), "key long, uid long, at int, count int, hashes binary")
    windows = regions.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_repeated_windows, "uid long, first int, last int")
    spans = windows.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return docs.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(_removed(window, with_text), out)
