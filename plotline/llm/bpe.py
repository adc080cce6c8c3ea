"""Byte-level BPE encoding and decoding in linear time.

A piece (a match of the pattern) is mapped byte by byte to Latin-1, an Aho-Corasick automaton over the tokens gives the longest
token at each place, and a walk over the piece takes longest matches first and steps back where two neighbouring
tokens are not compatible, that is where merging their bytes by rank does not give just these two. The encoding by
ranks is the only sequence whose neighbours are all compatible. Compatibility is remembered.

Null and empty texts have no ids. Rows with null ids and repeated ids are encoded as any other row.
"""

import base64
import hashlib
import weakref

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text

CACHE = 250_000
PAIRS = 400_000


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memory(dict):
    """Remembers between size and twice size entries: when the young half is full it becomes the old one, and the old one goes.

    A Python worker serves one operator after the other; once one of them asks its memories, those of others are emptied.
    """

    every: list["weakref.ref[Memory]"] = []
    asking = ""

    def __init__(self, size: int, owner: str = ""):
        super().__init__()
        self.size, self.owner, self.old, self.unknown = size, owner, {}, []
        Memory.every.append(weakref.ref(self))

    def __missing__(self, key):
        x = self.old.get(key)
        if x is None:
            self.unknown.append(key)
        else:
            self.put(key, x)
        return x

    def many(self, keys: list) -> tuple[list, list]:
        """The values (None where unknown), and the unknown keys in their order, repeats too."""
        if Memory.asking != self.owner:
            Memory.asking = self.owner
            for held in Memory.every:
                other = held()
                if other is not None and other.owner != self.owner:
                    other.clear()
                    other.old = {}
        self.unknown = []
        return list(map(self.__getitem__, keys)), self.unknown

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.length_of = list(map(len, self.bytes_of))
        self.kind = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        #: The longest token that each token begins with, other than itself; -1: none.
        self.shorter = [next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in self.bytes_of]
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known = Memory(CACHE, "bpe")
        self.spaced = Memory(CACHE, "bpe")

    def merged(self, data: bytes) -> list[int]:
        """The plain merges of lowest rank, for the few bytes of one or two tokens."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [ranks.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
            rank = min(found)
            if rank == 1 << 60:
                break
            at = found.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: nothing)."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        ok = self.merged(self.bytes_of[b]) == [b] if a < 0 else self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        self.pairs[a << 32 | b] = ok
        return ok

    def piece(self, text: str) -> bytes:
        data = text.encode()
        if (whole := self.ranks.get(data)) is not None:
            return np.array([whole], self.kind).tobytes()
        n = len(data)
        length_of, shorter, pairs = self.length_of, self.shorter, self.pairs
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length_of[token]] = token  # of those that begin here, the longest ends last
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which nothing leads to the end; each is reached by one sequence only
        pos, before, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                if not dead[pos + length_of[token]]:
                    ok = pairs.get(before << 32 | token)
                    if ok or ok is None and self.fits(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length_of[token]
                if pos == n:
                    return np.array(out, self.kind).tobytes()
                before, token = token, longest[pos]
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= length_of[token]
                before = out[-1] if out else -1

    def packed(self, text: str) -> bytes:
        """The ids as little-endian integers of self.kind."""
        first, *rest = text.split(" ")
        if first[-1:].isspace():
            return self.slow(text)
        out, new = self.spaced.many(rest)
        if new:
            if not all(p and not p[0].isspace() and not p[-1].isspace() for p in new):
                return self.slow(text)
            fresh = {p: self.slow(" " + p) for p in set(new)}
            for p, x in fresh.items():
                if len(p) < 100:
                    self.spaced.put(p, x)
            found = map(fresh.__getitem__, new)
            out = [next(found) if x is None else x for x in out]
        return self.slow(first) + b"".join(out)

    def slow(self, text: str) -> bytes:
        got = []
        self.known.unknown = []
        for p in self.pieces(text):
            x = self.known[p]
            if x is None:
                x = self.piece(p)
                if len(p) < 100:
                    self.known.put(p, x)
            got.append(x)
        return b"".join(got)

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict[tuple[str, str], tuple[Bpe, list[str]]] = {}


def made(path: str, pattern: str) -> tuple[Bpe, list[str]]:
    if (path, pattern) not in _made:
        bpe = Bpe(ranks_of(path), pattern)
        _made[path, pattern] = bpe, [str(i) for i in range(len(bpe.bytes_of))]
    return _made[path, pattern]


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches):
        bpe, _ = made(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.ids(x) for x in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, data (bytes) from doc_id, ids; null ids give null."""

    def run(batches):
        bpe, _ = made(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and gives digests of both in one pass."""

    def run(batches):
        bpe, text_of = made(ranks, pattern)
        for b in batches:
            rows = []
            for x in b.column("text").to_pylist():
                ids = bpe.ids(x)
                said = ",".join(map(text_of.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
