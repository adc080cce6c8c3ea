"""Token ids as flat files: unsigned integers, 64-bit document offsets, memory-mapped readers.

A set of files is a folder with, for each partition p of a range partitioning by id, part-p.bin (ids, two bytes each if the
vocabulary allows, else four), part-p.off (where each document ends, in ids from the start of the part) and part-p.doc
(document ids). The base of a part is the prefix sum of the lengths of those before it. Files are written under a
name of the attempt and renamed, so retried and speculative tasks leave whole files.

Null texts are empty texts; a null id sorts first and is read back as null. Rows that repeat an id are separate
documents, in the order of their texts. An empty table gives no rows.
"""

import json
import os
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memory
from .common import id_text, new_folder, partitions

NO_ID = -(1 << 63)
CACHE = 500_000


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, remembering pieces between single spaces.

    Such a tokenizer never joins what stands before a space with what stands after it, so a piece with its space
    encodes alike everywhere, unless white space touches white space; texts with that are encoded whole.
    The memory holds at most twice CACHE pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        #: Whether pieces may be encoded apart: nothing rewrites a text before it is cut, and it is cut at each space as GPT-2 does.
        self.by_pieces = told.get("normalizer") is None and (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and told["pre_tokenizer"].get("use_regex", True) and not told["pre_tokenizer"].get("add_prefix_space")
        self.length_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # in bytes; byte-level tokens have a letter for each byte
        for token, i in self.tokenizer.get_vocab().items():
            self.length_of[i] = len(token)
        self.marks = {x: self.whole(x) for x in ".,"}
        self.known = Memory(CACHE, "token ids")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def together(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece with a space before it, from one call: the pieces are cut apart by the tokens' lengths."""
        data = self.whole("".join([f" {p}" for p in pieces]))
        ends = np.cumsum(self.length_of[np.frombuffer(data, self.kind)])
        places = np.cumsum([len(p.encode()) + 1 for p in pieces])
        cuts = np.searchsorted(ends, places, side="right") * self.kind.itemsize
        if not np.array_equal(ends[cuts // self.kind.itemsize - 1], places):  # a token reaches over a space: pieces can't be told apart
            self.by_pieces = False
            return {p: self.whole(f" {p}") for p in pieces}
        return {p: data[a:b] for p, a, b in zip(pieces, [0, *cuts.tolist()], cuts.tolist())}

    def encode(self, text: str) -> bytes:
        first, *pieces = text.split(" ")
        if not self.by_pieces or first[-1:].isspace():
            return self.whole(text)
        out, new = self.known.many(pieces)
        if new:
            if not all(p and not p[0].isspace() and not p[-1].isspace() for p in new):
                return self.whole(text)
            # letters and one mark are two pieces of the tokenizer's, so the letters alone are looked up and kept
            bare = [p[:-1] if p[-1] in ".," and p[:-1].isalpha() else p for p in new]
            got, unknown = self.known.many(bare)
            fresh = self.together(list(dict.fromkeys(unknown))) if unknown else {}
            for p, x in fresh.items():
                if len(p) < 100:
                    self.known.put(p, x)
            found = []
            for p, b, x in zip(new, bare, got):
                x = fresh[b] if x is None else x
                if b is not p:
                    x += self.marks[p[-1]]
                    self.known.put(p, x)
                found.append(x)
            found = iter(found)
            out = [next(found) if x is None else x for x in out]
        return self.whole(first) + b"".join(out) if first else b"".join(out)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _store(folder: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    return fs, path


def write_token_files(df: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int, int]]:
    """Writes the files in ascending order of id; gives (part, documents, ids, bytes of an id) of each part that has documents.

    What comes to the driver is one row for each partition.
    """
    n = partitions(df.sparkSession)
    ordered = id_text(df, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        context = TaskContext.get()
        part = context.partitionId()
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        names = [f"{path}/part-{part:06d}.{x}" for x in ("bin", "off", "doc")]
        held = [f"{x}.{context.taskAttemptId()}" for x in names]
        docs = ids = 0
        with fs.open_output_stream(held[0]) as a, fs.open_output_stream(held[1]) as b, fs.open_output_stream(held[2]) as c:
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    data = enc.encode(text) + end
                    ids += len(data) // enc.kind.itemsize
                    a.write(data)
                    b.write(np.array([ids], "<u8").tobytes())
                c.write(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                docs += batch.num_rows
        for x, y in zip(held, names):
            fs.move(x, y)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([docs], pa.int64()), "ids": pa.array([ids], pa.int64()), "width": pa.array([enc.kind.itemsize], pa.int32())})

    found = sorted(ordered.mapInArrow(write, "part int, docs long, ids long, width int").collect())
    return [(r.part, r.docs, r.ids, r.width) for r in found if r.docs]


def read_token_files(spark, folder: str, parts: list[tuple[int, int, int, int]], columns: str, each) -> DataFrame:
    """each(doc_ids, starts, lengths, ids) gives a record batch of the columns; ids is mapped, not read."""
    bases = [0, *accumulate(x[2] for x in parts)]
    if not parts:
        return spark.createDataFrame([], columns)
    table = spark.createDataFrame([(p, base, docs, n, w) for (p, docs, n, w), base in zip(parts, bases)], "part int, base long, docs long, ids long, width int")

    def mapped(fs, path, kind, count):
        if count == 0:
            return np.zeros(0, kind)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            return np.memmap(path, kind, "r", shape=(count,))
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), kind)

    def read(batches):
        fs, path = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/part-{row['part']:06d}"
                ids = mapped(fs, f"{name}.bin", f"<u{row['width']}", row["ids"])
                ends = mapped(fs, f"{name}.off", "<u8", row["docs"]).astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                doc = mapped(fs, f"{name}.doc", "<i8", row["docs"])
                for k in range(0, len(doc), 4096):
                    s = slice(k, k + 4096)
                    yield each(doc[s], row["base"] + starts[s], (ends - starts)[s], lambda i, k=k: ids[starts[k + i] : ends[k + i]])

    return table.repartition(len(parts), "part").mapInArrow(read, columns)


def digests(doc, starts, lengths, ids) -> pa.RecordBatch:
    crc = [zlib.crc32(np.asarray(ids(i)).astype("<u4").tobytes()) for i in range(len(doc))]
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(np.asarray(doc), pa.int64(), mask=np.asarray(doc) == NO_ID), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    )


def token_ids(df: DataFrame, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as read back from files in the shared folder."""
    spark = df.sparkSession
    folder = new_folder(spark, "token-ids")
    parts = write_token_files(df, tokenizer, folder, end_id, id_col, text_col)
    return read_token_files(spark, folder, parts, "doc_id long, start long, n_tokens long, ids_crc32 long", digests)
