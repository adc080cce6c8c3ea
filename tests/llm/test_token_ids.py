import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotline.llm.common import new_folder
from plotline.llm.token_ids import PieceEncoder, read_token_files, token_ids, write_token_files

from .helpers import documents, edges, empty, rows, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_documents(spark, plain):
    df = documents(spark)
    start, want = 0, []
    for i, t in sorted(texts(df)):
        ids = [*plain(t or ""), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_ids(df, PATH, 0)) == want


def test_edges(spark, plain):
    df = edges(spark)
    got = token_ids(df, PATH, 0).collect()
    want = sorted((str(i), len(plain(t or "")) + 1, zlib.crc32(np.array([*plain(t or ""), 0], "<u4").tobytes())) for i, t in texts(df))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_pieces_encode_as_whole_texts(plain):
    enc = PieceEncoder(PATH)
    for text in ["", " ", "a b", " lead", "trail ", "a  b", "x.\ny z.", "don't we'll it.", "1,5 a., b.. c", "é. ü, ß.", "a b c d", "tab\t x", "A. B, C.", "<|endoftext|> x"]:
        for _ in range(2):  # the second time from memory
            assert np.frombuffer(enc.encode(text), enc.kind).tolist() == plain(text), text


def test_files_are_whole_and_mapped(spark, plain):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    folder = new_folder(spark, "files")
    parts = write_token_files(df, PATH, folder, None)
    assert sum(p[1] for p in parts) == 50

    def each(doc, starts, lengths, ids):
        import pyarrow as pa

        assert isinstance(ids(0), np.memmap)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(np.asarray(doc)), "ids": pa.array([ids(k).tolist() for k in range(len(doc))], pa.list_(pa.int32()))})

    back = read_token_files(spark, folder, parts, "doc_id long, ids array<int>", each)
    assert {r.doc_id: r.ids for r in back.collect()} == {i: plain(f"text number {i}") for i in range(50)}


def test_empty_table(spark):
    assert rows(token_ids(empty(spark), PATH, 0)) == []
    assert token_ids(spark.createDataFrame([(1, None)], "doc_id long, text string").withColumn("start", F.lit(5)), PATH, 0).collect()[0].n_tokens == 1
