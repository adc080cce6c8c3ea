import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from plotline.llm.bpe import Bpe, Memory, decode, encode, ranks_of, round_trip

from .helpers import documents, edges, empty, rows, texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("make", [documents, edges])
def test_as_the_library(spark, plain, make):
    df = make(spark)
    want = [(i, len(plain(t or "")), sha(",".join(map(str, plain(t or ""))).encode()), sha((t or "").encode())) for i, t in texts(df)]
    assert sorted((tuple(r) for r in round_trip(df, PATH, P.PATTERN).collect()), key=str) == sorted(want, key=str)


def test_random_texts(plain):
    bpe = Bpe(ranks_of(PATH), P.PATTERN)
    rng = random.Random(3)
    alphabet = "aabcdeeefghilmnoprstu  .,'\n\tÉéżß日本語🎉0123ABC_-"
    for n in [1, 2, 5, 30, 300] * 60:
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert bpe.ids(text) == plain(text), text
        assert bpe.decode(bpe.ids(text)) == text.encode()
    for text in ["x" * 3000, "ab" * 2000, "é" * 999, "́" * 50]:
        assert bpe.ids(text) == plain(text)


def test_encode_then_decode(spark):
    df = edges(spark)
    back = decode(encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(((r.doc_id, bytes(r.data).decode()) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in texts(df)), key=str)


def test_empty_table(spark):
    assert rows(round_trip(empty(spark), PATH, P.PATTERN)) == []


def test_memory_forgets_the_oldest():
    m = Memory(2)
    for k in "abcdef":
        m.put(k, k)
    assert len(m) + len(m.old) <= 4 and m["f"] == "f" and m.many(["a", "f"]) == ([None, "f"], ["a"])
