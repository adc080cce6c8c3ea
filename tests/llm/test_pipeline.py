import hashlib

import corpus_pipeline
import public_tokenizers as P
import pytest

from plotline.llm.bpe import Bpe, ranks_of
from plotline.llm.decontaminate import decontaminate
from plotline.llm.ngram_join import ngram_components

from .helpers import SMALL, documents, edges, empty
from .test_line_dedup import near

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages_and_result(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    docs, seen = documents(spark), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        assert set(docs.columns) == COLUMNS
        seen.append({r.doc_id: r.text for r in docs.collect()})
    good, lines, unlike, clean = seen
    every = {r.doc_id: r.text for r in documents(spark).collect()}
    assert good.items() <= every.items() and len(good) >= 0.6 * len(every)
    assert lines.keys() == good.keys()
    before = []
    for i in sorted(lines):
        for x in lines[i].split("\n"):
            if len(x) >= 20:
                assert x not in before
                before.append(x)
    gone = set(lines) - set(unlike)
    links = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(list(lines.items()), "doc_id long, text string"), 5, 80).collect()}
    assert gone == {i for i, c in links.items() if i != c}
    leaks = {r.doc_id for r in decontaminate(spark.createDataFrame(list(unlike.items()), "doc_id long, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert set(unlike) - set(clean) == leaks
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    bpe = Bpe(ranks_of(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    assert got.keys() == clean.keys()
    for i, t in clean.items():
        assert got[i].n_tokens == len(bpe.ids(t)) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("make", [edges, empty])
def test_odd_tables_pass_every_stage(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "tokens":
            assert set(out.columns) == COLUMNS
        out.count()


def test_near_helper():
    assert near("kitten sitting here", "kitten sittin here", 2) and not near("aaaa", "bbbb", 2)
