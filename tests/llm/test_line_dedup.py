import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotline.llm import line_dedup as module
from plotline.llm.line_dedup import banded, candidates, line_dedup, lines_of
from plotline.llm.queries import op1_line_dedup

from .helpers import documents, edges, empty, rows, texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, tau):
    if a == b:
        return True
    if abs(len(a) - len(b)) > tau:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= tau or distance(a, b) <= tau


def brute(docs, tau=2, least=20):
    """What stands before counts although it is removed itself."""
    before, out = set(), []
    for i, t in sorted(docs):
        lines = [] if t is None else t.split("\n")
        gone = []
        for pos, x in enumerate(lines):
            if len(x) >= least:
                if x in before or any(near(x, y, tau) for y in before):
                    gone.append(pos)
                before.add(x)
        out.append((i, len(lines), len(gone), ",".join(map(str, gone)), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_edited_lines(spark, seed):
    rng = random.Random(seed)
    letters = "abcdef ghij éß🎉"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(18, 45))) for _ in range(40)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                at = rng.randrange(len(x))
                x[at : at + rng.choice([0, 1])] = [rng.choice(letters)] * rng.choice([0, 1])
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(line_dedup(df, least=20, with_text=True)) == brute(docs)


def test_documents(spark):
    """All lines of the table, near ones too: of any two within two edits, pieces of a third of the shorter one stand in both."""
    df = documents(spark)
    by_piece, want = {}, {}
    for i, t in sorted(texts(df)):
        gone = []
        for pos, x in enumerate((t or "").split("\n")):
            if not x.strip():
                continue
            # lines of one to two characters more or less share a third, at most two places off
            met = set()
            for n in range(max(5, len(x) - 2), len(x) + 3) if len(x) >= 5 else ():
                cuts = [0, n // 3, 2 * n // 3, n]
                for k in range(3):
                    for shift in range(-2, 3):
                        a = cuts[k] + shift
                        if 0 <= a and a + cuts[k + 1] - cuts[k] <= len(x):
                            met |= by_piece.get((n, k, x[a : a + cuts[k + 1] - cuts[k]]), set())
            if x in by_piece or any(near(x, y, 2) for y in met):
                gone.append(pos)
            if x not in by_piece:
                by_piece[x] = {x}
                cuts = [0, len(x) // 3, 2 * len(x) // 3, len(x)]
                for k in range(3 if len(x) >= 5 else 0):
                    by_piece.setdefault((len(x), k, x[cuts[k] : cuts[k + 1]]), set()).add(x)
        want[i] = (i, len(t.split("\n")) if t is not None else 0, len(gone), ",".join(map(str, gone)))
    assert rows(line_dedup(df)) == [want[i] for i in sorted(want)]
    assert sum(w[2] for w in want.values()) > 50


def variants(n):
    """Lines that share most of their text and are unlike: one long word of its own in each, at the place of another."""
    rng = random.Random(3)
    base = [f"word{k:02d}" for k in range(60)]
    out = []
    for k in range(n):
        words = list(base)
        words[rng.randrange(60)] = "".join(rng.choice("bcdfghklmnpqrstvwxz") for _ in range(9))
        out.append(" ".join(words))
    return out


def test_pairs_do_not_grow_with_the_square_of_unlike_lines(spark):
    lines = variants(400)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    docs = df.withColumn("text_hash", F.xxhash64("doc_id", "text"))
    assert candidates(lines_of(docs), 2).count() < 400 * 400 // 2 // 20
    assert line_dedup(df).agg(F.sum("n_removed")).first()[0] == 0


def test_only_lines_that_share_a_key_are_marked(spark, monkeypatch):
    """Marks are dear: 300 lines have nothing in common with another line, two are an edit apart."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("bcdfghklmnpqrstvwxz") for _ in range(60)) for _ in range(300)]
    lines.append(lines[0][:-1] + "!")
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    marked, marks = [], module.with_marks
    monkeypatch.setattr(module, "with_marks", lambda x: (marked.append(x.count()), marks(x))[1])
    assert line_dedup(df).where("n_removed = 1").select("doc_id").collect() == [(300,)]
    assert marked == [2]


def test_edges(spark):
    df = edges(spark)
    got = line_dedup(df, with_text=True).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert by[9001].n_lines == 0 and by[9001].kept_text is None
    assert by[9002].kept_text == "" and by[9002].n_removed == 0
    assert by[9006].n_removed == 0 and by[9007].n_removed == 1 and by[9007].kept_text == ""


@pytest.mark.parametrize("tau", [1, 2, 4])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abc🎉") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, tau + 2)):
            at = rng.randint(0, len(b))
            b[at : at + rng.choice([0, 1])] = [rng.choice("abcd")] * rng.choice([0, 1])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", banded(F.col("a"), F.col("b"), tau).alias("d")).collect():
        d = distance(r.a, r.b)
        assert r.d == d if d <= tau else r.d > tau, (r.a, r.b, r.d, d)


def brute_short(docs, tau=2):
    """All lines that are not blank; edits count from 2 tau + 1 characters on."""
    before, out = set(), []
    for i, t in sorted(docs):
        gone = []
        for pos, x in enumerate(t.split("\n")):
            if x.strip():
                if x in before or len(x) > 2 * tau and any(len(y) > 2 * tau and near(x, y, tau) for y in before):
                    gone.append(pos)
                before.add(x)
        out.append((i, t.count("\n") + 1, len(gone), ",".join(map(str, gone)), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return out


def short_lines():
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefghijkl.é🎉") for _ in range(rng.randint(1, 22))) for _ in range(120)]
    return [(i, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool)[:-1], rng.choice(pool) + "x", "", "  "]) for _ in range(rng.randint(1, 6)))) for i in range(60)]


def test_short_lines(spark):
    docs = short_lines()
    assert rows(line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), with_text=True)) == brute_short(docs)


def test_query_and_stage_take_short_lines(spark, tmp_path):
    docs = short_lines()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_short(docs)
    assert rows(op1_line_dedup(spark, str(tmp_path))) == [w[:4] for w in want]
    assert rows(corpus_pipeline.line_dedup_stage(spark, df, "").select("doc_id", "text")) == [(w[0], w[4]) for w in want]


def test_empty_table(spark):
    assert rows(line_dedup(empty(spark))) == []
