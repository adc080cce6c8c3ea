import random
import re

import pytest
from pyspark.sql import functions as F

from plotline.llm.queries import op10_quote_links
from plotline.llm.quotes import link_quotes, ordered

from .helpers import CLASHING, SMALL, rows

TALK = [
    (1, 0, "user", "Where is the key?\nI lost it."),
    (1, 1, "assistant", "> Where is the   KEY?\nUnder the mat."),
    (1, 2, "user", "> > Where is the key?\n> Under the mat.\nThanks!"),
    (1, 3, "user", "A new matter"),
    (1, 4, "assistant", "> a new matter\nNoted."),
    (2, 0, "user", ">Under the mat.\nQuoting from elsewhere"),
    (2, 1, "user", "> never said by anyone\nhm"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, 2, "user", ">\n> !!!\nnothing to link"),
    (None, 0, "user", "> Where is the key?\nno conversation"),
    (4, None, "user", "no turn"),
    (5, 0, "user", "same"),
    (5, 0, "user", "same"),
    (5, 1, "user", "> same\nyes"),
]


def by_turn(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def table(spark, data=TALK):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_links_threads_and_own_text(spark):
    df = link_quotes(table(spark))
    assert df.count() == len(TALK)
    got = by_turn(df)
    at = lambda *k: (got[k].thread_turn, got[k].reply_conv, got[k].reply_turn, got[k].n_quotes, got[k].n_linked)
    assert at(1, 0) == (0, None, None, 0, 0)
    assert at(1, 1) == (0, 1, 0, 1, 1)
    assert at(1, 2) == (0, 1, 1, 2, 2)
    assert at(1, 3) == (3, None, None, 0, 0)
    assert at(1, 4) == (3, 1, 3, 1, 1)
    assert at(2, 0) == (0, 1, 1, 1, 1)
    assert at(2, 1) == (1, None, None, 1, 0)
    assert at(3, 2) == (2, None, None, 0, 0)
    assert at(5, 1) == (0, 5, 0, 1, 1)
    assert got[1, 2].own_text == "Thanks!" and got[3, 0].own_text == ""
    assert got[None, 0].own_text == "no conversation"
    order = [(r.conv_id, r.turn) for r in ordered(df).collect() if r.conv_id == 1]
    assert order == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_lines_and_paragraphs_out_of_a_longer_message(spark):
    data = [
        (1, 0, "user", "First line.\nSecond line.\n\nThird line.\nFourth line."),
        (1, 1, "user", "> second  LINE.\n>\n> Third line.\nMiddle."),
        (1, 2, "user", "> Third line. Fourth\n> line.\nA paragraph, wrapped anew."),
        (1, 3, "user", "> First line.\n> Third line.\nNot one after the other."),
        (1, 4, "user", "> Fourth line.\n> Fifth line.\nPast the end."),
        (2, 0, "user", "> Third line.\n> Fourth line.\nFrom elsewhere."),
        (3, 0, "user", "Other text."),
        (3, 1, "user", "x\nSecond line.\nThird line.\nagain"),
        (3, 2, "user", "> Second line.\n> Third line.\nThe nearest."),
    ]
    got = by_turn(link_quotes(table(spark, data)))
    at = lambda *k: (got[k].thread_turn, got[k].reply_conv, got[k].reply_turn, got[k].n_quotes, got[k].n_linked)
    assert at(1, 1) == (0, 1, 0, 1, 1)
    assert at(1, 2) == (0, 1, 0, 1, 1)
    assert at(1, 3) == (3, None, None, 1, 0)
    assert at(1, 4) == (4, None, None, 1, 0)
    assert at(2, 0) == (0, 1, 0, 1, 1)
    assert at(3, 2) == (1, 3, 1, 1, 1)


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def levels(text):
    """(level, line) of each line."""
    out = []
    for line in re.split("\r?\n", text):
        m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def runs(lines):
    out = []
    for level, line in lines:
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return out


def told(text, quote):
    """Whether a message has a quote's words as its own: all of them, a paragraph, lines that follow each other, or what stands between its quotes."""
    want, lines = norm("\n".join(quote)), [norm(x) for x in quote if norm(x)]
    own = [x for level, x in levels(text) if not level]
    if want in {norm("\n".join(own)), *(norm(x) for x in own), *(norm(x) for x in re.split(r"\n\s*\n", "\n".join(own)))}:
        return True
    if any(level == 0 and norm("\n".join(x)) == want for level, x in runs(levels(text))) and any(level for level, _ in levels(text)):
        return True
    filled = [norm(x) for x in own if norm(x)]
    return any(filled[i : i + len(lines)] == lines for i in range(len(filled)))


def brute(data):
    """(conv, turn, role, thread, reply_conv, reply_turn, n_quotes, n_linked, own text) of each row, looking through all messages for each quote."""
    found, up = [], {}
    named = [(c, t, x or "") for c, t, _, x in data if c is not None and t is not None]
    for conv, turn, role, text in data:
        quotes = [q for level, q in runs(levels(text or "")) if level and re.search(r"[^\W_]", norm("\n".join(q)))]
        near, far = [], []
        for q in quotes:
            here = [t for c, t, x in named if c == conv and turn is not None and t < turn and told(x, q)]
            if here:
                near.append(max(here))
            elif away := [(c, t) for c, t, x in named if c != conv and told(x, q)]:
                far.append(min(away))
        if near and conv is not None:
            up[conv, turn] = max(near + [up.get((conv, turn), -1)])
        reply = (conv, max(near)) if near else min(far) if far else (None, None)
        found.append([conv, turn, role, *reply, len(quotes), len(near) + len(far), "\n".join(x for level, x in levels(text or "") if not level)])
    for f in found:
        root = f[1]
        while (f[0], root) in up:
            root = up[f[0], root]
        f.insert(3, root)
    return [tuple(f) for f in found]


def talks(seed):
    rng = random.Random(seed)
    pool = [f"{rng.choice(['We', 'They', 'i'])} {rng.choice(['saw', 'took', 'lost'])} the {rng.choice(['key', 'map', 'RED box'])} {k % 7}." for k in range(40)]
    said, out = [], []
    for conv in (1, 2, 3):
        for turn in range(rng.randint(8, 14)):
            lines = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                if said:
                    old = rng.choice(said[-12:]).split("\n")
                    a = rng.randrange(len(old))
                    part = old[a : a + rng.choice([1, 1, 2, 3, len(old)])]
                    change = rng.choice([str.upper, str, lambda x: x.replace(" ", "   "), lambda x: x])
                    lines += [rng.choice(["> ", ">", " > "]) + change(x) for x in part]
                    if rng.random() < 0.2:
                        lines.append(rng.choice(["> never said", ">", "> ...", ">> " + rng.choice(pool)]))
                if rng.random() < 0.6:
                    lines.append(rng.choice(pool))
            for _ in range(rng.randint(0, 4)):
                lines += [rng.choice(pool)] + ([""] if rng.random() < 0.3 else [])
            text = rng.choice(["\n", "\n", "\r\n"]).join(lines) if rng.random() < 0.95 else None
            out.append((conv if rng.random() < 0.95 else None, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), text))
            if text:
                said.append(re.sub("\r", "", text))
    return out + [out[3], out[-1]]


@pytest.mark.parametrize("seed", range(3))
def test_generated_talks(spark, tmp_path, seed):
    """The query over planted quotes, nested and from other conversations, in a table with more columns."""
    data = talks(seed)
    table(spark, data).withColumns({c: F.lit(1) for c in [*CLASHING, "mid", "level", "first", "src_turn", "root"]}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = spark.createDataFrame(brute(data), "conv_id long, turn long, role string, thread_turn long, reply_conv long, reply_turn long, n_quotes long, n_linked long, own_text string")
    got = op10_quote_links(spark, str(tmp_path))
    assert rows(got.select(*want.columns)) == rows(want)
    assert sum(w[7] for w in brute(data)) > 15 and any(w[4] not in (None, w[0]) for w in brute(data))


def test_very_long_text(spark):
    long = "\n".join(f"line {k} of a long text" for k in range(20_000))
    data = [(1, 0, "user", long), (1, 1, "user", "> line 777 of a long text\n> Line 778 of a long text\nyes"), (1, 2, "user", "\n".join(f"> {x}" for x in long.split("\n")) + "\nall of it"), (2, 0, "user", "> " + "word " * 50_000)]
    got = by_turn(link_quotes(table(spark, data)))
    assert [(got[1, k].thread_turn, got[1, k].reply_turn, got[1, k].n_linked, got[1, k].own_text) for k in (1, 2)] == [(0, 0, 1, "yes"), (0, 0, 1, "all of it")]
    assert (got[2, 0].n_quotes, got[2, 0].n_linked) == (1, 0)


def test_deep_reply_chain(spark):
    data = [(7, k, "user", f"> line {k - 1}\nline {k}" if k else "line 0") for k in range(40)]
    got = by_turn(link_quotes(table(spark, data)))
    assert {r.thread_turn for r in got.values()} == {0}
    assert all(got[7, k].reply_turn == k - 1 for k in range(1, 40))


def test_table_and_empty(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = link_quotes(df)
    assert got.count() == df.count()
    assert got.where("own_text RLIKE '(?m)^[ \\t]*>'").count() == 0
    assert rows(link_quotes(table(spark).where("false"))) == []
