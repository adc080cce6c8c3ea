"""Secret scans, with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. The method adds spans: runs of key-like characters that two
character Markov models, one of random strings and one of ordinary identifiers, tell apart by the ratio of their
log-likelihoods: random strings made from digests, and the words of all documents that no base rule marks. Where the documents
give more pairs of characters than the random strings, their counts are scaled down to as many, so that what is smoothed
does not depend on the size of the table.

Spans are in code points, end exclusive. Null and empty texts have no spans. Null ids and repeated rows are scanned
as any other row. An empty table gives no rows, and the models are then those of random strings against nothing.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: The base rules. Failing matches (too short) are dropped after matching.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as [A-Z0-9]+ with 20 or more characters in all
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ with 24 or more
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET)
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLE_RANDOM = 6000
RATIO = 0.7  # mean log-likelihood ratio of a pair of characters, in nats, from which a run is a secret


def matches(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """The spans of the leftmost non-overlapping matches, in order; those whose group is shorter than least are dropped."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    no = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    packed = F.arrays_zip(between.alias("b"), found.alias("m"), held.alias("g"))

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        ok = F.length(x["g"]) >= least
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.when(ok, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")))

    spans = F.aggregate(packed, F.struct(F.lit(0).alias("at"), no.alias("spans")), step)["spans"]
    return F.when(text.rlike(pattern), spans).otherwise(no)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    no = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return matches(text, ASSIGN, "assign", 2, ASSIGN_LEAST), F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")).otherwise(no), matches(text, HEX, "hex")


def _pairs(tokens: DataFrame) -> DataFrame:
    """a, b, n: how often character b follows a; at most WIDTH squared rows."""
    at = F.sequence(F.lit(1), F.length("token") - 1)
    return tokens.where(F.length("token") >= 2).select(F.explode(F.transform(at, lambda i: F.substring("token", i, F.lit(2)))).alias("p")).groupBy("p").count()


def train(docs: DataFrame, sample_random: int = SAMPLE_RANDOM) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) for each pair of characters of ALPHABET, row by row."""
    spark = docs.sparkSession
    marked = F.concat_ws("|", F.lit(ASSIGN), F.lit(ACCESS), F.lit(HEX))
    clean = F.regexp_replace("text", marked, " ")
    ordinary = docs.select(F.explode(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9+/_=-]{5,}"), F.lit(0))).alias("token"))
    n = F.col("id").cast("string")
    random = spark.range(sample_random).select(F.explode(F.array(F.base64(F.unhex(F.sha2(n, 256))), F.translate(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("u")), 256))), "+/=", "-_"), F.md5(n))).alias("token"))
    found = [_pairs(tokens).collect() for tokens in (random, ordinary)]  # bounded by the square of the alphabet
    mass = [sum(r["count"] for r in pairs) for pairs in found]
    model = []
    for pairs, n in zip(found, mass):
        count = [[0.5] * WIDTH for _ in range(WIDTH)]
        for r in pairs:
            a, b = (ALPHABET.find(c) for c in r["p"])
            if a >= 0 and b >= 0:
                count[a][b] += r["count"] * min(1.0, mass[0] / n)
        model.append([[math.log(x / sum(row)) for x in row] for row in count])
    return [p - q for r, s in zip(*model) for p, q in zip(r, s)]


def ratio(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of the token's pairs of characters."""
    table = F.array(*[F.lit(x) for x in model])
    letters = F.lit(ALPHABET)
    at = lambda i: F.instr(letters, F.substring(token, i, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, at(i) * WIDTH + at(i + 1)))
    return total / (F.length(token) - 1)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sorted(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(order)


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each row of df."""
    docs = id_text(df, id_col, text_col)
    model = train(docs)
    text = F.col("text")
    assign, access, hexes = base_spans(text)
    found = docs.select("doc_id", "text", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), matches(text, TOKEN, "markov").alias("runs"))
    base = found.withColumn("base", F.concat("assign", "access", "hex"))

    def added(s):
        token = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return apart & (ratio(token, model) >= threshold)

    more = base.withColumn("markov", F.filter("runs", added))
    return more.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.size("markov").cast("long").alias("n_markov"),
        F.sha2(_said(_sorted(F.col("base"))), 256).alias("base_sha256"),
        _said(_sorted(F.concat("base", "markov"))).alias("spans"),
    )
