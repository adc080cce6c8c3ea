"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line is a duplicate if the same line, or one within `tau` edits, stands before it: in a document of lower id, or
higher in the same one. Duplicates are removed from their documents. Blank lines stay, and those of less than `least` characters
if more than one is asked for. All others are compared for exact copies, and those of 2 tau + 1 characters or more for edits too.

Unlike lines are cut into tau + 1 segments, one of which is whole in any line within tau edits. Segments are indexed under
the length of their line, their number and their hash; each line probes the lengths from its own down to tau less, at the places
where a segment can stand if the edits before it and behind it are tau at most. First it is told which keys unlike lines share; only the
lines that have one are marked, by the characters and by the words that they hold an odd number of, and only lines whose marks differ by no
more than tau edits explain meet. So of the unlike lines that share a segment, as copies of one text with other changes do, few are paired.
Pairs are verified, what they begin and end with in common taken off, by a banded bit-parallel edit distance: the band's columns are bits of one long,
and each character is one step. A first step over the start rejects most pairs that only share a segment.

Null texts have no lines and come back as null; empty texts as empty. Rows with a null id are compared as any others and
stand before all other rows. Rows that repeat an id are told apart by their text; rows that repeat both are one document and
lose the same lines. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stash

TAU, LEAST = 2, 1
HEAD = 32  # characters of the differing parts compared first
#: As many wanted lines are sent to every task to find their texts; more are joined.
SENT = 1_000_000
BITS = 31  # of the band; the highest is the row tau below the diagonal


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, line, n (characters), h1, h2 (hashes of the line) of docs (doc_id, text_hash, text)."""
    lines = docs.where("text IS NOT NULL").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("*", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(7)).alias("h2"))


def _odd(parts: Column, class_of) -> Column:
    """Which of 64 classes (the last six bits of class_of) an odd number of the parts falls into, as the bits of a long."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda held, part: held.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), class_of(part))))


def with_marks(lines: DataFrame) -> DataFrame:
    """lines with `letters` and `words`: the classes of which a line holds an odd number of characters and of words."""
    return lines.select("*", _odd(F.split("line", ""), F.ascii).alias("letters"), _odd(F.split("line", " ", -1), F.hash).alias("words"))


def may_be_near(a: str, b: str, less: Column, tau: int) -> Column:
    """Whether marks allow tau edits of lines of which one has `less` characters less.

    An edit takes or adds three words at most (a space that goes or comes). It takes or adds two characters, or one if it
    changes the length, as `less` of the edits have to.
    """
    unlike = lambda mark: F.bit_count(F.col(f"{mark}_{a}").bitwiseXOR(F.col(f"{mark}_{b}")))
    return (unlike("letters") + less <= 2 * tau) & (unlike("words") <= 3 * tau)


OWN = 1


def places(tau: int) -> list[tuple[int, int, int, int]]:
    """What a line is looked up by: (characters that the other has less, segment, shift, role) (multi-match-aware windows).

    The role is twice the characters, and OWN for a segment of the line itself.
    """
    out = []
    for d in range(tau + 1):
        for i in range(tau + 1):
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                out.append((d, i, shift, 2 * d + (OWN if d == shift == 0 else 0)))
    return out


def keyed(lines: DataFrame, tau: int) -> DataFrame:
    """h1, role, key: the segments of each line and the substrings that may be segments of others.

    Places are exploded before their keys are made, so that the code for a key is there once and stays small enough to be compiled.
    """
    spec = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(p, ("d", "i", "shift", "role")))) for p in places(tau)))
    at = lines.select("h1", "line", "n", F.explode(spec).alias("p"))
    m, i = F.col("n") - F.col("p.d"), F.col("p.i")
    # the last segments are longer by one
    size, short = F.floor(m / (tau + 1)).cast("int"), (tau + 1) - m % (tau + 1)
    start = size * i + F.greatest(i - short, F.lit(0)) + 1 + F.col("p.shift")
    held = F.substring("line", start, size + F.when(i >= short, 1).otherwise(0))
    return at.select("h1", F.col("p.role").alias("role"), F.xxhash64(m, i, held).alias("key"))


def meeting(lines: DataFrame, tau: int) -> DataFrame:
    """key, h1, role of the keys that unlike lines share, one of them as a segment of its own. Copies of a line are taken together where its keys arrive.

    Both sides of the join read one exchange. What is left is little, so only that is built into a hash table, and nothing is sorted.
    """
    keys = keyed(lines, tau).repartition(partitions(lines.sparkSession), "key")
    told = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.bit_or("role").alias("roles"))
    shared = told.where((F.col("low") < F.col("high")) & (F.col("roles").bitwiseAND(OWN) > 0)).select("key")
    return keys.join(shared.hint("shuffle_hash"), "key", "left_semi").groupBy("key", "h1").agg(F.bit_or("role").alias("role"))


def texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, line of the lines whose h1 is wanted, once each."""
    few = wanted.limit(SENT + 1).count() <= SENT
    return lines.select("h1", "h2", "line").join(F.broadcast(wanted) if few else wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))


def unlike_pairs(met: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """a, b: hashes of unlike lines that share a segment and whose marks allow tau edits. met: as meeting gives; texts: h1, line of all lines in met."""
    marks = with_marks(texts).groupBy("h1").agg(F.min("letters").alias("letters"), F.min("words").alias("words"))
    once = stash(met.join(marks, "h1"), "marked")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("h1", "letters", "words")]
    right = once.select("key", F.shiftright("role", 1).alias("less"), *side("a"))
    left = once.where(F.col("role").bitwiseAND(OWN) > 0).select(F.col("key").alias("segment"), *side("b"))
    # a pair of equal length is found from either side: one is enough
    other = F.when(F.col("less") == 0, F.col("h1_a") < F.col("h1_b")).otherwise(F.col("h1_a") != F.col("h1_b"))
    found = right.join(left, (F.col("key") == F.col("segment")) & other & may_be_near("a", "b", F.col("less"), tau))
    return found.select(F.least("h1_a", "h1_b").alias("a"), F.greatest("h1_a", "h1_b").alias("b")).distinct()


def candidates(lines: DataFrame, tau: int) -> DataFrame:
    """a, b: hashes of the lines that are verified."""
    met = stash(meeting(lines, tau), "meeting")
    return unlike_pairs(met, texts_of(lines, met.select("h1").distinct()), tau)


def _common(x: Column, y: Column) -> Column:
    """How many characters two arrays of characters begin with in common."""
    unlike = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
    return F.coalesce(F.nullif(unlike, F.lit(0).cast("bigint")) - 1, F.size(x)).cast("int")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that later filters do not compute again."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_s")).select(*rest, "_s.*")


def banded(a: Column, b: Column, tau: int) -> Column:
    """The edit distance of a and b if it is tau at most, else some number above tau.

    Bit r of a word stands for row j + tau - (BITS - 1 - r) of column j: the highest bit runs along the lower edge of the
    band; once that edge is past the last row, the bit of the last row moves down by one with each column.
    """
    full = F.lit((1 << BITS) - 1).cast("long")
    m, n = F.length(a), F.length(b)
    start = F.struct(F.lit(((1 << BITS) - 1) ^ ((1 << (BITS - 1 - tau)) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(tau)).alias("d"))

    def equal(x, y):
        """For each column, the bits of the band's rows whose character is the column's."""

        def column(c, j0):
            bits = F.lit(0).cast("long")
            for k in range(-tau, tau + 1):
                bits = bits + F.when(F.get(x, j0 + k) == c, F.lit(1 << (BITS - 1 - tau + k)).cast("long")).otherwise(F.lit(0).cast("long"))
            return F.struct(bits.alias("eq"), (j0 + 1).alias("j"))

        return F.transform(y, column)

    def step(acc, e):
        eq, vp, vn = e["eq"], acc["vp"], acc["vn"]
        beyond = e["j"] - (m - tau)  # columns since the lower edge left the last row behind
        bit = F.greatest(F.lit(BITS - 1) - F.greatest(beyond, F.lit(0)), F.lit(0))

        def next_words(d0):
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(full))
            return _let(F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(vp).alias("hn"), F.shiftright(d0, 1).alias("right")), last)

        def last(w):
            moved = F.when(beyond <= 0, 1 - F.getbit(w["d0"], bit)).otherwise(F.getbit(w["hp"], bit) - F.getbit(w["hn"], bit))
            return F.struct(
                w["hn"].bitwiseOR(F.bitwise_not(w["right"].bitwiseOR(w["hp"])).bitwiseAND(full)).alias("vp"),
                w["right"].bitwiseAND(w["hp"]).alias("vn"),
                (acc["d"] + moved).cast("int").alias("d"),
            )

        return _let(eq.bitwiseAND(vp).__add__(vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full), next_words)

    counted = _let(F.split(a, ""), lambda x: F.aggregate(equal(x, F.split(b, "")), start, step)["d"])
    return F.when(F.abs(m - n) > tau, tau + 1).when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(counted)


def verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """a1, a2, b1, b2: the hashes of lines within tau edits. texts: h1, h2, line of all lines in pairs."""
    met = pairs.join(texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("y")), "b"
    )
    met = met.where(F.abs(F.length("x") - F.length("y")) <= tau)
    met = _with(met, before=_common(F.split("x", ""), F.split("y", "")))
    met = _with(met, **{c: F.substring(c, F.col("before") + 1, F.length(c) - F.col("before")) for c in "xy"})
    met = _with(met, behind=_common(F.split(F.reverse("x"), ""), F.split(F.reverse("y"), "")))
    met = _with(met, **{c: F.substring(c, F.lit(1), F.length(c) - F.col("behind")) for c in "xy"})
    # tau edits leave starts of equal length within twice as many
    met = _with(met, head=banded(F.substring("x", 1, HEAD), F.substring("y", 1, HEAD), 2 * tau)).where(F.col("head") <= 2 * tau)
    met = _with(met, edits=banded(F.col("x"), F.col("y"), tau)).where(F.col("edits") <= tau)
    return met.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2")


def duplicate_lines(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, pos of the lines to remove, of docs (doc_id, text_hash, text)."""
    lines = lines_of(docs).where((F.col("n") >= least) & F.col("line").rlike(r"\S"))
    where = F.struct("doc_id", "text_hash", "pos")
    firsts = stash(lines.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("copies")), "firsts")
    edited = lines.where(F.col("n") >= 2 * tau + 1)
    met = stash(meeting(edited, tau), "meeting")
    texts = stash(texts_of(edited, met.select("h1").distinct()), "texts")
    pairs = stash(unlike_pairs(met, texts, tau), "pairs")
    near = verified(pairs, texts, tau)
    a = firsts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("first_a"))
    b = firsts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("first_b"))
    after = F.col("first_a") > F.col("first_b")
    later = near.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select(F.when(after, F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(after, F.col("a2")).otherwise(F.col("b2")).alias("h2"))
    gone = stash(later.distinct().withColumn("near", F.lit(True)), "near")
    discard(met, texts, pairs)
    marked = firsts.join(gone, ["h1", "h2"], "left").where("copies > 1 OR near")
    found = lines.select("h1", "h2", "doc_id", "text_hash", "pos").join(marked, ["h1", "h2"])
    return found.where(F.col("near").isNotNull() | ~where.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "pos").distinct()


def line_dedup(df: DataFrame, tau: int = TAU, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions from 0, ascending, comma-joined) and, if asked, kept_text; `keep` names further columns of df."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep).withColumn("text_hash", F.xxhash64("doc_id", "text"))
    gone = duplicate_lines(base.select("doc_id", "text_hash", "text"), tau, least)
    by_doc = gone.groupBy("text_hash", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    by_doc = by_doc.select("gone", F.col("text_hash").alias("th"), F.col("doc_id").alias("id"))
    split = F.split("text", "\n", -1)
    rows = base.select("doc_id", "text_hash", *(["text", *keep] if with_text else keep), F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"))
    out = rows.join(by_doc, (F.col("text_hash") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce("gone", none)
    columns = ["doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"), *keep]
    if with_text:
        ordered = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), removed)
        columns.append(F.when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(F.transform(ordered, lambda i: F.get(split, i)), "\n")).alias("kept_text"))
    return out.select(*columns)
