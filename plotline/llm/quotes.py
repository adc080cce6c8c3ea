"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of `>` marks before it (spaces between them do not count). Neighbouring lines of one level
form a passage. Passages are normalised (lower case, runs of white space to one space, trimmed) and hashed.
A quoted passage is linked to the message that has it as its own (level 0) passage, whole text, paragraph, line or lines that follow each
other (blank ones aside): the latest earlier turn of the same conversation, else the first message of any other conversation. The message it replies to is the latest
earlier turn linked; messages of a conversation are ordered by thread (the first turn reached through such links), then
turn, and keep only the lines that are not quoted.

Null texts are empty; rows with a null conversation or turn are kept, without links, as their own thread. Of rows
that repeat a conversation and turn the texts are all kept, each as a row; their passages are linked alike. Quotes
without any letter or digit link nothing. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _key(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit(7)).alias("h2")]


def _lines(rows: DataFrame) -> DataFrame:
    """A row for each line: mid, conv_id, turn, n, level, line."""
    e = rows.select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "raw"))
    return e.select("mid", "conv_id", "turn", "n", F.length(F.regexp_replace(F.regexp_extract("raw", MARKS, 1), "[ \t]", "")).alias("level"), F.regexp_replace("raw", MARKS, "").alias("line"))


def _filled(lines: Column) -> Column:
    """The lines that are not blank, normalised; joined by spaces they are what their text is normalised to."""
    return F.filter(F.transform(lines, _norm), lambda x: x != "")


def _joined(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), "\n")


def passages(lines: DataFrame) -> DataFrame:
    """mid, conv_id, turn, level, first (line number), text. A window holds the lines of one message."""
    w = Window.partitionBy("mid").orderBy("n")
    new = F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(1))
    run = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return run.groupBy("mid", "conv_id", "turn", "run", "level").agg(F.min("n").alias("first"), _joined("line").alias("text"))


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, thread_turn, reply_conv, reply_turn, n_quotes, n_linked, own_text for each row."""
    base = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # rows that are alike in all columns are one message, told apart again at the end
    rows = base.withColumn("mid", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256))
    marked = rows.where(F.col("text").rlike(r"(?m)^[ \t]*>")).dropDuplicates(["mid"])
    quoted_lines = stash(_lines(marked), "quoted")
    quotes = (
        passages(quoted_lines)
        .where("level > 0")
        .select("mid", "conv_id", "turn", "level", "first", _norm(F.col("text")).alias("norm"), _filled(F.split("text", "\n", -1)).alias("filled"))
        .where(F.col("norm").rlike(r"[\p{L}\p{N}]"))
        .select("mid", "conv_id", "turn", "level", "first", *_key(F.col("norm")), F.xxhash64(F.col("filled")[0]).alias("head"), F.size("filled").alias("many"))
    )
    wanted = stash(quotes, "quotes")

    # own passages: of marked messages their level-0 runs, of all messages the whole own text, each paragraph and each own line
    own = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    plain = F.concat_ws("\n", F.filter(F.split("text", "\r?\n", -1), lambda x: ~x.rlike(MARKS)))
    units = own.select("conv_id", "turn", F.explode(F.array_union(F.array_union(F.array(plain), F.split(plain, r"\n\s*\n", -1)), F.split(plain, "\n", -1))).alias("unit")).unionByName(
        passages(quoted_lines.where("conv_id IS NOT NULL AND turn IS NOT NULL")).where("level = 0").select("conv_id", "turn", F.col("text").alias("unit"))
    )
    # and as many lines from a line on as a quote has that begins with it: places first, so no text is moved with each line
    filled = _filled(F.split(plain, "\n", -1))
    heads = wanted.where("many > 1").select("head", "many").distinct()
    starts = own.select("mid", F.posexplode(filled).alias("at", "line")).select("mid", "at", F.xxhash64("line").alias("head")).join(heads, "head")
    starts = starts.groupBy("mid").agg(F.collect_set(F.struct("at", "many")).alias("starts"))
    held = own.join(starts, "mid").select("conv_id", "turn", filled.alias("filled"), F.explode("starts").alias("s")).where(F.col("s.at") + F.col("s.many") <= F.size("filled"))
    units = units.unionByName(held.select("conv_id", "turn", F.array_join(F.slice("filled", F.col("s.at") + 1, F.col("s.many")), " ").alias("unit")))
    keyed = units.select("conv_id", "turn", _norm(F.col("unit")).alias("norm")).select("conv_id", "turn", *_key(F.col("norm")))
    sources = stash(keyed.join(wanted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").distinct(), "sources")

    # the latest earlier turn of the same conversation: quotes and sources in one order, not joined pair by pair
    near = wanted.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "h1", "h2", F.col("turn").alias("at"), F.lit(1).alias("kind"), "mid", "level", "first")
    both = near.unionByName(sources.select("conv_id", "turn", "h1", "h2", F.col("turn").alias("at"), F.lit(0).alias("kind")), allowMissingColumns=True)
    w = Window.partitionBy("conv_id", "h1", "h2").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("src", F.max(F.when(F.col("kind") == 0, F.col("turn"))).over(w)).where("kind = 1 AND src IS NOT NULL").select("mid", "first", F.col("conv_id").alias("src_conv"), F.col("src").alias("src_turn"))
    least = sources.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn")).alias("a"))
    second = sources.join(least, ["h1", "h2"]).where("conv_id <> a.conv_id").groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn")).alias("b"))
    one = least.join(second, ["h1", "h2"], "left")
    away = (
        wanted.join(here.select("mid", "first"), ["mid", "first"], "left_anti")
        .join(one, ["h1", "h2"])
        .withColumn("src", F.when(F.col("a.conv_id").eqNullSafe(F.col("conv_id")), F.col("b")).otherwise(F.col("a")))
        .where("src IS NOT NULL")
        .select("mid", "first", F.col("src.conv_id").alias("src_conv"), F.col("src.turn").alias("src_turn"))
    )
    links = here.withColumn("near", F.lit(True)).unionByName(away.withColumn("near", F.lit(False)))
    replies = (
        wanted.join(links, ["mid", "first"], "left")
        .groupBy("mid", "conv_id", "turn")
        .agg(
            F.count("*").alias("n_quotes"),
            F.count("src_turn").alias("n_linked"),
            F.max(F.when(F.col("near"), F.col("src_turn"))).alias("near_turn"),
            F.min(F.when(~F.col("near"), F.struct("src_conv", "src_turn"))).alias("far"),
        )
        .withColumn("reply_conv", F.when(F.col("near_turn").isNotNull(), F.col("conv_id")).otherwise(F.col("far.src_conv")))
        .withColumn("reply_turn", F.coalesce("near_turn", "far.src_turn"))
    )
    replies = stash(replies.drop("far"), "replies")

    # threads: pointer doubling over the messages that reply within their conversation, so rounds grow with the log of the depth
    up = stash(replies.where("near_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("near_turn").alias("root")), "roots")
    while True:
        nxt = up.join(up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further")), ["conv_id", "root"], "left")
        if nxt.where("further IS NOT NULL").isEmpty():
            break
        up = stash(nxt.select("conv_id", "turn", F.coalesce("further", "root").alias("root")), "roots")

    out = rows.join(replies.select("mid", "reply_conv", "reply_turn", "n_quotes", "n_linked"), "mid", "left").join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("root", "turn").alias("thread_turn"),
        "reply_conv",
        "reply_turn",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        plain.alias("own_text"),
    )


def ordered(linked: DataFrame) -> DataFrame:
    """Messages in reply order: by conversation, thread, turn."""
    return linked.orderBy("conv_id", "thread_turn", "turn")
