"""Texts that are alike by their trigrams, over a whole table: a similarity join that starts from the rarest trigrams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..session import once, spread, written


def similar_texts(df: DataFrame, key: str, text: str, least: float = 0.6) -> DataFrame:
    """a, b, similarity of the pairs of unlike texts with at least so large a share of common trigrams. A text is named by its least key, a < b.

    Trigrams are ordered from the rarest on. Texts as similar as asked share one of the first few of them, so only those meet, by trigram; what is left of
    both behind the shared one and their sizes have to allow the similarity too. Sets are joined to what is left and compared exactly.
    Texts that are null or hold no letter or digit pair with none. Copies of a text ask once.
    """
    c = F.col
    one = df.where(c(text).isNotNull()).groupBy(F.lower(text).alias("_text")).agg(F.min(key).alias("id"))
    sets = written(once(spread(one, "id"), grams=trigrams(c("_text"))).where(F.size("grams") > 0).select("id", "grams"), "trigrams")
    held = sets.select("id", F.explode("grams").alias("gram"))
    rare = held.groupBy("gram").agg(F.count("*").alias("n"))
    ordered = held.join(rare, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams")).withColumn("size", F.size("grams"))
    enough = F.ceil(c("size") * least - 1e-9).cast("int")  # a similar text shares as many
    prefix = ordered.select("id", "size", F.posexplode(F.slice("grams", F.lit(1), c("size") - enough + 1))).select("id", "size", "pos", c("col.gram").alias("gram"))
    a, b = prefix.withColumnsRenamed({"id": "a", "size": "a_size", "pos": "a_pos"}), prefix.withColumnsRenamed({"id": "b", "size": "b_size", "pos": "b_pos"})
    shared = F.ceil((c("a_size") + c("b_size")) * (least / (1 + least)) - 1e-9)
    behind = F.least(c("a_size") - c("a_pos"), c("b_size") - c("b_pos"))
    sizes = (c("a_size") >= c("b_size") * least - 1e-9) & (c("b_size") >= c("a_size") * least - 1e-9)
    # what comes before a first shared trigram is not shared; behind a later one the bound is only looser for a pair that its first has let through
    met = a.join(b, "gram").where((c("a") < c("b")) & sizes & (c("a_pos") + behind >= shared) & (c("b_pos") + behind >= shared)).select("a", "b").distinct()
    told = met.join(sets.select(c("id").alias("a"), c("grams").alias("a_grams")), "a").join(sets.select(c("id").alias("b"), c("grams").alias("b_grams")), "b")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    got = once(told, similarity=common / (F.size("a_grams") + F.size("b_grams") - common))
    return got.where(c("similarity") >= least - 1e-12).select("a", "b", "similarity")
