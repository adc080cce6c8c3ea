"""Price statistics, facets, shares and grids: grouped aggregates in one pass each."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..session import written

#: Rows of a group up to which its percentiles are taken in one task; larger groups are selected from over all tasks.
AT_ONCE = 5_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0


def selected_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """keys, n, q (an array, as shares): exact, interpolated percentiles of each group's values that are not null, by selection.

    A mergeable summary of each group gives pivots a little below and above every share. Counting what lies between pivots tells, whatever their
    error, in which interval each rank asked for lies; only those intervals' values are counted one by one and walked in their order. So a task
    holds summaries and sees a few ten-thousandths of a group, of any size. Keys may be null.
    """
    rows = written(df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "values")
    margin = 3 / accuracy
    points = sorted({p for q in shares for p in (max(0.0, q - margin), min(1.0, q + margin))})
    pivots = rows.groupBy(*keys).agg(F.approx_percentile("v", F.array(*map(F.lit, points)), F.lit(accuracy)).alias("pivots"))

    def joined(a: DataFrame, b: DataFrame, extra: list[str] = ()) -> DataFrame:
        """On keys, null ones alike."""
        other = b.select(*(F.col(k).alias(f"_{k}") for k in (*keys, *extra)), *(c for c in b.columns if c not in (*keys, *extra)))
        met = F.lit(True)
        for k in (*keys, *extra):
            met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return a.join(other, met).drop(*(f"_{k}" for k in (*keys, *extra)))

    above = sum(((F.col("v") > F.col("pivots")[i]).cast("int") for i in range(len(points))), F.lit(0))
    placed = joined(rows, pivots).select(*keys, above.alias("part"), "v")
    group = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "part").agg(F.count("*").alias("here")).withColumns({"n": F.sum("here").over(group), "up_to": F.sum("here").over(group.orderBy("part"))})
    at = [(F.col("n") - 1) * q for q in shares]
    ranks = F.array_distinct(F.array(*(side(x).cast("long") for x in at for side in (F.floor, F.ceil))))
    wanted = parts.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("up_to") - F.col("here")) & (r < F.col("up_to")))).where(F.size("ranks") > 0).select(*keys, "part", "n", (F.col("up_to") - F.col("here")).alias("before"), "ranks")
    held = joined(placed, wanted, ["part"]).groupBy(*keys, "part", "n", "before", "ranks", "v").agg(F.count("*").alias("same"))
    so_far = F.col("before") + F.sum("same").over(Window.partitionBy(*keys, "part").orderBy("v"))
    told = held.withColumn("up_to", so_far).select(*keys, "n", "v", F.explode(F.filter("ranks", lambda r: (r >= F.col("up_to") - F.col("same")) & (r < F.col("up_to")))).alias("r"))
    one = told.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))

    def between(q: float) -> Column:
        x = (F.col("n") - 1) * q
        low, high = (F.element_at("at", side(x).cast("long")) for side in (F.floor, F.ceil))
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return one.select(*keys, "n", F.array(*map(between, shares)).alias("q"))


def _selected(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """keys, n, and each measure's array of percentiles (null for groups without a value)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    for name, (value, shares) in measures.items():
        got = selected_percentiles(df, keys, value, shares).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("q").alias(name))
        met = F.lit(True)
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(got, met, "left").drop(*(f"_{k}" for k in keys))
    return out


def price_stats(df: DataFrame, fine: list[str], coarse: list[str], price: str, area: str | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Count, quartiles and medians by the fine keys and by the coarse ones (a part of them), in one pass over grouping sets.

    is_coarse tells the levels apart; keys that a level does not have are null. Exact, interpolated percentiles, of groups of more than `at_once` rows by selection.
    """
    gone = [k for k in fine if k not in coarse]
    if largest_group(df, coarse) > at_once:
        level = lambda keys, is_coarse: F.struct(*((F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in fine), F.lit(is_coarse).alias("is_coarse"))
        both = df.select(F.explode(F.array(level(fine, 0), level(coarse, 1))).alias("_k"), F.col(price).alias("_price"), *([F.col(area).alias("_area")] if area else [])).select("_k.*", "_price", *(["_area"] if area else []))
        got = _selected(both, [*fine, "is_coarse"], {"q": ("_price", [0.25, 0.5, 0.75])} | ({"a": ("_area", [0.5])} if area else {}))
        return got.select(*fine, "is_coarse", "n", F.col("q")[0].alias("p25_price"), F.col("q")[1].alias("median_price"), F.col("q")[2].alias("p75_price"), *([F.col("a")[0].alias("median_area")] if area else []))
    quartiles = F.percentile(price, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [F.count("*").alias("n"), quartiles.alias("q")] + ([F.percentile(area, 0.5).alias("median_area")] if area else [])
    grouped = df.groupingSets([[F.col(k) for k in fine], [F.col(k) for k in coarse]], *[F.col(k) for k in fine]).agg(F.grouping(gone[0]).cast("int").alias("is_coarse"), *aggs)
    return grouped.select(
        *fine, "is_coarse", "n", F.col("q")[0].alias("p25_price"), F.col("q")[1].alias("median_price"), F.col("q")[2].alias("p75_price"), *(["median_area"] if area else [])
    )


def district_stats(df: DataFrame, keys: list[str], price: str, score: str, least: int, at_once: int = AT_ONCE) -> DataFrame:
    """Five percentiles of a price and the mean of a score, of groups with at least so many rows."""
    shares = [0.1, 0.25, 0.5, 0.75, 0.9]
    if largest_group(df, keys) > at_once:
        means = df.groupBy(*keys).agg(F.avg(score).alias("mean_score")).select(F.struct(*keys).alias("_k"), "mean_score")
        got = _selected(df, keys, {"p": (price, shares)}).join(means, F.struct(*keys).eqNullSafe(F.col("_k"))).where(F.col("n") >= least)
    else:
        p = F.percentile(price, F.array(*map(F.lit, shares)))
        got = df.groupBy(*keys).agg(F.count("*").alias("n"), p.alias("p"), F.avg(score).alias("mean_score")).where(F.col("n") >= least)
    return got.select(*keys, "n", *(F.col("p")[i].alias(name) for i, name in enumerate(("p10", "p25", "p50", "p75", "p90"))), "mean_score")


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n of each of the columns' values, from one scan."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def relabelled_facet(values: DataFrame, value: str, synonyms: dict[str, tuple[str, ...]] = labels.SYNONYMS, most: int = 200) -> DataFrame:
    """label, n: values counted, then of those with one label the largest count, not their sum, as one listing may have several."""
    counted = values.groupBy(value).agg(F.count("*").alias("n"))
    named = counted.groupBy(labels.label(F.col(value), synonyms).alias("label")).agg(F.max("n").alias("n"))
    return named.orderBy(F.col("n").desc(), "label").limit(most)


def cube_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """n by every combination of keys and their totals; level tells by its bits which keys are totals."""
    return df.cube(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, min, max of each column, from one scan."""
    one = df.agg(*(f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max")) for c in columns))))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """n and its share of all rows; the window is over the groups, not the rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def grid(df: DataFrame, lat: str, lon: str, price: str, digits: int, least: int) -> DataFrame:
    """Mean price on a grid of rounded positions with at least so many rows."""
    return df.groupBy(F.round(lat, digits).alias("lat"), F.round(lon, digits).alias("lon")).agg(F.count("*").alias("n"), F.avg(price).alias("mean_price")).where(F.col("n") >= least)


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """bucket (0 below the first bound), n, least value; in the order of the values."""
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col(value) >= b).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least")).orderBy("least")


def null_safe_lookup(df: DataFrame, stats: DataFrame, fine: list[str], coarse: list[str], value: str, least: int = 8) -> DataFrame:
    """df with `value` of the fine level's statistics, else of the coarse one's, where null keys equal each other.

    stats: as price_stats gives; levels with fewer rows than `least` count as missing.
    """
    good = stats.where(F.col("n") >= least)

    def level(name: str, keys: list[str], coarse_level: int) -> DataFrame:
        return good.where(F.col("is_coarse") == coarse_level).select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.col(value).alias(f"_{name}"))

    out = df
    for name, keys, is_coarse in (("fine", fine, 0), ("coarse", coarse, 1)):
        met = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"_{name}_{k}"))
            met = same if met is None else met & same
        out = out.join(level(name, keys, is_coarse), met, "left").drop(*(f"_{name}_{k}" for k in keys))
    return out.withColumn(value, F.coalesce("_fine", "_coarse")).withColumn("level", F.when(F.col("_fine").isNotNull(), "fine").when(F.col("_coarse").isNotNull(), "coarse")).drop("_fine", "_coarse")


def relational_division(df: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys that have all of the wanted values."""
    need = len(set(wanted))
    return df.where(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == need).select(key)


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """df with how many rows share its key; rows with a null key drop out."""
    return df.where(F.col(key).isNotNull()).withColumn("multiplicity", F.count("*").over(Window.partitionBy(key)))


def distinct_counts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def collected(df: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """The sorted distinct values of each key with at least so many of them. Made distinct before they meet, so copies aren't shuffled into one task."""
    return df.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values")).where(F.size("values") >= least)


def union_view(df: DataFrame, key: str, groups: dict[str, str | Column]) -> DataFrame:
    """key, group, value: several columns, or arrays, as one narrow view from one scan; duplicates stay."""

    def items(name: str, c: str | Column) -> Column:
        column = F.col(c) if isinstance(c, str) else c
        array = column if isinstance(c, str) and df.schema[c].dataType.typeName() == "array" else F.array(column)
        return F.transform(array, lambda v: F.struct(F.lit(name).alias("group"), v.cast("string").alias("value")))

    every = F.flatten(F.array(*(items(n, c) for n, c in groups.items())))
    return df.select(key, F.explode(every).alias("g")).select(key, "g.group", "g.value").where("value IS NOT NULL")


def value_score(features: Column, price_per_m2: Column) -> Column:
    """Features a thousand per price of a square metre; null for no price."""
    return F.try_divide(features * 1000, F.nullif(price_per_m2, F.lit(0)))


def bounds(df: DataFrame, lat: str, lon: str, margin: float) -> DataFrame:
    """south, west, north, east of all positions, widened by a margin."""
    return df.agg((F.min(lat) - margin).alias("south"), (F.min(lon) - margin).alias("west"), (F.max(lat) + margin).alias("north"), (F.max(lon) + margin).alias("east"))


def best_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
