"""Histories: changes, states and the latest rows of keyed event tables. Windows are over a key, never over a whole table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(df: DataFrame, key: str, at: list[str], state: list[str], price: str | None = None) -> DataFrame:
    """The rows whose state differs, nulls included, from that of the key's row before; rows without a price are left out first."""
    df = df.where(F.col(price) > 0) if price else df
    w = Window.partitionBy(key).orderBy(*at)
    now = F.struct(*state)
    return df.withColumn("_before", F.lag(now).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_before").eqNullSafe(now)).drop("_before", "_first")


def observations_with_baseline(updates: DataFrame, known: DataFrame) -> DataFrame:
    """New observations: of each update that changes price, area or status, and before the first of an advert's the state it changed from.

    updates: ad_id, observed_at, price, area, status, and before_* of the last three and before_at. known: ad_ids that have observations.
    """
    state, before = F.struct("price", "area", "status"), F.struct(*(F.col(f"before_{c}").alias(c) for c in ("price", "area", "status")))
    new = F.col("before_at").isNull()
    changed = updates.where((F.col("price") > 0) & (new | ~state.eqNullSafe(before)))
    first = changed.where(~new & (F.col("before_price") > 0)).join(known.select("ad_id").distinct(), "ad_id", "left_anti")
    base = first.groupBy("ad_id").agg(F.min_by(F.struct(F.col("before_at").alias("observed_at"), F.col("before_price").alias("price"), F.col("before_area").alias("area"), F.col("before_status").alias("status")), "observed_at").alias("b"))
    return changed.select("ad_id", "observed_at", "price", "area", "status").unionByName(base.select("ad_id", "b.*"))


def backfilled(ads: DataFrame, observations: DataFrame) -> DataFrame:
    """An observation for each advert with a price that has none."""
    seen = F.coalesce("scraped_at", "modified_at").alias("observed_at")
    return ads.where("price > 0").join(observations.select(F.col("ad_id").alias("id")), "id", "left_anti").select(F.col("id").alias("ad_id"), seen, "price", "area", "status")


def running(df: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """df with the first, lowest and highest value so far."""
    w = Window.partitionBy(key).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"first_so_far": F.first(value).over(w), "lowest_so_far": F.min(value).over(w), "highest_so_far": F.max(value).over(w)})


def last_state(events: DataFrame, key: str, at: list[str], state: list[str]) -> DataFrame:
    """For each key the last known value of each column, and of the first row the time. One aggregate, no sort."""
    order = F.struct(*at)
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in state]
    return events.groupBy(key).agg(F.min(at[0]).alias("created_at"), F.max(at[0]).alias("updated_at"), *kept)


def checked_events(events: DataFrame) -> DataFrame:
    """Tracking events (ad_id, at, id, status, comment, viewing_at, ...) with `error`: why one is refused, null if it is not."""
    comment = F.nullif(F.trim("comment"), F.lit(""))
    w = Window.partitionBy("ad_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("status").isNotNull().cast("int")).over(w), F.lit(0))
    return events.withColumn("comment", comment).withColumn(
        "error",
        F.when(F.col("status").isNull() & comment.isNull(), "status or comment needed")
        .when(F.col("status").isNull() & (seen == 0), "first event needs a status")
        .when((F.col("status") == "viewing_scheduled") & F.col("viewing_at").isNull(), "viewing needs a time"),
    )


def newest(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each key, the first in the order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def trailing_sum(df: DataFrame, key: str, at: str, value: str, hours: int, parts: int = 24) -> DataFrame:
    """df with the sum of a key's values over the hours up to each row.

    Time is cut into buckets, `parts` to the hours. A row's window is whole buckets and two open ends: what its own bucket holds up to it, and what
    the bucket in which the window begins holds from there on. Ends are sums within one bucket, so a key with all rows is dealt over as many
    tasks as it has buckets; only the buckets' totals, one row each, go through a window over the key.
    """
    c, width = F.col, hours * 3_600_000_000 // parts
    micros = F.unix_micros(c(at).cast("timestamp"))
    rows = df.withColumns({"_t": micros, "_b": F.floor(micros / width)})
    # in its own bucket: all up to the row's time; in the window's first bucket, `parts` before: all that is not older than the window
    own = rows.select("*", F.lit(1).alias("_row"))
    mark = rows.select(c(key), (c("_t") - parts * width).alias("_t"), (c("_b") - parts).alias("_b"), F.lit(0).alias("_row")).distinct()
    by = Window.partitionBy(key, "_b")
    both = own.unionByName(mark, allowMissingColumns=True).withColumns({"_up_to": F.sum(value).over(by.orderBy("_t")), "_from": F.sum(value).over(by.orderBy(c("_t").desc()))})
    totals = rows.groupBy(key, "_b").agg(F.sum(value).alias("_all"))
    span = Window.partitionBy(key).orderBy("_b").rangeBetween(-(parts - 1), -1)
    between = totals.select(key, "_b", F.sum("_all").over(span).alias("_between"))
    tails = both.where("_row = 0").select(c(key).alias("_k"), (c("_t") + parts * width).alias("_at"), (c("_b") + parts).alias("_to"), c("_from").alias("_tail"))
    now = both.where("_row = 1").join(between.withColumnsRenamed({key: "_k2", "_b": "_b2"}), c(key).eqNullSafe(c("_k2")) & c("_b").eqNullSafe(c("_b2")))
    met = now.join(tails, c(key).eqNullSafe(c("_k")) & c("_b").eqNullSafe(c("_to")) & c("_t").eqNullSafe(c("_at")))
    some = c("_up_to").isNotNull() | c("_between").isNotNull() | c("_tail").isNotNull()
    total = sum((F.coalesce(x, F.lit(0)) for x in ("_between", "_tail")), F.coalesce("_up_to", F.lit(0)))
    return met.select(*df.columns, F.when(c("_t").isNull(), c("_up_to")).when(some, total).alias("trailing_sum"))  # rows without a time count together


def spent_since(df: DataFrame, at: str, cost: str, since: Column) -> DataFrame:
    return df.where(F.col(at) >= since).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("spent"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, take: list[str]) -> DataFrame:
    """left with the columns of right's latest row before it. Both sides go through one window, so no pairs are made."""
    marked = left.select("*", F.lit(None).cast(right.select(F.struct(at, *take)).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    other = right.select(key, at, F.struct(at, *take).alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.unionByName(other, allowMissingColumns=True).withColumn("_last", F.last("_r", True).over(w)).where("_side = 1")
    return both.select(*left.columns, *(F.col(f"_last.{c}").alias(f"previous_{c}") for c in take))


def heartbeats(beats: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """service, status, updated_at, liveness of the last beat of each service."""
    from ..functions.rules import liveness

    last = beats.groupBy("service").agg(F.max_by("status", "updated_at").alias("status"), F.max("updated_at").alias("updated_at"))
    return last.withColumn("liveness", liveness(F.col("updated_at"), now, seconds))
