"""Keyed tables kept up to date by rewriting: plain Parquet has no MERGE, so a new version is the join of the old one with what is new."""

import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_masked
from ..session import tasks_for


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: list[str], fill: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """old with new's rows: of a key that both have, `replace` is new's, `fill` is new's unless null, `keep` is old's unless null. One full outer join."""
    columns = [*key, *replace, *fill, *keep]
    o = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in columns if c not in key), F.lit(True).alias("_old"))
    n = new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in columns if c not in key), F.lit(True).alias("_new"))
    j = o.join(n, key, "full")
    there = F.col("_new").isNotNull()
    out = {c: F.when(there, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")) for c in replace}
    out |= {c: F.coalesce(f"_n_{c}", f"_o_{c}") for c in fill} | {c: F.coalesce(f"_o_{c}", f"_n_{c}") for c in keep}
    return j.select(*key, *(out[c].alias(c) for c in columns if c not in key))


def backdated(units: DataFrame, earlier: DataFrame) -> DataFrame:
    """units with what an older list told of them (id, observed_at, price): it begins their history where it is older than that, and counts for their lowest and highest price."""
    e = earlier.groupBy("id").agg(F.min_by(F.struct("observed_at", "price"), F.struct("observed_at", "price")).alias("_e"))
    j = units.join(e, "id", "left")
    older = F.coalesce(F.col("_e.observed_at") < F.col("first_seen"), F.lit(False))
    told = {"first_seen": F.col("_e.observed_at"), "first_price": F.col("_e.price"), "lowest_price": F.least("lowest_price", "_e.price"), "highest_price": F.greatest("highest_price", "_e.price")}
    return j.withColumns({c: F.when(older, v).otherwise(F.col(c)) for c, v in told.items()}).drop("_e")


def restarted(units: DataFrame, prices: DataFrame, anew: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, prices) after units were renumbered (anew: id, observed_at, price): their history begins there, and the prices before it (unit_id) go."""
    a = anew.groupBy("id").agg(F.max_by(F.struct("observed_at", "price"), F.struct("observed_at", "price")).alias("_a"))
    j = units.join(a, "id", "left")
    told = {"first_seen": F.coalesce("_a.observed_at", "first_seen"), "first_price": F.when(F.col("_a").isNotNull(), F.col("_a.price")).otherwise(F.col("first_price"))}
    return j.withColumns(told).drop("_a"), without(prices, anew, "unit_id", "id")


def new_listings(stored: DataFrame, ads: DataFrame, raw: DataFrame, children: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """What a batch of adverts adds to each table: ads, raw payloads, a row for each child (by ad_id) and the first price observation.

    Of an advert stored already nothing is added; of one that a batch holds twice the row that was modified last. ads: id, price, area, status, modified_at.
    """
    fresh = ads.join(stored.select("id"), "id", "left_anti").groupBy("id").agg(F.max_by(F.struct(*(c for c in ads.columns if c != "id")), "modified_at").alias("_a")).select("id", "_a.*")
    ids = fresh.select(F.col("id").alias("ad_id"))
    out = {"ads": fresh, "raw": raw.join(ids, "ad_id", "left_semi")} | {name: child.join(ids, "ad_id", "left_semi").distinct() for name, child in children.items()}
    out["observations"] = fresh.where("price > 0").select(F.col("id").alias("ad_id"), now.alias("observed_at"), "price", "area", "status")
    return out


def publish(df: DataFrame, path: str, least: int = 0) -> str:
    """Writes df as a new version under path, which readers see once it is whole; earlier versions stay for those that read them. Returns its folder.

    df is computed once: its rows are counted as they are written, under a name that no reader takes. Fewer than `least` are refused.
    """
    at = time.time_ns()
    folder, pending = f"{path.rstrip('/')}/version={at:020d}", f"{path.rstrip('/')}/_pending-{at:020d}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(pending)
    jvm = df.sparkSession.sparkContext._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(pending), jvm.org.apache.hadoop.fs.Path(folder)
    fs = here.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if seen.get["n"] < least:
        fs.delete(here, True)
        raise ValueError(f"{seen.get['n']} rows, at least {least} are asked for")
    if not fs.rename(here, there):
        raise OSError(f"{pending} could not become {folder}")
    return folder


def published(spark: SparkSession, path: str, version: int = -1) -> DataFrame:
    """The newest whole version under path, or an earlier one (-2 the one before it)."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted(s.getPath().toString() for s in fs.listStatus(top) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(folders[version])


def rebuilt(df: DataFrame, path: str, columns: list[str]) -> str:
    """Publishes a table that is made anew as a whole. Other columns than those asked for, or an empty key (the first column), are refused, keys as they are written."""
    if df.columns != columns:
        raise ValueError(f"columns {df.columns} are not {columns}")
    key, missing = columns[0], f"rows without {columns[0]}"
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(missing)).cast(df.schema[key].dataType)).otherwise(F.col(key))
    try:
        return publish(df.withColumn(key, checked), path)
    except PySparkException as e:
        if missing in str(e):
            raise ValueError(missing) from e
        raise


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks, one of each."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def refreshed(old: DataFrame, new: DataFrame, key: str, texts: list[str], places: list[str], rest: list[str]) -> DataFrame:
    """As upsert: a masked text never takes a real one's place, and a known place is never wiped."""
    masked = new.select(key, *(F.when(~is_masked(F.col(c)), F.col(c)).alias(c) for c in texts), *places, *rest)
    return upsert(old, masked, [key], rest, [*texts, *places])


def outdated(ads: DataFrame, gone: DataFrame, key: str, now: Column) -> DataFrame:
    """ads with those of `gone` marked as outdated, seen now."""
    marked = ads.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    hit = F.coalesce("_gone", F.lit(False))
    return marked.withColumns({"status": F.when(hit, "outdated").otherwise(F.col("status")), "scraped_at": F.when(hit, now).otherwise(F.col("scraped_at"))}).drop("_gone")


def without(child: DataFrame, deleted: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The rows of a child table whose parent stays, dealt by the key over a number of tasks that grows with the table.

    Spark merges partitions by their compressed bytes, and keys in order compress so well that a few tasks would sort and group the whole table.
    """
    n = tasks_for(child)
    return child.repartition(n, key).join(deleted.select(F.col(parent_key).alias(key)).repartition(n, key), key, "left_anti")


def register_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sales by id: what is known stays but for price, area and the time of loading."""
    changing = [c for c in ("transaction_price", "unit_price", "area", "loaded_at") if c in old.columns]
    return upsert(old, new, ["id"], changing, keep=[c for c in old.columns if c not in ("id", *changing)])


def replace_all(df: DataFrame, path: str, what: str) -> str:
    """Publishes df in place of what is there (read with published); an empty table is refused, so neither a failed download nor a lost job wipes a good one."""
    try:
        return publish(df, path, 1)
    except ValueError as e:
        raise ValueError(f"no {what}: the previous ones are kept") from e


def same_area(a: Column, b: Column, ratio: float = 0.03) -> Column:
    return F.coalesce((a == 0) | (b == 0) | (F.abs(a - b) <= F.greatest(a, b) * ratio), F.lit(True))


def apply_snapshots(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and their price events from dated lists of one developer's units.

    snapshots: institution_id, unit_key, day, area, price, price_per_m2. A unit whose area changes was renumbered: its history begins
    anew. Windows are over a unit, so a developer of any size is dealt over tasks. Returns (units, price events).
    """
    w = Window.partitionBy("institution_id", "unit_key").orderBy("day")
    one = snapshots.groupBy("institution_id", "unit_key", "day").agg(F.min_by(F.struct("area", "price", "price_per_m2"), F.struct("area", "price", "price_per_m2")).alias("u")).select("institution_id", "unit_key", "day", "u.*")
    begun = one.withColumn("_before", F.lag("area").over(w)).withColumn("_new", (~same_area(F.col("_before"), F.col("area"))).cast("int"))
    runs = begun.withColumn("_run", F.sum("_new").over(w))
    last = F.max("_run").over(Window.partitionBy("institution_id", "unit_key"))
    current = runs.withColumn("_last", last).where("_run = _last")
    units = current.groupBy("institution_id", "unit_key").agg(
        F.max_by("area", "day").alias("area"),
        F.max_by("price", "day").alias("price"),
        F.min_by("price", "day").alias("first_price"),
        F.min("price").alias("lowest_price"),
        F.max("price").alias("highest_price"),
        F.min("day").alias("first_seen"),
        F.max("day").alias("last_seen"),
    )
    events = current.withColumn("_p", F.lag(F.struct("price", "price_per_m2")).over(w)).withColumn("_n", F.row_number().over(w))
    events = events.where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.struct("price", "price_per_m2"))).select("institution_id", "unit_key", F.col("day").alias("observed_at"), "price", "price_per_m2")
    return units, events


def ring_buffer(logs: DataFrame, service: str = "service", order: str = "id", most: int = 2000) -> DataFrame:
    """The newest rows of each service."""
    w = Window.partitionBy(service).orderBy(F.col(order).desc())
    return logs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def created_searches(saved: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saved (id, name, query) with new searches (name, query, and at, their order), and those refused: a name is taken once, by the first that asks for it."""
    w = Window.partitionBy("name").orderBy("at", "query")
    asked = new.join(saved.select("name", F.lit(True).alias("_taken")).distinct(), "name", "left").withColumn("_rank", F.row_number().over(w))
    ok = F.col("_taken").isNull() & (F.col("_rank") == 1)
    newest = saved.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_newest"))
    numbered = asked.where(ok).crossJoin(F.broadcast(newest)).withColumn("id", F.col("_newest") + F.row_number().over(Window.orderBy("at", "name")))  # new searches are few
    return saved.unionByName(numbered.select(*saved.columns)), asked.where(~ok).select(*new.columns)


def updated_searches(saved: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saved with changed names and queries (changes: id, name, query), and those refused with why: unknown ids, and names that another search has or asks for with a lower id."""
    told = changes.groupBy("id").agg(F.max(F.struct("name", "query")).alias("_c")).select("id", F.col("_c.name").alias("_name"), F.col("_c.query").alias("_query"))
    j = saved.join(told, "id", "full")
    first = told.groupBy("_name").agg(F.min("id").alias("_asks"))
    held = saved.select(F.col("name").alias("_name"), F.col("id").alias("_owner"))
    j = j.join(first, "_name", "left").join(held, "_name", "left")
    owner = F.coalesce("_owner", "_asks")
    why = F.when(F.col("name").isNull(), "unknown").when(owner != F.col("id"), "name is taken")
    j = j.withColumn("_why", F.when(F.col("_name").isNotNull(), why))
    take = F.col("_name").isNotNull() & F.col("_why").isNull()
    kept = j.where("name IS NOT NULL").select("id", F.when(take, F.col("_name")).otherwise(F.col("name")).alias("name"), F.when(take, F.col("_query")).otherwise(F.col("query")).alias("query"))
    return kept, j.where("_why IS NOT NULL").select("id", F.col("_name").alias("name"), F.col("_why").alias("why"))


def deleted_searches(saved: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saved without the ids, and those of them that are unknown."""
    return saved.join(ids.select("id").distinct(), "id", "left_anti"), ids.select("id").distinct().join(saved.select("id"), "id", "left_anti")


def enqueued(requests: DataFrame, ids: DataFrame, ads: DataFrame, now: Column) -> DataFrame:
    """requests with the ids that are adverts' pending: finished ones opened again, unknown ids ignored."""
    wanted = ids.select("ad_id").distinct().join(ads.select(F.col("id").alias("ad_id")), "ad_id", "left_semi")
    j = requests.join(wanted.withColumn("_asked", F.lit(True)), "ad_id", "full")
    again = F.col("_asked").isNotNull() & ~F.coalesce(F.col("status") == "pending", F.lit(False))
    return j.select(
        "ad_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, now).otherwise(F.col("requested_at")).alias("requested_at"), F.when(~again, F.col("finished_at")).alias("finished_at")
    )
