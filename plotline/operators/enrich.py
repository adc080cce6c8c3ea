"""Choosing what to have scored by an outside model, scoring it in two stages, and keeping account of the cost."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import price_drifted, token_cost
from ..functions.text import slug

MOST_ATTEMPTS = 3
RETRYABLE = "failed"


def location_matches(name: Column, code: Column, wanted: str) -> Column:
    return name.ilike(wanted) | (code == slug(F.lit(wanted)))


def retryable(status: Column, attempts: Column) -> Column:
    return F.coalesce((status == RETRYABLE) & (attempts < MOST_ATTEMPTS), F.lit(False))


def to_screen(ads: DataFrame, screenings: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Active adverts never screened, or under another prompt, or changed since, or failed and worth another try; new ones first."""
    s = screenings.select(F.col("ad_id").alias("id"), F.col("prompt_version").alias("_v"), F.col("ad_modified_at").alias("_m"), F.col("status").alias("_s"), F.col("attempts").alias("_n"), F.lit(True).alias("_known"))
    j = ads.where("status = 'active'").join(s, "id", "left")
    stale = F.col("_known").isNull() | (F.col("_v") != version) | ~F.col("_m").eqNullSafe(F.col("modified_at")) | retryable(F.col("_s"), F.col("_n"))
    found = j if force else j.where(stale)
    return found.orderBy(F.col("_known").isNull().desc(), F.col("created_at").desc(), F.col("id").desc()).select("id")


def to_evaluate(ads: DataFrame, evaluations: DataFrame, version: str, drift: float, screenings: DataFrame | None = None, force: bool = False) -> DataFrame:
    """As to_screen, of adverts that passed screening if screenings are given; a price that drifted since also counts."""
    e = evaluations.select(
        F.col("ad_id").alias("id"), F.col("prompt_version").alias("_v"), F.col("ad_modified_at").alias("_m"), F.col("status").alias("_s"), F.col("attempts").alias("_n"), F.col("price_at_evaluation").alias("_p"), F.lit(True).alias("_known")
    )
    active = ads.where("status = 'active'")
    if screenings is not None:
        active = active.join(screenings.where("status = 'passed'").select(F.col("ad_id").alias("id")), "id", "left_semi")
    j = active.join(e, "id", "left")
    moved = F.col("_p").isNull() | F.coalesce(F.abs(F.col("price") - F.col("_p")) > F.col("_p") * drift, F.lit(False))
    stale = F.col("_known").isNull() | (F.col("_v") != version) | ~F.col("_m").eqNullSafe(F.col("modified_at")) | retryable(F.col("_s"), F.col("_n")) | moved
    found = j if force else j.where(stale)
    return found.orderBy(F.col("_known").isNull().desc(), F.col("created_at").desc(), F.col("id").desc()).select("id")


def up_to_date(fingerprint: Column, done_fingerprint: Column, version: str, done_version: Column, status: Column, price: Column, done_price: Column, drift: float) -> Column:
    same = (fingerprint == done_fingerprint) & (done_version == version) & (status != "failed")
    return F.coalesce(same, F.lit(False)) & ~price_drifted(price, done_price, drift)


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost_usd; models are known by name, or by name without a date at its end. Unknown ones have no cost."""
    named = usage.withColumn("_short", F.regexp_replace("model", r"-\d{8}$", ""))
    p = prices.select(F.col("model").alias("_short"), "input_usd", "output_usd")
    cost = token_cost(F.col("input_usd"), F.col("output_usd"), F.col("input_tokens"), F.col("output_tokens"), F.coalesce("cache_read_tokens", F.lit(0)), F.coalesce("cache_write_tokens", F.lit(0)))
    return named.join(p, "_short", "left").withColumn("cost_usd", cost).drop("_short", "input_usd", "output_usd")


def scored(rows: DataFrame, scorer: Callable[[dict], dict], columns: str, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """ad_id, status, attempts, error and the scorer's columns of each row. A row that fails again and again is kept, marked failed.

    The scorer is any picklable function of a row's dict; it is called where the row is, batch by batch.
    """
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                got, error, n = {}, None, 0
                while n < attempts:
                    n += 1
                    try:
                        got, error = scorer(row), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever an outside scorer raises is a failed attempt
                        error = f"{type(e).__name__}: {e}"
                out.append({"ad_id": row["id"], "status": "ok" if error is None else "failed", "attempts": n, "error": error, **{c: got.get(c) for c in names}})
            yield pd.DataFrame(out, columns=["ad_id", "status", "attempts", "error", *names])

    return rows.mapInPandas(run, f"ad_id long, status string, attempts int, error string, {columns}")


def affordable(queue: DataFrame, order: list[Column], cost_each: float, budget: float, spent: float) -> DataFrame:
    """As many rows of the queue as the rest of the budget pays for."""
    return queue.orderBy(*order).limit(max(0, int((budget - spent) / cost_each)))


def two_stages(ads: DataFrame, screen: Callable[[dict], dict], evaluate: Callable[[dict], dict], columns: str) -> tuple[DataFrame, DataFrame]:
    """Screenings (passed, reason) of all ads, and evaluations of those that passed."""
    from ..session import written

    first = written(scored(ads, screen, "passed boolean, reason string").withColumn("status", F.when(F.col("status") == "failed", "failed").when(F.col("passed"), "passed").otherwise("rejected")), "screenings")
    rest = ads.join(first.where("status = 'passed'").select(F.col("ad_id").alias("id")), "id", "left_semi")
    return first, scored(rest, evaluate, columns)


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
