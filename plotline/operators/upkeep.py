"""Which stored adverts to look at again, which can be checked against maps, what scoring has cost, and what services logged."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import normalize_name, slug
from .spatial import containing, within_area

#: How near a street's box has to be, in degrees, and the order of log levels.
STREET_BOX = 0.003
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def parsed_shard(said: str | None) -> tuple[int, int] | None:
    """'1/4' as (1, 4): the first of four."""
    if said is None:
        return None
    parts = said.split("/")
    if len(parts) != 2 or not all(p.isdigit() for p in parts) or not 1 <= int(parts[0]) <= int(parts[1]):
        raise ValueError(f"a shard looks like 1/2, with the first number from 1 to the second: {said}")
    return int(parts[0]), int(parts[1])


def in_shard(id_: Column, shard: tuple[int, int]) -> Column:
    return id_ % shard[1] == shard[0] - 1


def within_city(ads: DataFrame, areas: DataFrame, cities: DataFrame, city: str, radius_km: float) -> DataFrame:
    """The ids of adverts in a city or within so many kilometres of its border.

    areas: level, city_name, sides. A city is told by its name, or by the name's slug as its code (cities: code, name). Of areas of one name the first counts.
    """
    coded = cities.where(F.col("code") == slug(F.lit(city))).select(F.lower("name").alias("_n")).orderBy("_n").limit(1)
    named = areas.where("level = 'city'").withColumn("_n", F.lower("city_name"))
    found = named.where(F.col("_n") == city.lower()).unionByName(named.join(coded, "_n", "left_semi").where(F.col("_n") != city.lower()))
    one = found.orderBy(F.col("_n") != city.lower(), "_n").limit(1)
    return within_area(ads, one, radius_km * 1000, "id")


def update_queue(
    ads: DataFrame,
    now: Column,
    city: str | None = None,
    around: DataFrame | None = None,
    least: float | None = None,
    most: float | None = None,
    days: int | None = None,
    shard: tuple[int, int] | None = None,
    without_place: bool = False,
) -> DataFrame:
    """The ids of active adverts to look at again, in order: those not looked at for so many days, the stalest first.

    Of a city its own adverts, those of no known city, and those of `around` (id, as within_city gives). For repairs (`without_place`) all without
    a city, whenever they were looked at, the newest look first. ads: id, status, city_id, city_name, price, scraped_at.
    """
    c = F.col
    found = ads.where("status = 'active'")
    if shard:
        found = found.where(in_shard(c("id"), shard))
    if least is not None:
        found = found.where(c("price") >= least)
    if most is not None:
        found = found.where(c("price") <= most)
    if without_place:
        return found.where("city_id IS NULL").orderBy(c("scraped_at").desc_nulls_last(), "id").select("id")
    if city:
        here = c("city_name").ilike(city) | c("city_id").isNull()
        if around is None:
            found = found.where(here)
        else:
            found = found.join(around.select("id", F.lit(True).alias("_around")), "id", "left").where(F.coalesce(here, F.lit(False)) | c("_around"))
    if days:
        found = found.where(c("scraped_at").isNull() | (c("scraped_at") < now - F.expr(f"INTERVAL {days} DAYS")))
    return found.orderBy(c("scraped_at").asc_nulls_last(), "id").select("id")


def street_candidates(ads: DataFrame, streets: DataFrame, towns: DataFrame) -> DataFrame:
    """The ids of adverts with a street whose pin lies in a town (sides) and near the box around any street (points): those a street can be checked for."""
    pinned = ads.where(F.col("street").isNotNull() & geo.has_position(F.col("latitude"), F.col("longitude"))).select("id", "latitude", "longitude")
    of = lambda c, f: f(F.transform("points", lambda p: p[c]))
    box = streets.select(of("lat", F.array_min).alias("s"), of("lat", F.array_max).alias("n"), of("lon", F.array_min).alias("w"), of("lon", F.array_max).alias("e"))
    size = STREET_BOX * 4
    cells = lambda low, high: F.sequence(geo.cell(F.col(low) - STREET_BOX, size), geo.cell(F.col(high) + STREET_BOX, size))
    dealt = box.withColumn("y", F.explode(cells("s", "n"))).withColumn("x", F.explode(cells("w", "e")))
    at = pinned.withColumns({"py": geo.cell(F.col("latitude"), size), "px": geo.cell(F.col("longitude"), size)})
    close = F.col("latitude").between(F.col("s") - STREET_BOX, F.col("n") + STREET_BOX) & F.col("longitude").between(F.col("w") - STREET_BOX, F.col("e") + STREET_BOX)
    near = at.join(dealt, (F.col("y") == F.col("py")) & (F.col("x") == F.col("px")) & close, "left_semi").select("id", "latitude", "longitude")
    return containing(near, towns.select(F.lit(True).alias("_in"), "sides"), "id", ["_in"]).select("id")


def pending(requests: DataFrame, most: int = 10) -> DataFrame:
    """The ids whose requests wait longest, in order. A page of so many rows."""
    return requests.where("status = 'pending'").orderBy(F.col("requested_at").asc_nulls_first(), "ad_id").limit(most).select("ad_id", "requested_at")


def newest(df: DataFrame, **columns: str) -> DataFrame:
    """One row: the largest value of each column, under a name of its own; null for an empty table."""
    return df.agg(*(F.max(c).alias(name) for name, c in columns.items()))


def requested_spending(requests: DataFrame, screenings: DataFrame, evaluations: DataFrame, since: Column) -> DataFrame:
    """cost_usd: what was spent since then on adverts whose request was finished since then."""
    asked = requests.where(F.col("finished_at") >= since).select("ad_id")
    spent = [df.where(F.col(at) >= since).select("ad_id", "cost_usd") for df, at in ((screenings, "screened_at"), (evaluations, "evaluated_at"))]
    return spent[0].unionByName(spent[1]).join(asked, "ad_id").agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def score_summary(evaluations: DataFrame) -> DataFrame:
    """n, cost_usd and mean_score of what was scored well."""
    return evaluations.where("status = 'ok'").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"), F.avg("overall_score").alias("mean_score"))


def score_distribution(evaluations: DataFrame) -> DataFrame:
    return evaluations.where("status = 'ok'").groupBy("overall_score").agg(F.count("*").alias("n")).orderBy("overall_score")


def rejection_reasons(screenings: DataFrame) -> DataFrame:
    return screenings.where("status = 'rejected'").groupBy("rejection_reason").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rejection_reason")


def by_rooms(ads: DataFrame) -> DataFrame:
    """rooms, n and means of price, price_per_m2 and area of active adverts."""
    return ads.where("status = 'active' AND rooms IS NOT NULL").groupBy("rooms").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in ("price", "price_per_m2", "area")))


def most_frequent(ads: DataFrame, value: str, most: int = 10) -> DataFrame:
    """value, n: what active adverts have most often, as features or districts. A report of so many rows."""
    return ads.where((F.col("status") == "active") & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(most)


def levels_from(least: str) -> list[str]:
    """A log level and those above it; all for an unknown one."""
    return list(LEVELS[LEVELS.index(least.upper()) :] if least.upper() in LEVELS else LEVELS)


def log_lines(logs: DataFrame, service: str, least: str | None = None, text: str | None = None, most: int = 500) -> DataFrame:
    """The newest lines of a service, oldest first, of a level or above, that hold a text (with LIKE's wildcards). A page of so many rows."""
    found = logs.where(F.col("service") == service)
    if least:
        found = found.where(F.col("level").isin(levels_from(least)))
    if text:
        found = found.where(F.col("message").ilike(f"%{text}%"))
    return found.orderBy(F.col("id").desc()).limit(most).orderBy("id")


def prompt_version(system: Column, user: Column) -> Column:
    """The first twelve hexadecimal digits of the prompts' digest."""
    return F.substring(F.sha2(F.concat(system, user), 256), 1, 12)


def with_province_code(df: DataFrame, codes: dict[str, str], name: str = "province_name") -> DataFrame:
    """df with the province_code of the province's plain name; null for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return df.withColumn("province_code", F.try_element_at(known, F.coalesce(normalize_name(F.col(name)), F.lit(""))))
