"""Searches over adverts made of orders, and predicates over the driver's tables."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import search, stats
from .registry import query
from .tables import ADVERTS_SQL, FLATS_SQL, adverts, flats, read

NOW = datetime(2000, 1, 1)


def _listings(spark, sf):
    """Adverts with the columns a search reads; features are the flags of the order's lines."""
    a = adverts(spark, sf).withColumnsRenamed({"price": "price_value", "area": "area_value"})
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag")
    a = a.join(stats.collected(items, "id", "l_returnflag").withColumnRenamed("values", "features"), "id", "left")
    null = lambda kind: F.lit(None).cast(kind)
    return a.withColumns(
        {
            "price_per_m2": F.col("price_value") / F.col("area_value"),
            "scraped_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"),
            "tracking_status": F.when(F.col("id") % 9 == 0, "rejected"),
            "overall_score": F.when(F.col("id") % 2 == 0, (F.col("id") % 10).cast("int")),
            "days_on_market": F.when(F.col("id") % 3 != 0, F.col("id") % 400),
            "price_change_pct": F.when(F.col("id") % 3 != 0, (F.col("id") % 5 - 2).cast("double")),
            "location_flags": F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 7 == 0, F.array(F.lit("near_city_border"))).otherwise(F.array().cast("array<string>"))),
            "title": F.concat(F.lit("Advert "), F.col("id").cast("string")),
            "description": null("string"),
            "building_floors": F.lit(5),
        }
    )


_SEARCH = f"""
    WITH f AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS fs FROM lineitem GROUP BY l_orderkey),
    a AS (SELECT *, CASE WHEN floor = 'GROUND_FLOOR' THEN 0 WHEN regexp_matches(floor, '^FLOOR_[0-9]+$') THEN CAST(substr(floor, 7) AS INT) END AS fl FROM {ADVERTS_SQL})
    SELECT id, price, created_at FROM a LEFT JOIN f ON l_orderkey = id
    WHERE status = 'active' AND price BETWEEN 100000 AND 400000 AND area <= 90 AND rooms >= 2 AND market IN ('SECONDARY')
      AND (fl IS NULL OR fl > 0) AND floor IS DISTINCT FROM 'GARRET' AND (fl IS NULL OR fl < 5)
      AND list_contains(fs, 'A') AND list_contains(fs, 'N') AND NOT (id % 9 = 0)
      AND (id % 3 = 0 OR NOT id % 7 = 0) AND created_at + INTERVAL 1 DAY >= TIMESTAMP '1997-12-02'"""


def _query(**more):
    return search.Search(
        min_price=100_000, max_price=400_000, max_area=90, min_rooms=2, markets=["SECONDARY"], exclude_ground_floor=True, exclude_top_floor=True, features=["A", "N"], excluded_location_flags=["near_city_border"], **more
    )


def _at():
    return F.lit(datetime(1998, 1, 16))


@query(_SEARCH + " ORDER BY price DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10")
def search_page(spark, sf):
    got = search.page(_listings(spark, sf), _query(sort="price_value", offset=10), _at())
    return got.select("id", F.col("price_value").alias("price"), "created_at")


@query(f"SELECT count(*) AS total FROM ({_SEARCH}) t")
def search_total(spark, sf):
    return search.total(_listings(spark, sf), _query(), _at())


@query(f"SELECT id, days % 400 AS days FROM (SELECT id, id AS days FROM {ADVERTS_SQL} WHERE id % 3 <> 0 AND id % 5 - 2 < 0 AND (id % 400) BETWEEN 100 AND 200 AND id % 2 = 0 AND id % 10 >= 4 AND id % 9 <> 0)")
def search_signals(spark, sf):
    q = search.Search(statuses=[], price_trends=["dropped"], min_days_on_market=100, max_days_on_market=200, min_scores={"overall_score": 4}, hide_unchecked=False)
    return search.matching(_listings(spark, sf), q, _at()).select("id", F.col("days_on_market").alias("days"))


_CODE = "CASE WHEN p_size = 1 THEN 'GROUND_FLOOR' WHEN p_size = 2 THEN 'CELLAR' WHEN p_size = 3 THEN 'FLOOR_HIGHER_10' WHEN p_size < 20 THEN concat('FLOOR_', CAST(p_size AS VARCHAR(5))) WHEN p_size < 30 THEN 'GARRET' END"


@query(
    f"""SELECT p_partkey, CAST(CASE WHEN code = 'GROUND_FLOOR' THEN 0 WHEN code = 'CELLAR' THEN -1 WHEN code = 'FLOOR_HIGHER_10' THEN 11 WHEN regexp_matches(code, '^FLOOR_[0-9]+$') THEN CAST(substr(code, 7) AS INT) END AS INT) AS floor
    FROM (SELECT p_partkey, {_CODE} AS code FROM part)"""
)
def floor_code_case(spark, sf):
    return read(spark, sf, "part").selectExpr("p_partkey", f"{_CODE} AS code").select("p_partkey", rules.floor_number(F.col("code")).alias("floor"))


_TYPES = {"url": "CASE WHEN p_partkey % 19 = 0 THEN '/inwestycja/x' ELSE '/oferta/x' END", "stored": "CASE WHEN p_partkey % 5 = 0 THEN 'HOUSE' END", "fl": "CASE WHEN p_partkey % 7 = 0 THEN 'FLOOR_1' END", "building": "CASE WHEN p_size = 4 THEN 'FARM' WHEN p_size = 5 THEN 'LOFT' END", "market": "CASE WHEN p_partkey % 3 = 0 THEN 'PRIMARY' END"}
_TITLE = "CASE WHEN p_name LIKE '%ring' THEN concat('Piękny Dom, ', p_name) WHEN p_name LIKE '%bolt' THEN concat('Mieszkanie ', p_name) ELSE concat('Domofon ', p_name) END"


@query(
    f"""SELECT p_partkey, CASE WHEN stored_offer IS NOT NULL THEN stored_offer WHEN market IN ('PRIMARY', 'SECONDARY') THEN 'SALE' WHEN p_retailprice < 1000 THEN 'RENT' ELSE 'SALE' END AS offer_type,
    CASE WHEN contains(url, '/inwestycja/') THEN 'INVESTMENT' WHEN stored IS NOT NULL THEN stored WHEN fl IS NOT NULL THEN 'APARTMENT' WHEN building = 'FARM' THEN 'HOUSE' WHEN building = 'LOFT' THEN 'APARTMENT'
    WHEN title LIKE 'Piękny Dom%' THEN 'HOUSE' WHEN title LIKE 'Mieszkanie%' THEN 'APARTMENT' END AS object_type
    FROM (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 11 = 0 THEN 'RENT' END AS stored_offer, {", ".join(f"{e} AS {c}" for c, e in _TYPES.items())}, {_TITLE} AS title FROM part)"""
)
def inferred_type_cascade(spark, sf):
    c = F.col
    df = read(spark, sf, "part").selectExpr("p_partkey", "p_retailprice * 30 AS price", "CASE WHEN p_partkey % 11 = 0 THEN 'RENT' END AS stored_offer", *(f"{e} AS {k}" for k, e in _TYPES.items()), f"{_TITLE} AS title")
    return df.select(
        "p_partkey", rules.offer_type(c("stored_offer"), c("market"), c("price")).alias("offer_type"), rules.object_type(c("url"), c("stored"), c("fl"), c("building"), F.lit(None).cast("string"), c("title")).alias("object_type")
    )


@query(
    """WITH t AS (SELECT p_size AS s, p_retailprice AS r FROM part WHERE p_partkey = 7)
    SELECT p_partkey AS id, round(abs(p_size - s) * 3 + abs(p_retailprice - r) * 0.01, 4) AS difference FROM part, t WHERE p_partkey <> 7 AND abs(p_size - s) <= 5 AND abs(p_retailprice - r) <= 100"""
)
def similar_to_target(spark, sf):
    df = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return search.similar_to(df, 7, {"p_size": 5, "p_retailprice": 100}, {"p_size": 3, "p_retailprice": 0.01}).select("id", F.round("difference", 4).alias("difference"))


@query(
    f"""SELECT id FROM {FLATS_SQL} WHERE 2 * 6371000 * asin(sqrt(power(sin(radians(50.15 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(50.15)) * power(sin(radians(20.0 - longitude) / 2), 2))) <= 5000"""
)
def radius_search(spark, sf):
    return flats(spark, sf).where(search.within_radius(F.col("latitude"), F.col("longitude"), 50.15, 20.0, 5000)).select("id")


_FLAGS = "list(DISTINCT l_returnflag) AS fs FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey AS id, list_contains(fs, 'A') AND list_contains(fs, 'R') AS has_all, list_contains(fs, 'N') OR list_contains(fs, 'R') AS has_any, CAST(len(fs) AS INT) AS n FROM (SELECT l_orderkey, {_FLAGS})")
def features_all_any(spark, sf):
    df = stats.collected(read(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")
    f = F.col("values")
    return df.select(F.col("l_orderkey").alias("id"), search.features_all(f, ["A", "R"]).alias("has_all"), search.features_any(f, ["N", "R"]).alias("has_any"), F.size(f).alias("n"))


@query(
    """WITH s AS (SELECT doc_id AS ad_id, CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS status, doc_id % 5 AS attempts, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'v2' END AS v FROM labels)
    SELECT d.doc_id AS id FROM documents d LEFT JOIN s ON s.ad_id = d.doc_id WHERE d.lang IN ('en', 'fr') AND (s.ad_id IS NULL OR v <> 'v2' OR (s.status = 'failed' AND attempts < 3))"""
)
def candidate_queue(spark, sf):
    from ..operators.enrich import to_screen

    ads = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang").isin("en", "fr"), "active").otherwise("outdated").alias("status"), F.lit(NOW).alias("created_at"), F.lit(NOW).alias("modified_at"))
    done = read(spark, sf, "labels").select(
        F.col("doc_id").alias("ad_id"),
        F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"),
        (F.col("doc_id") % 5).alias("attempts"),
        F.when(F.col("doc_id") % 4 == 0, "old").otherwise("v2").alias("prompt_version"),
        F.lit(NOW).alias("ad_modified_at"),
    )
    return to_screen(ads, done, "v2")
