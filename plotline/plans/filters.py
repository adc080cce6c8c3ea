"""Each filter, order and join of a search by itself, over adverts made of orders."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import search, stats
from .registry import query
from .tables import ADVERTS_SQL, adverts, read

AT = datetime(1998, 1, 16)

#: More columns of adverts, in words that Spark and the oracle read alike.
MORE = {
    "price_value": "price",
    "area_value": "area",
    "price_per_m2": "price / area",
    "title": "concat('Advert ', CASE WHEN id % 3 = 0 THEN 'Sunny_50%' ELSE 'dark' END, ' ', CAST(id % 50 AS VARCHAR(5)))",
    "description": "CASE WHEN id % 4 = 0 THEN NULL ELSE concat('with GARAGE ', CAST(id % 7 AS VARCHAR(5))) END",
    "province_name": "CASE WHEN city_id < 10 THEN 'Małopolskie' ELSE 'Mazowieckie' END",
    "city_name": "concat('City', CAST(city_id AS VARCHAR(5)))",
    "district_name": "CASE WHEN id % 6 = 0 THEN NULL ELSE concat('Old Town ', CAST(id % 5 AS VARCHAR(5))) END",
    "rent_value": "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 3000 END",
    "modified_at": "created_at",
    "scraped_at": "created_at",
    "overall_score": "CASE WHEN id % 2 = 0 THEN id % 10 END",
    "renovation_needed": "CASE WHEN id % 3 = 0 THEN 'none' WHEN id % 3 = 1 THEN 'full' END",
    "style_tag": "CASE WHEN id % 4 < 2 THEN 'MODERN' ELSE 'DATED' END",
    "building_type": "CASE WHEN id % 4 = 0 THEN 'BLOCK' WHEN id % 4 = 1 THEN 'LOFT' END",
    "building_material": "CASE WHEN id % 2 = 0 THEN 'BRICK' ELSE 'WOOD' END",
    "building_heating": "CASE WHEN id % 3 = 0 THEN 'GAS' ELSE 'URBAN' END",
    "advertiser_type": "CASE WHEN id % 7 = 0 THEN 'private' ELSE 'business' END",
    "property_type": "CASE WHEN id % 8 = 0 THEN NULL ELSE 'FLAT' END",
    "property_condition": "CASE WHEN id % 5 = 0 THEN 'TO_RENOVATION' ELSE 'READY_TO_USE' END",
    "offer_type": "CASE WHEN id % 9 = 0 THEN 'RENT' ELSE 'SALE' END",
    "object_type": "CASE WHEN id % 6 = 0 THEN 'HOUSE' ELSE 'APARTMENT' END",
    "building_year": "CASE WHEN id % 10 = 0 THEN NULL ELSE 1950 + id % 70 END",
}
ROWS = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in MORE.items())} FROM {ADVERTS_SQL} a)"


def rows(spark, sf):
    a = adverts(spark, sf)
    return a.selectExpr("*", *(f"{e} AS {c}" for c, e in MORE.items()))


def found(spark, sf, df=None, **asked):
    q = search.Search(**({"statuses": [], "hide_unchecked": False, "hide_dismissed": False} | asked))
    return search.matching(rows(spark, sf) if df is None else df, q, F.lit(AT)).select("id")


@query(f"SELECT id FROM {ROWS} WHERE status = 'active' AND (title ILIKE '%y_50%' OR description ILIKE '%y_50%' OR title ILIKE '%garage 3%' OR description ILIKE '%garage 3%')")
def search_text(spark, sf):
    """Texts are found whatever their case, in the title or the description."""
    return found(spark, sf, statuses=["active"], text="y_50").union(found(spark, sf, statuses=["active"], text="garage 3")).distinct()


@query(f"SELECT id FROM {ROWS} WHERE lower(province_name) = 'małopolskie' AND lower(city_name) IN ('city3', 'city17', 'city5') AND lower(district_name) IN ('old town 1', 'old town 4')")
def search_places(spark, sf):
    return found(spark, sf, voivodeships=["MAŁOPOLSKIE"], cities=["city3", "CITY17", "City5"], districts=["old town 1", "Old Town 4"])


@query(f"SELECT id FROM {ROWS} WHERE (rent_value IS NULL OR rent_value <= 700) AND building_year >= 1960 AND building_year <= 1999")
def search_rent_and_year(spark, sf):
    return found(spark, sf, max_rent=700, min_building_year=1960, max_building_year=1999)


_FLAGS = "(SELECT l_orderkey, list(DISTINCT l_returnflag) AS fs FROM lineitem GROUP BY l_orderkey)"


def _with_features(spark, sf):
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag")
    return rows(spark, sf).join(stats.collected(items, "id", "l_returnflag").withColumnRenamed("values", "features"), "id", "left")


@query(f"SELECT id FROM {ROWS} r LEFT JOIN {_FLAGS} f ON l_orderkey = id WHERE NOT coalesce(list_contains(fs, 'R'), false)")
def features_excluded(spark, sf):
    """Adverts with none of the excluded features; one without features has none."""
    return found(spark, sf, _with_features(spark, sf), excluded_features=["R"])


@query(f"SELECT id FROM {ROWS} r LEFT JOIN {_FLAGS} f ON l_orderkey = id WHERE coalesce(len(fs), 0) >= 2")
def search_feature_count(spark, sf):
    return found(spark, sf, _with_features(spark, sf), min_features_count=2)


@query(f"SELECT id FROM {ROWS} WHERE created_at >= TIMESTAMP '1996-01-01' AND modified_at >= TIMESTAMP '1997-02-03'")
def search_dates(spark, sf):
    return found(spark, sf, created_after=datetime(1996, 1, 1), modified_after=datetime(1997, 2, 3))


@query(f"SELECT id FROM {ROWS} WHERE overall_score IS NOT NULL AND renovation_needed IN ('none') AND style_tag IN ('MODERN', 'RAW')")
def search_evaluated(spark, sf):
    return found(spark, sf, require_evaluation=True, renovation_needed=["none"], style_tags=["MODERN", "RAW"])


@query(
    f"""SELECT id FROM {ROWS} WHERE building_type IN ('BLOCK', 'LOFT') AND building_material IN ('BRICK', 'WOOD') AND building_heating = 'URBAN' AND market = 'SECONDARY' AND advertiser_type = 'business'
    AND property_type = 'FLAT' AND property_condition = 'READY_TO_USE' AND offer_type = 'SALE' AND object_type = 'APARTMENT'"""
)
def search_categories(spark, sf):
    return found(
        spark,
        sf,
        building_types=["BLOCK", "LOFT"],
        building_materials=["BRICK", "WOOD"],
        building_heating=["URBAN"],
        markets=["SECONDARY"],
        advertiser_types=["business"],
        property_types=["FLAT"],
        property_conditions=["READY_TO_USE"],
        offer_types=["SALE"],
        object_types=["APARTMENT"],
    )


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') = '29' AND event_type = 'click'")
def json_attribute_filter(spark, sf):
    """Attributes out of JSON, each asked for as key:value."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type")).alias("attributes"))
    return found(spark, sf, e, attributes=["k: 29", "type:click", "odd"])


_KM = "2 * 6371000 * asin(sqrt(power(sin(radians(50.15 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(50.15)) * power(sin(radians(20.0 - longitude) / 2), 2)))"


@query(f"SELECT id, CAST(round({_KM}) AS BIGINT) AS metres FROM {ROWS} WHERE status = 'active' ORDER BY {_KM}, id DESC LIMIT 20 OFFSET 5")
def search_distance_page(spark, sf):
    """The nearest to a point first."""
    q = search.Search(latitude=50.15, longitude=20.0, sort="distance", direction="asc", limit=20, offset=5, hide_unchecked=False, hide_dismissed=False)
    return search.page(rows(spark, sf), q, F.lit(AT)).select("id", F.round("distance_m").cast("long").alias("metres"))


_HELD = "(contains(lower(title), '{0}') OR coalesce(contains(lower(description), '{0}'), false))::INT"
_RELEVANCE = " + ".join(_HELD.format(k) for k in ("sunny_50%", "garage 3", "dark 4"))


@query(f"SELECT id FROM {ROWS} WHERE status = 'active' ORDER BY {_RELEVANCE} DESC, overall_score DESC NULLS LAST, price DESC NULLS LAST, id DESC LIMIT 40")
def search_relevance_page(spark, sf):
    """What holds most keywords first, then the best score, then the order asked for."""
    q = search.Search(sort="price_value", limit=40, hide_unchecked=False, hide_dismissed=False)
    return search.page(rows(spark, sf), q, F.lit(AT), ["Sunny_50%", "garage 3", "DARK 4"]).select("id")


@query(f"SELECT id FROM {ROWS} WHERE status = 'active' ORDER BY rooms NULLS LAST, {_RELEVANCE} DESC, overall_score DESC NULLS LAST, id DESC LIMIT 40")
def search_relevance_after_order(spark, sf):
    q = search.Search(sort="rooms", direction="asc", limit=40, hide_unchecked=False, hide_dismissed=False)
    return search.page(rows(spark, sf), q, F.lit(AT), ["Sunny_50%", "garage 3", "DARK 4"], False).select("id")


@query(
    """SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'et')::INT + coalesce(contains(lower(lang), 'et'), false)::INT * (1 - contains(lower(text), 'et')::INT) + contains(lower(text), '50%')::INT AS relevance FROM documents"""
)
def text_search_relevance(spark, sf):
    """How many keywords a text, or the name of its language, holds."""
    df = read(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), F.col("lang").alias("description"))
    return df.select("doc_id", search.relevance(["the", "ET", "50%"]).alias("relevance"))


@query(
    f"""SELECT r.id, CAST(quality AS BIGINT) AS quality, days, CASE WHEN r.id % 9 = 0 THEN 'rejected' END AS tracking_status FROM {ROWS} r LEFT JOIN labels l ON l.doc_id = r.id
    LEFT JOIN (SELECT l_orderkey, count(*) AS days FROM lineitem GROUP BY l_orderkey) s ON s.l_orderkey = r.id"""
)
def search_joined(spark, sf):
    """Adverts with evaluations, signals and tracking; an advert without stays."""
    c = F.col
    evaluations = read(spark, sf, "labels").select(c("doc_id").alias("ad_id"), c("quality").cast("long").alias("quality"))
    signals = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("ad_id")).agg(F.count("*").alias("days"))
    tracking = read(spark, sf, "orders").where("o_orderkey % 9 = 0").select(c("o_orderkey").alias("ad_id"), F.lit("rejected").alias("tracking_status"))
    return search.joined(rows(spark, sf), evaluation=evaluations, signals=signals, tracking=tracking).select("id", "quality", "days", "tracking_status")


@query("SELECT c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE lower(r_name) IN ('europe', 'asia')")
def location_semi_join(spark, sf):
    """Places by name through a dimension's names."""
    places = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("r_name").alias("province_name"))
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey")).join(places, "n_nationkey")
    return found(spark, sf, df, voivodeships=["Europe", "ASIA"])


@query("SELECT c_custkey AS id, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_totalprice IS NULL OR o_totalprice <= 50000")
def nullable_max_passes(spark, sf):
    """A rent that is not told passes a limit."""
    o = read(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("rent_value"))
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(o, F.col("o_custkey") == F.col("id"), "left")
    return search.matching(df, search.Search(statuses=[], max_rent=50_000, hide_unchecked=False, hide_dismissed=False), F.lit(AT)).select("id", "o_orderkey")
