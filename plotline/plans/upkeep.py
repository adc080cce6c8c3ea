"""Queues, keyed tables, accounts of scoring and logs, over the driver's tables."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import arrays, labels, rules, text
from ..operators import assistant, checks, comparables, developer, documents, enrich, locations, merge, signals, stats, upkeep
from ..sources import geodata, payload, pricelists
from .filters import ROWS, rows
from .places import _squares
from .registry import query
from .tables import ADVERTS_SQL, FLATS_SQL, adverts, flats, read, sales

NOW = datetime(1998, 1, 16)


def _ads(spark, sf):
    """Adverts whose city is unknown for some, looked at when they were made, or never."""
    a = adverts(spark, sf).withColumn("city_name", F.concat(F.lit("City"), F.col("city_id").cast("string")))
    return a.withColumns({"city_id": F.when(F.col("id") % 10 != 0, F.col("city_id")), "scraped_at": F.when(F.col("id") % 13 != 0, F.col("created_at"))})


_ADS = f"(SELECT * REPLACE (CASE WHEN id % 10 <> 0 THEN city_id END AS city_id), concat('City', city_id) AS city_name, CASE WHEN id % 13 <> 0 THEN created_at END AS scraped_at FROM {ADVERTS_SQL} a)"


@query(
    f"""SELECT id, row_number() OVER (ORDER BY scraped_at NULLS LAST, id) AS place FROM {_ADS} WHERE status = 'active' AND id % 4 = 1 AND price BETWEEN 50000 AND 300000
    AND (city_name ILIKE 'city7' OR city_id IS NULL) AND (scraped_at IS NULL OR scraped_at < TIMESTAMP '1998-01-16' - INTERVAL 300 DAYS)"""
)
def update_queue(spark, sf):
    got = upkeep.update_queue(_ads(spark, sf), F.lit(NOW), city="CITY7", least=50_000, most=300_000, days=300, shard=upkeep.parsed_shard("2/4"))
    return _placed(got)


def _placed(df):
    """A list in its order, numbered from 1."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.monotonically_increasing_id()).select("id", F.row_number().over(Window.orderBy("_n")).cast("long").alias("place"))


@query(f"SELECT id, row_number() OVER (ORDER BY scraped_at DESC NULLS LAST, id) AS place FROM {_ADS} WHERE status = 'active' AND city_id IS NULL")
def repair_queue(spark, sf):
    return _placed(upkeep.update_queue(_ads(spark, sf), F.lit(NOW), without_place=True, days=5))


_BOX = "(SELECT n_nationkey, n_name AS name, 50e0 + (n_nationkey % 5) * 6e-2 AS s, 198e-1 + floor(n_nationkey / 5) * 8e-2 AS w FROM nation)"


def _km_out(lat, lon, s, w):
    """Metres from a point to a square: the nearest point of it, on the plane at the point's latitude."""
    dx = f"greatest({w} - {lon}, {lon} - ({w} + 8e-2), 0) * cos(radians({lat}))"
    return f"sqrt(power({dx}, 2) + power(greatest({s} - {lat}, {lat} - ({s} + 6e-2), 0), 2)) * 111320"


@query(f"SELECT id FROM {FLATS_SQL} f, {_BOX} b WHERE name = 'NATION_6' AND {_km_out('latitude', 'longitude', 's', 'w')} <= 3000")
def within_city(spark, sf):
    """Flats in a town or within three kilometres of its border."""
    areas = _squares(spark, sf).select(F.lit("city").alias("level"), F.col("name").alias("city_name"), "sides")
    cities = read(spark, sf, "nation").select(F.lower("n_name").alias("code"), F.col("n_name").alias("name"))
    return upkeep.within_city(flats(spark, sf), areas, cities, "NATION_6", 3)


_WAY = "(SELECT s_suppkey, 50e0 + s_suppkey * 7 % 30 / 1e2 AS la, 198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo FROM supplier)"


@query(
    f"""SELECT DISTINCT f.id FROM {FLATS_SQL} f JOIN {_WAY} v ON latitude BETWEEN la - 3e-3 AND la + 13e-3 AND longitude BETWEEN lo - 3e-3 AND lo + 33e-3
    JOIN {_BOX} b ON latitude >= s AND latitude < s + 6e-2 AND longitude >= w AND longitude < w + 8e-2 WHERE f.id % 3 > 0"""
)
def street_candidates(spark, sf):
    ads = flats(spark, sf).withColumn("street", F.when(F.col("id") % 3 > 0, "x"))
    way = read(spark, sf, "supplier").selectExpr("50e0 + s_suppkey * 7 % 30 / 1e2 AS la", "198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo")
    pts = F.array(F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon")), F.struct((F.col("la") + 1e-2).alias("lat"), (F.col("lo") + 3e-2).alias("lon")))
    return upkeep.street_candidates(ads, way.select(pts.alias("points")), _squares(spark, sf).select("sides"))


@query(
    """SELECT round(coalesce(sum(value), 0), 4) AS cost_usd FROM events JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-20' AND user_id % 3 = 0) r USING (user_id)
    WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-20'"""
)
def requested_spending(spark, sf):
    e = read(spark, sf, "events")
    since = F.lit("2024-01-20").cast("timestamp")
    of = lambda kind, at: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("ad_id"), F.col("ts").alias(at), F.col("value").alias("cost_usd"))
    asked = e.where("event_type = 'purchase' AND user_id % 3 = 0").groupBy(F.col("user_id").alias("ad_id")).agg(F.max("ts").alias("finished_at"))
    return upkeep.requested_spending(asked, of("click", "screened_at"), of("view", "evaluated_at"), since).select(F.round("cost_usd", 4).alias("cost_usd"))


def _evaluations(spark, sf):
    return read(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 6 = 0 THEN 'failed' ELSE 'ok' END AS status", "o_totalprice AS cost_usd", "CAST(o_custkey % 10 AS INT) AS overall_score")


@query("SELECT o_orderkey AS ad_id, o_orderdate AS requested_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def pending_requests(spark, sf):
    r = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ad_id"), F.col("o_orderdate").alias("requested_at"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return upkeep.pending(r)


@query("SELECT max(event_id) AS newest_id, max(ts) AS loaded_at FROM events")
def newest_load(spark, sf):
    return upkeep.newest(read(spark, sf, "events"), newest_id="event_id", loaded_at="ts")


@query(
    """SELECT id, listing_group_id, listings_count, CASE WHEN listings_count >= 2 OR days >= 45 THEN 'ten sam lokal ogłaszany od ' || strftime(since, '%Y-%m-%d') || ', ' || days || ' dni na rynku' ||
    CASE WHEN listings_count > 1 THEN ', ' || listings_count || ' ogłoszeń od ' || owners || ' ogłoszeniodawców' ELSE '' END || CASE WHEN active > 1 THEN ', teraz wystawiony równolegle w ' || active || ' ogłoszeniach' ELSE '' END END AS phrase
    FROM (SELECT o_custkey AS id, o_custkey AS listing_group_id, count(*) AS listings_count, min(o_orderdate) AS since, count(DISTINCT o_orderpriority) AS owners, count(*) FILTER (o_orderstatus = 'O') AS active, o_custkey % 90 AS days FROM orders GROUP BY o_custkey) t"""
)
def history_phrases(spark, sf):
    """What a lineage tells in one sentence."""
    c = F.col
    g = read(spark, sf, "orders").groupBy(c("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("since"), F.count_distinct("o_orderpriority").alias("owners"), F.count_if(c("o_orderstatus") == "O").alias("active"))
    phrase = documents.history_phrase(c("n"), c("id") % 90, c("since"), c("owners"), c("active"), F.lit(5), F.lit(5))
    return g.select("id", c("id").alias("listing_group_id"), c("n").alias("listings_count"), phrase.alias("phrase"))


_EVALUATIONS = "(SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'failed' ELSE 'ok' END AS status, o_totalprice AS cost_usd, CAST(o_custkey % 10 AS INT) AS overall_score FROM orders)"


@query(f"SELECT count(*) AS n, round(sum(cost_usd), 2) AS cost_usd, round(avg(overall_score), 6) AS mean_score FROM {_EVALUATIONS} WHERE status = 'ok'")
def score_summary(spark, sf):
    return upkeep.score_summary(_evaluations(spark, sf)).select("n", F.round("cost_usd", 2).alias("cost_usd"), F.round("mean_score", 6).alias("mean_score"))


@query(f"SELECT overall_score, count(*) AS n FROM {_EVALUATIONS} WHERE status = 'ok' GROUP BY overall_score")
def score_distribution(spark, sf):
    return upkeep.score_distribution(_evaluations(spark, sf))


@query("SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS rejection_reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def rejection_reasons(spark, sf):
    s = read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("passed").alias("status"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("rejection_reason"))
    return upkeep.rejection_reasons(s)


@query(f"SELECT rooms, count(*) AS n, round(avg(price), 4) AS mean_price, round(avg(price / area), 4) AS mean_price_per_m2, round(avg(area), 4) AS mean_area FROM {ADVERTS_SQL} a WHERE status = 'active' GROUP BY rooms")
def by_rooms(spark, sf):
    got = upkeep.by_rooms(adverts(spark, sf).withColumn("price_per_m2", F.col("price") / F.col("area")))
    return got.select("rooms", "n", *(F.round(c, 4).alias(c) for c in got.columns[2:]))


@query(f"SELECT city_id, count(*) AS n FROM {ADVERTS_SQL} a WHERE status = 'active' GROUP BY city_id ORDER BY n DESC, city_id LIMIT 10")
def busiest_districts(spark, sf):
    return upkeep.most_frequent(adverts(spark, sf), "city_id")


@query("SELECT l_shipmode AS feature, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey) t WHERE o_orderstatus <> 'F' GROUP BY 1 ORDER BY n DESC, feature LIMIT 3")
def top_features(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return upkeep.most_frequent(j.select(F.concat("l_returnflag", "l_linestatus").alias("feature"), F.when(F.col("o_orderstatus") != "F", "active").alias("status")), "feature", 3)


_LEVEL = "CASE event_type WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'WARNING' WHEN 'purchase' THEN 'ERROR' ELSE 'DEBUG' END"


@query(f"SELECT event_id AS id, level FROM (SELECT *, {_LEVEL} AS level FROM events) t WHERE user_id = 7 AND level IN ('WARNING', 'ERROR', 'CRITICAL') AND props ILIKE '%K\": 1%' ORDER BY event_id DESC LIMIT 12")
def log_lines(spark, sf):
    logs = read(spark, sf, "events").selectExpr("event_id AS id", "CAST(user_id AS STRING) AS service", f"{_LEVEL} AS level", "props AS message")
    return upkeep.log_lines(logs, "7", "warning", 'K": 1', 12).select("id", "level")


@query("SELECT item_id, left(sha256(concat(text, CAST(item_id AS VARCHAR))), 12) AS version FROM benchmark")
def prompt_versions(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", upkeep.prompt_version(F.col("text"), F.col("item_id").cast("string")).alias("version"))


@query("SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '28' WHEN 2 THEN '10' END AS province_code FROM customer")
def province_codes(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ("Małopolskie", "WARMIŃSKO-MAZURSKIE", "łódzkie", "Atlantis"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return upkeep.with_province_code(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), said.alias("province_name")), checks.PROVINCE_CODES).select("id", "province_code")


# ---- keyed tables


def _old(spark, sf):
    return read(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))


def _new(spark, sf):
    o = read(spark, sf, "orders").where("o_custkey % 4 > 0")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("name"), F.max("o_totalprice").alias("value"))


_OLD = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer WHERE c_custkey % 3 > 0)"
_NEW = "(SELECT o_custkey AS id, min(o_orderpriority) AS name, max(o_totalprice) AS value FROM orders WHERE o_custkey % 4 > 0 GROUP BY o_custkey)"


@query(f"SELECT * FROM {_OLD} o UNION ALL SELECT * FROM {_NEW} n WHERE id NOT IN (SELECT id FROM {_OLD} o2)")
def inserted_if_absent(spark, sf):
    return merge.inserted(_old(spark, sf), _new(spark, sf), ["id"])


@query(
    f"""SELECT id, CASE WHEN n.name IS NULL OR n.name LIKE '1%' THEN o.name ELSE n.name END AS name, coalesce(n.place, o.place) AS place, CASE WHEN n.id IS NOT NULL THEN n.value ELSE o.value END AS value
    FROM (SELECT *, value + 1 AS place FROM {_OLD} x) o FULL JOIN (SELECT *, CASE WHEN id % 5 > 0 THEN value END AS place FROM {_NEW} y) n USING (id)"""
)
def refreshed_listings(spark, sf):
    """A withheld text never takes a real one's place, and a known place is never wiped; other columns are the new ones."""
    old = _old(spark, sf).withColumn("place", F.col("value") + 1)
    new = _new(spark, sf).select("id", F.when(F.startswith("name", F.lit("1")), "***").otherwise(F.col("name")).alias("name"), "value", F.when(F.col("id") % 5 > 0, F.col("value")).alias("place"))
    return merge.refreshed(old, new, "id", ["name"], ["place"], ["value"])


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'outdated' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 5 = 0 THEN TIMESTAMP '1998-01-16' ELSE o_orderdate END AS scraped_at FROM orders")
def outdated_listings(spark, sf):
    ads = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("scraped_at"))
    gone = read(spark, sf, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("id"))
    return merge.outdated(ads, gone, "id", F.lit(NOW).cast(dict(ads.dtypes)["scraped_at"]))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def cascade_delete(spark, sf):
    kept = merge.without(read(spark, sf, "lineitem"), read(spark, sf, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(f"SELECT id, coalesce(o.name, n.name) AS name, CASE WHEN n.id IS NOT NULL THEN n.value ELSE o.value END AS unit_price FROM {_OLD} o FULL JOIN {_NEW} n USING (id)")
def register_upsert(spark, sf):
    """What the register told first stays, but for prices."""
    return merge.register_upsert(_old(spark, sf).withColumnRenamed("value", "unit_price"), _new(spark, sf).withColumnRenamed("value", "unit_price"))


@query(
    """WITH r AS (SELECT c_custkey AS ad_id, CASE WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'done' END AS status, c_custkey % 7 AS asked FROM customer WHERE c_custkey % 3 = 0),
    w AS (SELECT DISTINCT o_custkey AS ad_id FROM orders WHERE o_custkey % 5 < 2 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 > 0))
    SELECT ad_id, CASE WHEN w.ad_id IS NOT NULL AND status IS DISTINCT FROM 'pending' THEN 'pending' ELSE status END AS status, CASE WHEN w.ad_id IS NOT NULL AND status IS DISTINCT FROM 'pending' THEN NULL ELSE asked END AS asked FROM r FULL JOIN w USING (ad_id)"""
)
def enqueued_requests(spark, sf):
    """Finished requests are opened again, unknown adverts ignored. asked: days since an old request was made, null for a new one."""
    c = F.col
    day = lambda n: F.timestamp_add("DAY", -n, F.lit(NOW))
    old = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(c("c_custkey").alias("ad_id"), F.when(c("c_custkey") % 2 == 0, "pending").otherwise("done").alias("status"), day(c("c_custkey").cast("int") % 7).alias("requested_at"), F.lit(NOW).alias("finished_at"))
    ids = read(spark, sf, "orders").where("o_custkey % 5 < 2").select(c("o_custkey").alias("ad_id"))
    ads = read(spark, sf, "customer").where("c_custkey % 11 > 0").select(c("c_custkey").alias("id"))
    later = F.lit(datetime(2000, 1, 1))
    got = merge.enqueued(old, ids, ads, later)
    return got.select("ad_id", "status", F.when(c("requested_at") != later, F.datediff(F.lit(NOW), "requested_at").cast("long")).alias("asked"))


@query(
    f"""SELECT id, CASE WHEN e.first < u.first_seen THEN e.first ELSE u.first_seen END AS first_seen, CASE WHEN e.first < u.first_seen THEN e.price ELSE u.first_price END AS first_price,
    CASE WHEN e.first < u.first_seen THEN least(u.lowest_price, e.price) ELSE u.lowest_price END AS lowest_price, CASE WHEN e.first < u.first_seen THEN greatest(u.highest_price, e.price) ELSE u.highest_price END AS highest_price
    FROM (SELECT id, 20 AS first_seen, value AS first_price, value - 1 AS lowest_price, value + 1 AS highest_price FROM {_OLD} o) u
    LEFT JOIN (SELECT o_custkey AS id, min(o_orderkey % 40) AS first, arg_min(o_totalprice, (o_orderkey % 40, o_totalprice)) AS price FROM orders GROUP BY o_custkey) e USING (id)"""
)
def backdated_units(spark, sf):
    u = _old(spark, sf).select("id", F.lit(20).cast("long").alias("first_seen"), F.col("value").alias("first_price"), (F.col("value") - 1).alias("lowest_price"), (F.col("value") + 1).alias("highest_price"))
    return merge.backdated(u, read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 40).alias("observed_at"), F.col("o_totalprice").alias("price")))


@query("SELECT o_orderkey AS unit_id, o_custkey AS customer FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def restarted_units(spark, sf):
    """Prices of renumbered units go."""
    u = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("first_seen"), F.lit(2.0).alias("first_price"))
    anew = read(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.lit(5).alias("observed_at"), F.lit(6.0).alias("price"))
    prices = read(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id"), "o_orderkey")
    return merge.restarted(u, prices, anew)[1].select(F.col("o_orderkey").alias("unit_id"), F.col("unit_id").alias("customer"))


@query(f"SELECT id AS ad_id, value AS price FROM {_NEW} n WHERE id NOT IN (SELECT id FROM {_OLD} o) AND value > 0")
def new_listings(spark, sf):
    """The first price observations of a batch of adverts, one of which is held twice."""
    new = _new(spark, sf).select("id", F.col("value").alias("price"), F.lit(1.0).alias("area"), F.lit("active").alias("status"), F.lit(NOW).alias("modified_at"))
    twice = new.unionByName(new.withColumns({"price": F.lit(1.0), "modified_at": F.lit(datetime(1990, 1, 1))}))
    raw = new.select(F.col("id").alias("ad_id"), F.lit("{}").alias("payload"))
    return merge.new_listings(_old(spark, sf), twice, raw, {"features": raw}, F.lit(NOW))["observations"].select("ad_id", "price")


# ---- sources and documents


@query("SELECT p_partkey AS id, 'https://x/' || 'slug-' || p_partkey AS url, CAST(p_size % 6 + 1 AS INT) AS rooms, CAST(p_size % 11 AS INT) AS floor, p_retailprice AS price FROM part")
def result_pages(spark, sf):
    """Result pages of ten items each, read back as rows."""
    c = F.col
    word = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    item = F.struct(
        c("p_partkey").alias("id"),
        F.concat(F.lit("[lang]/ad/slug-"), c("p_partkey").cast("string")).alias("href"),
        word(rules.ROOM_WORDS, c("p_size") % 6).alias("roomsNumber"),
        word(rules.FLOOR_WORDS, c("p_size") % 11).alias("floorNumber"),
        F.struct(c("p_retailprice").alias("value")).alias("totalPrice"),
    )
    pages = read(spark, sf, "part").groupBy(F.floor(c("p_partkey") / 10).alias("page")).agg(F.collect_list(item).alias("items"))
    found = F.struct(F.struct(F.lit(3).alias("totalPages")).alias("pagination"), c("items"))
    json = pages.select(F.to_json(F.struct(F.struct(F.struct(F.struct(found.alias("searchAds")).alias("data")).alias("pageProps")).alias("props"))).alias("json"))
    return payload.results(json, "https://x/").select("id", "url", "rooms", "floor", "price")


@query("SELECT c_custkey AS id, 'malopolskie' AS province_code, 'c' || (c_nationkey % 5) AS city_code, CASE WHEN c_custkey % 2 = 0 THEN 'd' || (c_nationkey % 7) END AS district_code FROM customer")
def location_hints(spark, sf):
    """Codes out of the levels of an advert's place; an empty tracking id does not count."""
    c = F.col
    s = lambda k, n: F.concat(F.lit(k), (c("c_nationkey") % n).cast("string"))
    level = lambda name, path: F.struct(F.lit(name).alias("level"), path.alias("id"), F.lit("x").alias("name"))
    levels = F.array_compact(F.array(level("voivodeship", F.lit("malopolskie")), level("city_or_village", F.concat(F.lit("a/b/"), s("c", 5))), F.when(c("c_custkey") % 2 == 0, level("district", F.concat(F.lit("a/b/c/"), s("d", 7))))))
    ads = read(spark, sf, "customer").select(c("c_custkey").alias("id"), levels.alias("levels"), F.lit("").alias("region_id"), F.lit(None).cast("string").alias("subregion_id"), F.lit("").alias("tracked_city_id"), F.lit("").alias("tracked_city_name"))
    return locations.hints(ads).select("id", "province_code", "city_code", "district_code")


@query("SELECT s_suppkey AS osm_id, 'pawla' || s_suppkey AS street_key FROM supplier WHERE s_suppkey % 4 > 0")
def named_streets(spark, sf):
    name = F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("Aleja Jana Pawła"), F.col("s_suppkey").cast("string"))).otherwise("Osiedle Zielone")
    pts = F.array(*(F.struct(F.lit(50.0 + i).alias("lat"), F.lit(20.0).alias("lon")) for i in (0, 1)))
    ways = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("osm_id"), F.create_map(F.lit("name"), name).alias("tags"), pts.alias("points"))
    return geodata.named_streets(ways).select("osm_id", "street_key")


@query("SELECT '12' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name AS name, round(6e-2 * 111.32 * 8e-2 * 111.32 * cos(radians(50e0 + (n_nationkey % 5) * 6e-2 + 24e-3)), 2) AS km2 FROM nation")
def border_layer(spark, sf):
    """Borders written as a layer's document, read and put together as areas."""
    c = F.col
    n = read(spark, sf, "nation").selectExpr("n_nationkey", "n_name", "50e0 + (n_nationkey % 5) * 6e-2 AS s", "198e-1 + floor(n_nationkey / 5) * 8e-2 AS w")
    at = F.concat_ws(" ", c("s"), c("w"), c("s"), c("w") + 0.08, c("s") + 0.06, c("w") + 0.08, c("s") + 0.06, c("w"), c("s"), c("w"))
    xml = F.concat(
        F.lit('<wfs:member><ms:A><ms:msGeometry><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList srsDimension="2">'), at, F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></ms:msGeometry>"),
        F.lit("<ms:JPT_KOD_JE>12"), F.lpad(c("n_nationkey").cast("string"), 2, "0"), F.lit("</ms:JPT_KOD_JE><ms:JPT_NAZWA_>"), c("n_name"), F.lit("</ms:JPT_NAZWA_></ms:A></wfs:member>"),
    )
    got = geodata.areas(geodata.layer_parts(n.select(xml.alias("xml"))))
    return got.select("code", "name", F.round("area_km2", 2).alias("km2"))


@query("SELECT user_id, array_to_string(list(day ORDER BY day), ',') AS days FROM (SELECT user_id, CAST(min(ts) AS DATE) AS day FROM events GROUP BY user_id UNION SELECT user_id, CAST(max(ts) AS DATE) FROM events GROUP BY user_id) GROUP BY user_id")
def sampled_days(spark, sf):
    """Days at least a year apart, and the newest: here the first and the last."""
    d = stats.collected(read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")
    return d.select("user_id", F.array_join(arrays.sampled_days(F.col("values"), 365).cast("array<string>"), ",").alias("days"))


@query("SELECT 'f' AS file, CAST(p_partkey AS VARCHAR) AS unit_key FROM part WHERE p_size % 9 IN (2, 5) OR p_size % 4 = 1")
def units_in_places(spark, sf):
    """Units of some towns or gminas, told by their plain names."""
    c = F.col
    units = read(spark, sf, "part").select(F.lit("f").alias("file"), c("p_partkey").cast("string").alias("unit_key"), F.concat(F.lit("Łódź "), (c("p_size") % 9).cast("string")).alias("town"), F.concat(F.lit("Gmina Ząb "), (c("p_size") % 4).cast("string")).alias("gmina"))
    places = spark.createDataFrame([("lodz 2",), ("m. ŁÓDŹ  5",), ("zab 1",)], "name string")
    return pricelists.in_places(units, places).select("file", "unit_key")


@query(
    """SELECT o_custkey AS group_id, count(*) AS adverts, sum((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)) AS prices, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_id FROM orders GROUP BY o_custkey"""
)
def lineage_documents(spark, sf):
    """Groups with their adverts in order of age, each with its prices."""
    c = F.col
    ads = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderdate").alias("created_at"), c("o_totalprice").alias("price"), c("o_custkey").alias("owner_id"))
    groups = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("group_id"))
    seen = read(spark, sf, "lineitem").select(c("l_orderkey").alias("ad_id"), c("l_linenumber").alias("observed_at"), c("l_extendedprice").alias("price"))
    got = documents.lineage_history(groups, ads, seen)
    return got.select("group_id", F.size("adverts").cast("long").alias("adverts"), F.aggregate("adverts", F.lit(0).cast("long"), lambda n, a: n + F.size(a["prices"])).alias("prices"), c("adverts")[0]["id"].alias("first_id"))


@query(
    """SELECT l_orderkey AS id, round(l_extendedprice / l_quantity * 10, 4) AS price_per_m2 FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS m FROM lineitem) t
    WHERE l_linenumber = 1 AND l_quantity BETWEEN 15 AND 400 AND l_returnflag <> 'R' AND l_linestatus = 'O' AND (l_suppkey % 2 = 0 OR m = 1) AND l_extendedprice * 10 / l_quantity BETWEEN 2000 AND 60000 AND l_shipdate >= TIMESTAMP '1996-01-01'"""
)
def usable_sales(spark, sf):
    """Whole flats sold on the open market at a sane price; of a deed over several units only those with a price of their own."""
    c = F.col
    li = read(spark, sf, "lineitem").select(
        c("l_orderkey").alias("id"),
        "l_linenumber",
        c("l_partkey").alias("transaction_key"),
        F.lit("SECONDARY").alias("market"),
        F.lit("mieszkalna").alias("function"),
        F.when(c("l_returnflag") == "R", "1/2").when(c("l_returnflag") == "A", "1/1").alias("share"),
        F.when(c("l_linestatus") == "O", "wolnyRynek").otherwise("inna").alias("transaction_kind"),
        c("l_quantity").alias("area"),
        F.when(c("l_suppkey") % 2 == 0, c("l_extendedprice") * 10).alias("unit_price"),
        (c("l_extendedprice") * 10).alias("transaction_price"),
        c("l_shipdate").alias("sold_at"),
    )
    got = comparables.usable_sales(li, F.lit(datetime(1996, 1, 1)).cast(dict(li.dtypes)["sold_at"]))
    return got.where("l_linenumber = 1").select("id", F.round("price_per_m2", 4).alias("price_per_m2"))


@query(f"SELECT id FROM {ROWS} WHERE offer_type = 'SALE' AND object_type = 'APARTMENT' AND price > 0 AND area <= 100 + 80 AND NOT contains(title, 'dark 3')")
def flat_sales(spark, sf):
    """Adverts that are compared with sales of flats: none whose title or building tells of a house."""
    df = rows(spark, sf).withColumn("title", F.when(F.contains("title", F.lit("dark 3")), "Ładny dom").otherwise(F.col("title"))).withColumn("building_type", F.lit(None).cast("string"))
    return df.where(signals.is_flat_sale()).select("id")


@query("SELECT c_custkey AS id, CASE WHEN m BETWEEN 1000 AND 15000 THEN 'pin_far_from_street' ELSE '' END AS flag, CASE WHEN m BETWEEN 1000 AND 15000 THEN replace(CAST(round_even(m / 1000.0, 1) AS VARCHAR), '.', ',') ELSE '' END AS km FROM (SELECT c_custkey, c_custkey * 7 % 20000 AS m FROM customer)")
def street_verdicts(spark, sf):
    v = checks.street_verdict(F.lit("Długa"), (F.col("c_custkey") * 7 % 20_000).cast("int")).alias("v")
    got = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), v)
    return got.select("id", F.array_join("v.flags", ",").alias("flag"), F.regexp_extract(F.array_join("v.notes", ","), r"ok\. ([\d,]+) km", 1).alias("km"))


@query(
    f"""SELECT g AS id, CASE WHEN len(o) > 0 THEN 'Inne ogłoszenia tego samego lokalu podawały miejscowość: ' || array_to_string(o, ', ') || '.' ELSE '' END AS note FROM (
    SELECT o_custkey AS g, list_sort(list(DISTINCT 'C' || (o_orderkey % 3)) FILTER (o_orderkey % 3 <> o_custkey % 3)) AS o FROM orders GROUP BY o_custkey)"""
)
def lineage_mismatches(spark, sf):
    """Towns that other adverts of one dwelling name."""
    town = lambda k: F.concat(F.lit("C"), (F.col(k) % 3).cast("string"))
    cities = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(town("o_orderkey")).alias("cities"))
    return cities.select("id", F.array_join(checks.lineage_verdict(town("id"), F.col("cities"))["notes"], " ").alias("note"))


@query("SELECT c_nationkey AS city_id, 'N' || c_nationkey AS city_name, round(avg(50 + c_custkey % 100 / 1000.0), 6) AS latitude FROM customer WHERE c_custkey % 6 > 0 GROUP BY c_nationkey HAVING count(*) >= 3")
def place_centres(spark, sf):
    c = F.col
    ads = read(spark, sf, "customer").select(c("c_nationkey").alias("city_id"), F.concat(F.lit("N"), c("c_nationkey").cast("string")).alias("city_name"), F.when(c("c_custkey") % 6 > 0, 50 + c("c_custkey") % 100 / 1000).otherwise(0.0).alias("latitude"), F.lit(20.0).alias("longitude"))
    return checks.place_centres(ads).select("city_id", "city_name", F.round("latitude", 6).alias("latitude"))


@query(
    """WITH u AS (SELECT p_size % 5 AS institution_id, 'town' || (p_size % 3) AS town_key, 'park' || (p_partkey % 4) AS investment_key, DATE '2024-01-01' + CAST(p_partkey % 30 AS INT) AS last_seen FROM part),
    g AS (SELECT *, last_seen < max(last_seen) OVER (PARTITION BY institution_id, town_key) - 3 AS gone FROM u)
    SELECT institution_id, investment_key, count(*) FILTER (NOT gone) AS listed, count(*) FILTER (gone) AS units_gone FROM g GROUP BY ALL"""
)
def investment_stats(spark, sf):
    """Units listed and gone by investment; gone is what the newest list of the developer in the town has no more."""
    c = F.col
    s = lambda k, n: F.concat(F.lit(k), n.cast("string"))
    u = read(spark, sf, "part").select(
        (c("p_size") % 5).alias("institution_id"), s("Town", c("p_size") % 3).alias("town"), F.lit(None).cast("string").alias("street"), s("Park", c("p_partkey") % 4).alias("investment"),
        F.date_add(F.lit("2024-01-01").cast("date"), (c("p_partkey") % 30).cast("int")).alias("last_seen"), F.lit("2024-01-01").cast("date").alias("first_seen"),
    )
    return developer.investments(developer.with_keys(u)).select("institution_id", "investment_key", "listed", "units_gone")


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, round(sum(o_totalprice), 2) AS cost_usd FROM orders")
def run_summary(spark, sf):
    r = read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"), F.col("o_totalprice").alias("cost_usd"))
    return enrich.run_summary(r).withColumn("cost_usd", F.round("cost_usd", 2))


@query(
    """SELECT d.doc_id AS id FROM documents d JOIN labels s ON s.doc_id = d.doc_id AND quality = 1 LEFT JOIN (SELECT doc_id, doc_id % 4 AS attempts, toxic FROM labels WHERE doc_id % 3 > 0) e ON e.doc_id = d.doc_id
    WHERE d.lang IN ('en', 'fr') AND (e.doc_id IS NULL OR (e.toxic = 1 AND attempts < 3) OR abs(n_chars - 1000) > 1000 * 0.5)"""
)
def evaluation_queue(spark, sf):
    """Adverts that passed screening and were never scored, failed and may be tried again, or whose price drifted."""
    c = F.col
    ads = read(spark, sf, "documents").select(c("doc_id").alias("id"), F.when(c("lang").isin("en", "fr"), "active").otherwise("outdated").alias("status"), c("n_chars").alias("price"), F.lit(NOW).alias("created_at"), F.lit(NOW).alias("modified_at"))
    labelled = read(spark, sf, "labels")
    passed = labelled.select(c("doc_id").alias("ad_id"), F.when(c("quality") == 1, "passed").otherwise("rejected").alias("status"))
    done = labelled.where("doc_id % 3 > 0").select(
        c("doc_id").alias("ad_id"), F.lit("v2").alias("prompt_version"), F.lit(NOW).alias("ad_modified_at"), F.when(c("toxic") == 1, "failed").otherwise("ok").alias("status"), (c("doc_id") % 4).alias("attempts"), F.lit(1000).alias("price_at_evaluation")
    )
    return enrich.to_evaluate(ads, done, "v2", 0.5, passed)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Blok' WHEN p_size % 3 = 1 THEN 'Odd one' END AS building, CASE WHEN p_size % 2 = 0 THEN 'Nie podano' ELSE 'Wtórny' END AS market, CASE WHEN p_size % 5 = 0 THEN 'balkon' ELSE 'x' END AS feature FROM part")
def code_labels(spark, sf):
    p, s = read(spark, sf, "part"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"),
        labels.code_label(F.when(s % 3 == 0, "BLOCK").when(s % 3 == 1, "ODD_ONE"), "building_types").alias("building"),
        labels.code_label(F.when(s % 2 == 0, "").otherwise("SECONDARY"), "markets").alias("market"),
        labels.label(F.when(s % 5 == 0, "balcony").otherwise("x")).alias("feature"),
    )


@query(
    r"""SELECT p_partkey AS id, replace(lower(p_name), ' ', '-') AS slug, trim(regexp_replace(regexp_replace('<p>' || p_name || '</p>  <b>x</b>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain, lower(p_name) AS last, 'part ' || upper(left(p_name, 1)) || substr(lower(p_name), 2) AS camel FROM part"""
)
def text_helpers(spark, sf):
    c = F.col("p_name")
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        text.slug(c).alias("slug"),
        text.plain_text(F.concat(F.lit("<p>"), c, F.lit("</p>  <b>x</b>"))).alias("plain"),
        text.last_segment(F.concat(F.lit("a/b/"), F.lower(c))).alias("last"),
        text.camel_words(F.concat(F.lit("part"), F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))).alias("camel"),
    )


@query(
    """SELECT p_partkey AS id, format('{:t }', CAST(p_retailprice * 1000 AS BIGINT)).replace(',', ' ') || ' zł' AS money, (CASE WHEN p_size < 20 THEN '-' WHEN p_size > 20 THEN '+' ELSE '' END) || replace(regexp_replace(CAST(round(abs(p_size - 20) / 5.0, 1) AS VARCHAR), '\\.0$', ''), '.', ',') || '%' AS pct FROM part"""
)
def money_and_percent(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), text.money((F.col("p_retailprice") * 1000).cast("long")).alias("money"), text.percent((F.col("p_size") - 20) / 5).alias("pct"))


@query(
    """SELECT doc_id, CASE WHEN len(words) <= 4 THEN array_to_string(words, ' ') ELSE array_to_string([words[1], words[1 + CAST(round_even((len(words) - 1) / 3.0, 0) AS INT)], words[1 + CAST(round_even((len(words) - 1) * 2 / 3.0, 0) AS INT)], words[-1]], ' ') END AS sample
    FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents WHERE text IS NOT NULL)"""
)
def evenly_spaced(spark, sf):
    """Four words of each text, evenly spaced."""
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ", -1).alias("words"))
    return d.select("doc_id", F.array_join(arrays.evenly(F.col("words"), 4), " ").alias("sample"))


@query("SELECT c_custkey AS id, c_custkey * 10 AS fit FROM customer WHERE c_custkey IN (3, 5, 9)")
def ranked_candidates(spark, sf):
    """Candidates by a model's scores: unknown ids dropped, of a repeated one the first kept."""
    said = [{"ad_id": 5, "fit_score": 50}, {"ad_id": -4, "fit_score": 99}, {"ad_id": 9, "fit_score": 90}, {"ad_id": 5, "fit_score": 1}, {"ad_id": 3, "fit_score": 30}]
    return assistant.ranked(spark, read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), said).select("id", F.col("fit_score").cast("long").alias("fit"))


@query(
    f"""SELECT id, CASE WHEN offer_type = 'SALE' THEN 'Kupno' ELSE 'Wynajem' END || ' ' || CASE WHEN object_type = 'HOUSE' THEN 'Dom' ELSE 'Mieszkanie' END AS kind,
    concat_ws(', ', district_name, city_name, province_name) AS address,
    concat_ws(', ', CAST(building_year AS VARCHAR), CASE building_type WHEN 'BLOCK' THEN 'Blok' WHEN 'LOFT' THEN 'Loft' END, CASE building_material WHEN 'BRICK' THEN 'Cegła' ELSE 'Drewno' END, CASE building_heating WHEN 'GAS' THEN 'Gazowe' ELSE 'Miejskie' END) AS building FROM {ROWS}"""
)
def candidate_cards(spark, sf):
    """What a reader is shown of each listing."""
    df = rows(spark, sf).withColumns({"street": F.lit(None).cast("string"), "features": F.array(F.lit("balcony"))})
    return documents.cards(df).select("id", "kind", "address", "building")


_IN = "least(latitude - s, s + 6e-2 - latitude, (longitude - w) * cos(radians(latitude)), (w + 8e-2 - longitude) * cos(radians(latitude))) * 111320"


@query(
    f"""SELECT id, CASE WHEN NOT held AND m > 100 THEN 'pin_outside_city' WHEN held AND m < 1000 THEN 'near_city_border' ELSE '' END AS flag, m AS border_m FROM (
    SELECT f.id, held, CAST(round_even(CASE WHEN held THEN {_IN} ELSE {_km_out('latitude', 'longitude', 's', 'w')} END, 0) AS INT) AS m FROM (SELECT f.*, b.*, latitude >= s AND latitude < s + 6e-2 AND longitude >= w AND longitude < w + 8e-2 AS held
    FROM {FLATS_SQL} f JOIN customer c ON c_custkey = f.id JOIN {_BOX} b ON b.n_nationkey = c_nationkey) f) t"""
)
def pin_verdicts(spark, sf):
    """What pins say against the town that an advert claims: here that of its customer's nation."""
    n = _squares(spark, sf)
    claims = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey")).join(n.select("n_nationkey", F.col("name").alias("city_name")), "n_nationkey")
    ads = flats(spark, sf).join(claims, "id").withColumn("province_code", F.lit(None).cast("string"))
    towns = n.select("name", F.lit("12").alias("province_code"), "sides", F.lit(100.0).alias("area_km2"))
    c = signals.pin_checks(ads, towns, towns.select("name", "sides"))
    v = checks.pin_verdict(F.lit("x"), F.col("claimed_is_town"), F.col("claimed_area_km2"), F.col("inside_claimed"), F.col("border_m"), F.col("pin_city_name"), F.col("pin_gmina_name"))
    return c.select("id", F.array_join(v["flags"], ",").alias("flag"), "border_m")


@query(
    f"""WITH l AS (SELECT s_suppkey % 2 AS k, 50e0 + s_suppkey * 7 % 30 / 1e2 AS la, 198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo FROM supplier),
    d AS (SELECT id, k, (lo - longitude) * cos(radians(latitude)) AS x1, la - latitude AS y1, 3e-2 * cos(radians(latitude)) AS dx, 1e-2 AS dy FROM {FLATS_SQL} f, l),
    e AS (SELECT id, k, sqrt(power(x1 + greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) * dx, 2) + power(y1 + greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) * dy, 2)) * 111320 AS m FROM d),
    n AS (SELECT id, round_even(min(m) FILTER (k = 0 AND m <= 1000), 0) AS x, round_even(min(m) FILTER (k = 1 AND m <= 500), 0) AS r FROM e GROUP BY id),
    w AS (SELECT 50.12 AS la, 19.95 AS lo, 1.0 AS e UNION ALL SELECT 50.12, 19.92, -1.0),
    p AS (SELECT DISTINCT id FROM (SELECT id, (longitude - lo) * 111320 * cos(radians(la)) * e AS along, abs((latitude - la) * 111320) AS aside FROM {FLATS_SQL} f, w) t WHERE along > 0 AND along <= 8000 AND aside <= 400 + along * 0.05)
    SELECT id, CASE WHEN x <= 300 THEN 'near_expressway,' ELSE '' END || CASE WHEN r <= 150 THEN 'near_railway,' ELSE '' END || CASE WHEN p.id IS NOT NULL THEN 'under_approach,' ELSE '' END AS flags
    FROM n LEFT JOIN p USING (id) WHERE x IS NOT NULL OR r IS NOT NULL OR p.id IS NOT NULL"""
)
def nuisance_flags(spark, sf):
    """Roads, railways and runways near flats, and what they say against them."""
    way = read(spark, sf, "supplier").selectExpr("s_suppkey", "50e0 + s_suppkey * 7 % 30 / 1e2 AS la", "198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo")
    pts = F.array(F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon")), F.struct((F.col("la") + 1e-2).alias("lat"), (F.col("lo") + 3e-2).alias("lon")))
    lines = way.select(F.when(F.col("s_suppkey") % 2 == 0, "expressway").otherwise("railway").alias("kind"), F.lit("A4").alias("label"), pts.alias("points"))
    runway = spark.createDataFrame([("runway", "EPKK", [(50.12, 19.92), (50.12, 19.95)])], "kind string, label string, points array<struct<lat: double, lon: double>>")
    n = signals.nuisances(flats(spark, sf), lines.unionByName(runway))
    v = checks.nuisance_verdict(F.col("expressway_m"), F.col("expressway_label"), F.col("railway_m"), F.col("approach_m"))
    return n.select("id", F.array_join(F.transform(v["flags"], lambda f: F.concat(f, F.lit(","))), "").alias("flags"))


@query(
    """WITH s AS (SELECT n_nationkey AS id, n_name AS name, 'q' || n_regionkey AS query FROM nation WHERE n_regionkey < 3),
    a AS (SELECT n_name AS name, 'new' AS query, n_nationkey AS asked FROM nation UNION ALL SELECT r_name, 'region', 100 + r_regionkey FROM region UNION ALL SELECT r_name, 'again', 200 + r_regionkey FROM region),
    f AS (SELECT * FROM a WHERE name NOT IN (SELECT name FROM s) QUALIFY row_number() OVER (PARTITION BY name ORDER BY asked) = 1),
    c AS (SELECT id, name, query FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY asked, name), name, query FROM f)
    SELECT id, name, query FROM c WHERE id % 7 <> 0"""
)
def saved_searches(spark, sf):
    """Searches of some nations are saved; all nations and, twice, all regions ask for more; some are deleted."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    saved = nation.where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("q"), F.col("n_regionkey").cast("string")).alias("query"))
    new = nation.selectExpr("n_name AS name", "'new' AS query", "n_nationkey AS at").unionByName(region.selectExpr("r_name AS name", "'region' AS query", "100 + r_regionkey AS at")).unionByName(region.selectExpr("r_name AS name", "'again' AS query", "200 + r_regionkey AS at"))
    kept, _ = merge.created_searches(saved, new)
    return merge.deleted_searches(kept, kept.where("id % 7 = 0"))[0]
