"""Changes, states, windows and keyed tables over the driver's tables."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import arrays, rules
from ..functions.dates import whole_days
from ..operators import enrich, history, lineage, merge
from .registry import query
from .tables import read


@query(
    """SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WHERE value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE r = 1 OR p IS DISTINCT FROM event_type"""
)
def change_detection(spark, sf):
    return history.changes(read(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"], "value").select("event_id")


@query("SELECT c_custkey AS ad_id, CAST(c_acctbal AS DOUBLE) AS price FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def backfill_anti_join(spark, sf):
    ads = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price"), F.lit(datetime(2000, 1, 1)).alias("scraped_at"), F.lit(None).cast("timestamp").alias("modified_at"), F.lit(1.0).alias("area"), F.lit("active").alias("status"))
    return history.backfilled(ads, read(spark, sf, "orders").select(F.col("o_custkey").alias("ad_id"))).select("ad_id", "price")


_HALF = "SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events WHERE ts {0} TIMESTAMP '2024-01-16' GROUP BY user_id, event_type"


@query(
    f"""SELECT user_id, event_type, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(o.props, n.props) AS props
    FROM ({_HALF.format("<")}) o FULL JOIN ({_HALF.format(">=")} AND true) n USING (user_id, event_type)""".replace("GROUP BY user_id, event_type AND true", "GROUP BY user_id, event_type")
)
def keyed_upsert(spark, sf):
    e = read(spark, sf, "events")
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    half = lambda c: e.where(c).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max_by("props", "event_id").alias("props"))
    return merge.upsert(half(cut), half(~cut), ["user_id", "event_type"], ["value"], keep=["props"])


_LAST = "arg_max({0}, event_id) FILTER ({0} IS NOT NULL) AS {0}"


@query(f"SELECT user_id, min(event_id) AS first_id, {_LAST.format('click')}, {_LAST.format('bought')} FROM (SELECT *, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_type = 'purchase' THEN value END AS bought FROM events) GROUP BY user_id")
def last_state_fold(spark, sf):
    e = read(spark, sf, "events").withColumns({"click": F.when(F.col("event_type") == "click", F.col("value")), "bought": F.when(F.col("event_type") == "purchase", F.col("value"))})
    return history.last_state(e, "user_id", ["event_id"], ["click", "bought"]).withColumnRenamed("created_at", "first_id").drop("updated_at")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 20")
def ring_buffer(spark, sf):
    return merge.ring_buffer(read(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 20)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 4) AS trailing_sum FROM events")
def rolling_spend_24h(spark, sf):
    return history.trailing_sum(read(spark, sf, "events"), "user_id", "ts", "value", 24).select("event_id", F.round("trailing_sum", 4).alias("trailing_sum"))


@query(
    """SELECT o_orderkey, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = o_custkey % 50 AND l_shipdate < o_orderdate) AS previous_l_shipdate FROM orders"""
)
def asof_previous(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), F.col("o_orderdate").alias("at"))
    items = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at"), "l_shipdate").distinct()
    return history.as_of(o, items, "k", "at", ["l_shipdate"]).select("o_orderkey", "previous_l_shipdate")


@query(
    """WITH m AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderdate AS c, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 7 END AS owner, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 90 DAYS END AS e,
        CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders),
    ob AS (SELECT l_orderkey AS id, count(*) AS n, arg_min(CAST(floor(l_extendedprice) AS BIGINT), l_linenumber) AS f, min(CAST(floor(l_extendedprice) AS BIGINT)) AS lo, max(CAST(floor(l_extendedprice) AS BIGINT)) AS hi
        FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice) = 1) GROUP BY l_orderkey)
    SELECT g AS group_id, count(*) AS listings_count, count(*) FILTER (e IS NULL) AS active_listings_count, count(DISTINCT owner) + CASE WHEN bool_or(owner IS NULL) THEN 1 ELSE 0 END AS advertisers_count,
        greatest(CAST(floor(date_diff('second', min(c), CASE WHEN bool_or(e IS NULL) THEN TIMESTAMP '2000-01-01' ELSE max(e) END) / 86400.0) AS BIGINT), 0) AS days_on_market,
        arg_min(coalesce(f, p), (c, m.id)) AS first_price, min(coalesce(lo, p)) AS lowest_price, max(coalesce(hi, p)) AS highest_price
    FROM m LEFT JOIN ob ON ob.id = m.id GROUP BY g"""
)
def group_history(spark, sf):
    c = F.col
    members = read(spark, sf, "orders").select(
        c("o_orderkey").alias("id"),
        c("o_custkey").alias("group_id"),
        F.when(c("o_orderkey") % 13 != 0, c("o_orderkey") % 7).alias("owner_id"),
        c("o_orderdate").alias("created_at"),
        F.when(c("o_orderstatus") != "O", c("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("ended_at"),
        c("o_orderdate").alias("last_seen_at"),
        F.floor("o_totalprice").cast("long").alias("price"),
    )
    seen = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("ad_id"), c("l_linenumber").alias("observed_at")).agg(F.floor(F.min("l_extendedprice")).cast("long").alias("price"))
    return lineage.group_history(members, seen, F.lit(datetime(2000, 1, 1)).cast(dict(members.dtypes)["created_at"])).drop("first_listed_at")


@query(
    """SELECT user_id AS service, arg_max(event_type, ts) AS status, max(ts) AS updated_at, CASE WHEN max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 180 SECONDS THEN 'stale' ELSE 'alive' END AS liveness FROM events GROUP BY user_id"""
)
def status_liveness(spark, sf):
    beats = read(spark, sf, "events").select(F.col("user_id").alias("service"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    return history.heartbeats(beats, F.lit("2024-01-30").cast("timestamp"))


@query(
    """SELECT event_id, round(CASE WHEN event_type = 'view' THEN user_id * 1.0 / 1000000 + event_id * 5.0 / 1000000 WHEN event_type = 'click' THEN user_id * 3.0 / 1000000 + event_id * 15.0 / 1000000 END, 8) AS cost_usd FROM events"""
)
def cost_rollup(spark, sf):
    usage = read(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "view-20240101").otherwise(F.col("event_type")).alias("model"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"), F.lit(None).cast("int").alias("cache_read_tokens"), F.lit(None).cast("int").alias("cache_write_tokens"))
    prices = spark.createDataFrame([("view", 1.0, 5.0), ("click", 3.0, 15.0)], "model string, input_usd double, output_usd double")
    return enrich.costs(usage, prices).select("event_id", F.round("cost_usd", 8).alias("cost_usd"))


@query("SELECT user_id, greatest(CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0) AS BIGINT), 0) AS days FROM events GROUP BY user_id")
def elapsed_days(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(whole_days(F.min("ts"), F.max("ts")).alias("days"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 45 DAYS THEN o_orderdate
        WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS ended_at,
    CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 45 DAYS ELSE false END AS known FROM orders"""
)
def listing_end(spark, sf):
    o = read(spark, sf, "orders")
    kind = dict(o.dtypes)["o_orderdate"]
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "removed_by_user").otherwise("outdated")
    end = rules.listing_end(status, F.col("o_orderdate"), F.col("o_orderdate"), F.lit("1998-01-01").cast(kind))
    return o.select(F.col("o_orderkey").alias("id"), end.alias("e")).select("id", "e.ended_at", "e.known")


@query(
    """WITH s AS (SELECT l_suppkey % 10 AS institution_id, concat('u', CAST(l_partkey AS VARCHAR)) AS unit_key, l_shipdate AS day, min(CAST(floor(l_extendedprice / 1000) AS BIGINT)) AS price FROM lineitem GROUP BY 1, 2, 3)
    SELECT institution_id, unit_key, arg_max(price, day) AS price, arg_min(price, day) AS first_price, min(price) AS lowest_price, max(price) AS highest_price, min(day) AS first_seen, max(day) AS last_seen FROM s GROUP BY 1, 2"""
)
def price_list_snapshots(spark, sf):
    c = F.col
    s = read(spark, sf, "lineitem").select((c("l_suppkey") % 10).alias("institution_id"), F.concat(F.lit("u"), c("l_partkey").cast("string")).alias("unit_key"), c("l_shipdate").alias("day"), F.lit(50.0).alias("area"), F.floor(c("l_extendedprice") / 1000).cast("long").alias("price"), F.lit(1).alias("price_per_m2"))
    return merge.apply_snapshots(s)[0].drop("area")



@query("SELECT user_id, array_to_string(list(event_id ORDER BY event_id DESC), ',') AS ids FROM (SELECT * FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def event_list(spark, sf):
    from ..operators.documents import event_list as listed

    got = listed(read(spark, sf, "events").where("event_type = 'purchase'"), "user_id", "event_id", ["value"])
    return got.select("user_id", F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT doc_id, sha256(concat(coalesce(text, ''), chr(31), coalesce(lang, ''), chr(31), CAST(n_chars AS VARCHAR), chr(31))) AS fingerprint FROM documents")
def content_fingerprint(spark, sf):
    return read(spark, sf, "documents").select("doc_id", arrays.fingerprint(F.col("text"), F.col("lang"), F.col("n_chars")).alias("fingerprint"))
