"""Spatial joins and comparisons over flats, sales and shapes made of the driver's tables."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import checks, comparables, developer, signals, spatial, stats
from .registry import query
from .tables import FLATS, FLATS_SQL, SALES_SQL, flats, made, read, sales

_D = "sqrt(power(({b}.latitude - {a}.latitude) * 111320, 2) + power(({b}.longitude - {a}.longitude) * 111320 * cos(radians(({a}.latitude + {b}.latitude) / 2)), 2))"
_DIST = _D.format(a="t", b="s")


def _rounds(targets: str, pool: str, least: int, kind: str, group: str) -> str:
    """Brute force: every pair, then the smallest radius with enough groups."""
    return f"""p AS (SELECT t.id, s.group_id, s.price_per_m2 AS price, {_DIST} AS d, s.id AS sid FROM {targets} t JOIN {pool} s
            ON {kind} AND {group} AND s.area >= t.area / 1.35 AND s.area <= t.area * 1.35 AND abs(s.latitude - t.latitude) < 0.1),
        g AS (SELECT id, group_id, arg_min(price, (d, sid)) AS price, min(d) AS d FROM p WHERE d <= 10000 GROUP BY id, group_id),
        r AS (SELECT g.id, radius, count(*) AS n, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM g, (VALUES (750), (1500), (3000), (6000), (10000)) v(radius)
            WHERE d <= radius GROUP BY g.id, radius HAVING count(*) >= {least}),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY radius) = 1)"""


_OUT = "id, n, CAST({r} AS INT) AS radius_m, CAST(round_even(m, 0) AS BIGINT) AS median, CAST(round_even(q1, 0) AS BIGINT) AS p25, CAST(round_even(q3, 0) AS BIGINT) AS p75"


@query(f"WITH {_rounds(FLATS_SQL, FLATS_SQL, 10, 't.kind IS NOT DISTINCT FROM s.kind', 't.group_id <> s.group_id')} SELECT {_OUT.format(r='radius')} FROM b")
def band_join_comparables(spark, sf):
    df = flats(spark, sf)
    return comparables.comparables(df, df)


_BY_MARKET = _rounds(FLATS_SQL, f"(SELECT *, -id AS group_id FROM {SALES_SQL})", 8, "t.market = s.market", "true")
_ANY_MARKET = _rounds(f"(SELECT * FROM {FLATS_SQL} WHERE id NOT IN (SELECT id FROM one))", f"(SELECT *, -id AS group_id FROM {SALES_SQL})", 8, "true", "true")


@query(f"WITH one AS MATERIALIZED (WITH {_BY_MARKET} SELECT * FROM b), two AS (WITH {_ANY_MARKET} SELECT * FROM b) SELECT {_OUT.format(r='radius')} FROM (SELECT * FROM one UNION ALL SELECT * FROM two)")
def market_then_any(spark, sf):
    t = flats(spark, sf).withColumn("kind", F.col("market"))
    return comparables.transactions(t, sales(spark, sf).withColumn("kind", F.col("market")))


@query(
    f"""WITH p AS (SELECT t.id, s.price_per_m2 AS price, s.market = t.market AS same FROM {FLATS_SQL} t JOIN {SALES_SQL} s ON t.street_key = s.street_key
        AND greatest(t.area, s.area) / least(t.area, s.area) <= 1.35 AND {_DIST} <= 1500),
    g AS (SELECT id, count(*) AS n, count(*) FILTER (same) AS k, quantile_cont(price, 0.5) AS a, quantile_cont(price, 0.5) FILTER (same) AS b FROM p GROUP BY id HAVING count(*) >= 3)
    SELECT id, CASE WHEN k >= 3 THEN k ELSE n END AS n, CAST(round_even(CASE WHEN k >= 3 THEN b ELSE a END, 0) AS BIGINT) AS median FROM g"""
)
def street_sales(spark, sf):
    return comparables.street_sales(flats(spark, sf), sales(spark, sf)).select("id", "n", "median")


@query(
    f"""WITH t AS (SELECT *, TIMESTAMP '1997-06-01' AS listed_at FROM {FLATS_SQL}),
    p AS (SELECT t.id, s.id AS sid, s.sold_at, s.price AS sale FROM t JOIN {SALES_SQL} s ON abs(s.area - t.area) <= greatest(t.area * 0.01, 0.3) + 1e-9 AND s.area >= t.area - greatest(t.area * 0.01, 0.3) AND s.area <= t.area + greatest(t.area * 0.01, 0.3)
        AND s.sold_at < t.listed_at AND s.price / t.price BETWEEN 0.35 AND 2.0 AND abs(s.latitude - t.latitude) < 0.01 AND {_DIST} <= 150 WHERE t.area <> floor(t.area)),
    g AS (SELECT id, count(*) AS n, max_by(struct_pack(a := sold_at, p := sale), (sold_at, -sid)) AS b FROM p GROUP BY id HAVING count(*) <= 2)
    SELECT id, b.a AS sold_at, CAST(round_even(b.p, 0) AS BIGINT) AS price FROM g"""
)
def previous_sale(spark, sf):
    s = sales(spark, sf)
    at = F.lit(datetime(1997, 6, 1)).cast(dict(s.dtypes)["sold_at"])
    t = flats(spark, sf).select("id", at.alias("listed_at"), "price", "area", F.lit(None).cast("int").alias("rooms"), F.lit(None).cast("int").alias("floor"), "latitude", "longitude")
    return comparables.previous_sale(t, s.select("id", "sold_at", "price", "area", "rooms", F.lit(None).cast("int").alias("floor"), "latitude", "longitude")).select("id", "sold_at", "price")


@query(f"SELECT t.id, arg_min(s.id, (round({_DIST}, 4), s.id)) AS nearest FROM {FLATS_SQL} t JOIN {SALES_SQL} s ON {_DIST} <= 2000 GROUP BY t.id")
def nearest_within(spark, sf):
    """The sale nearest to each flat."""
    return spatial.nearest(flats(spark, sf), sales(spark, sf).withColumnRenamed("id", "nearest"), 2000, "id", ["nearest"]).select("id", "nearest")


#: Of the flats one in fifty lies far from all sales.
_FAR = "latitude + CASE WHEN id % 50 = 0 THEN 5e0 ELSE 0e0 END"


@query(
    f"""WITH t AS (SELECT id, {_FAR} AS latitude, longitude FROM {FLATS_SQL}), p AS (SELECT t.id, s.id AS nearest, row_number() OVER (PARTITION BY t.id ORDER BY {_DIST}, s.id) AS rank FROM t CROSS JOIN {SALES_SQL} s)
    SELECT id, CAST(rank AS INT) AS rank, nearest FROM p WHERE rank <= 10"""
)
def k_nearest_sales(spark, sf):
    """The ten sales nearest to each flat, wherever it is."""
    at = flats(spark, sf).selectExpr("id", f"{_FAR} AS latitude", "longitude")
    return spatial.k_nearest(at, sales(spark, sf).withColumnRenamed("id", "nearest"), 10, "id", "nearest").select("id", "rank", "nearest")


def _squares(spark, sf):
    """One square for each nation, in a row of five; its parts share a side."""
    n = read(spark, sf, "nation").selectExpr("n_nationkey", "n_name AS name", "50e0 + (n_nationkey % 5) * 6e-2 AS s", "198e-1 + floor(n_nationkey / 5) * 8e-2 AS w")
    p = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    s, w = F.col("s"), F.col("w")
    n2, m, e = s + 0.06, w + 0.04, w + 0.08
    rings = F.array(F.array(p(s, w), p(s, m), p(n2, m), p(n2, w), p(s, w)), F.array(p(s, m), p(s, e), p(n2, e), p(n2, m), p(s, m)))
    return n.select("n_nationkey", "name", "s", "w", rings.alias("rings"), geo.outer_sides(rings).alias("sides"))


@query(f"SELECT t.id, name FROM {FLATS_SQL} t JOIN (SELECT n_name AS name, 50e0 + (n_nationkey % 5) * 6e-2 AS s, 198e-1 + floor(n_nationkey / 5) * 8e-2 AS w FROM nation) n ON latitude >= s AND latitude < s + 6e-2 AND longitude >= w AND longitude < w + 8e-2")
def containing_area(spark, sf):
    return spatial.containing(flats(spark, sf), _squares(spark, sf).select("name", "sides"), "id", ["name"])


@query(
    f"""SELECT id, latitude >= s AND latitude < s + 6e-2 AND longitude >= w AND longitude < w + 8e-2 AS inside_claimed FROM (SELECT f.*, s, w FROM (SELECT {", ".join(f"{e} AS {k}" for k, e in FLATS.items())}, c_nationkey FROM customer) f
    JOIN (SELECT n_nationkey, 50e0 + (n_nationkey % 5) * 6e-2 AS s, 198e-1 + floor(n_nationkey / 5) * 8e-2 AS w FROM nation) n ON n_nationkey = c_nationkey)"""
)
def pin_checks(spark, sf):
    n = _squares(spark, sf)
    named = made(spark, sf, "customer", FLATS | {"n_nationkey": "c_nationkey"}).join(n.select("n_nationkey", F.col("name").alias("city_name")), "n_nationkey")
    towns = n.select("name", F.lit("12").alias("province_code"), "sides", geo.rings_area_km2(F.col("rings")).alias("area_km2"))
    return signals.pin_checks(named.withColumn("province_code", F.lit(None).cast("string")), towns, towns.select("name", "sides")).select("id", "inside_claimed")


@query(
    f"""WITH l AS (SELECT s_suppkey AS line, 50e0 + s_suppkey * 7 % 30 / 1e2 AS la, 198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo FROM supplier),
    d AS (SELECT id, line, latitude, (lo - longitude) * cos(radians(latitude)) AS x1, la - latitude AS y1, 3e-2 * cos(radians(latitude)) AS dx, 1e-2 AS dy FROM {FLATS_SQL}, l),
    e AS (SELECT id, line, sqrt(power(x1 + greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) * dx, 2) + power(y1 + greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) * dy, 2)) * 111320 AS m FROM d)
    SELECT id, CAST(round_even(min(m), 0) AS INT) AS metres FROM e WHERE m <= 800 GROUP BY id"""
)
def nearest_line(spark, sf):
    lines = read(spark, sf, "supplier").selectExpr("s_suppkey AS line", "50e0 + s_suppkey * 7 % 30 / 1e2 AS la", "198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo")
    pts = F.array(F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon")), F.struct((F.col("la") + 1e-2).alias("lat"), (F.col("lo") + 3e-2).alias("lon")))
    got = spatial.nearest_line(flats(spark, sf), lines.select("line", pts.alias("points")), 800, "id", ["line"])
    return got.select("id", F.bround("distance_m", 0).cast("int").alias("metres"))


@query(
    f"""WITH l AS (SELECT concat('street', CAST(s_suppkey % 29 AS VARCHAR)) AS street, 50e0 + s_suppkey * 7 % 30 / 1e2 AS la, 198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo FROM supplier),
    d AS (SELECT id, latitude, (lo - longitude) * cos(radians(latitude)) AS x1, la - latitude AS y1, 3e-2 * cos(radians(latitude)) AS dx, 1e-2 AS dy FROM {FLATS_SQL} JOIN l ON street = street_key),
    e AS (SELECT id, sqrt(power(x1 + greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) * dx, 2) + power(y1 + greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) * dy, 2)) * 111320 AS m FROM d),
    n AS (SELECT id, CAST(round_even(min(m), 0) AS INT) AS metres FROM e WHERE m <= 15000 GROUP BY id)
    SELECT id, metres, CASE WHEN metres BETWEEN 1000 AND 15000 THEN 'pin_far_from_street' ELSE '' END AS flag FROM n"""
)
def own_street(spark, sf):
    """How far each flat lies from the street of its own name, and what is said of one that lies far off."""
    lines = read(spark, sf, "supplier").selectExpr("concat('street', CAST(s_suppkey % 29 AS STRING)) AS street_key", "50e0 + s_suppkey * 7 % 30 / 1e2 AS la", "198e-1 + s_suppkey * 11 % 40 / 1e2 AS lo")
    pts = F.array(F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon")), F.struct((F.col("la") + 1e-2).alias("lat"), (F.col("lo") + 3e-2).alias("lon")))
    got = spatial.nearest_line(flats(spark, sf), lines.select("street_key", pts.alias("points")), checks.STREET_BEYOND_M, "id", ["street_key"], ["street_key"])
    metres = F.bround("distance_m", 0).cast("int")
    return got.select("id", metres.alias("metres"), F.array_join(checks.street_verdict(F.col("street_key"), metres)["flags"], ",").alias("flag"))


@query(
    f"""WITH r AS (SELECT 50.12 AS la, 19.95 AS lo, 1.0 AS e, 0.0 AS n UNION ALL SELECT 50.12, 19.92, -1.0, 0.0),
    d AS (SELECT id, (longitude - lo) * 111320 * cos(radians(la)) * e AS along, abs((latitude - la) * 111320 * e) AS aside FROM {FLATS_SQL}, r)
    SELECT id, CAST(round_even(min(along), 0) AS INT) AS approach_m FROM d WHERE along > 0 AND along <= 8000 AND aside <= 400 + along * 0.05 GROUP BY id"""
)
def runway_approach(spark, sf):
    runways = spark.createDataFrame([("a", [(50.12, 19.92), (50.12, 19.95)])], "label string, points array<struct<lat: double, lon: double>>")
    return spatial.beyond_runways(flats(spark, sf), runways, "id").select("id", "approach_m")


_UNITS = "SELECT p_partkey AS id, concat('Town', CAST(p_size % 3 AS VARCHAR(5))) AS town, 3e1 + p_partkey % 200 / 1e1 AS area, CAST(1 + p_partkey % 3 AS INT) AS rooms, CAST(300000 + p_partkey % 17 * 20000 AS BIGINT) AS price, p_partkey % 4 AS inst FROM part"
_WANTED = "SELECT c_custkey AS id, concat('town', CAST(c_custkey % 3 AS VARCHAR(5))) AS town, 3e1 + c_custkey % 200 / 1e1 AS area, CAST(1 + c_custkey % 3 AS INT) AS rooms, CAST(300000 + c_custkey % 13 * 20000 AS BIGINT) AS price FROM customer"


@query(
    f"""WITH u AS ({_UNITS}), t AS ({_WANTED}),
    s AS (SELECT t.id, u.id AS uid, u.inst, u.price AS up, t.price AS tp, abs(t.price - u.price) / u.price AS off, CASE WHEN t.rooms = u.rooms THEN 1 ELSE -2 END AS r FROM t JOIN u ON lower(t.town) = lower(u.town) AND u.area BETWEEN t.area - 0.05 AND t.area + 0.05),
    k AS (SELECT *, CASE WHEN off > 0.15 THEN 0 ELSE CASE WHEN off <= 0.01 THEN 2 WHEN off <= 0.05 THEN 1 ELSE 0 END + r END AS score FROM s),
    b AS (SELECT * FROM k WHERE score >= 2 QUALIFY score = max(score) OVER (PARTITION BY id)),
    f AS (SELECT *, first(up) OVER w AS fp, first(inst) OVER w AS fi, first(uid) OVER w AS fu FROM b WINDOW w AS (PARTITION BY id ORDER BY abs(up - tp), uid))
    SELECT id, any_value(fu) AS unit_id FROM f GROUP BY id HAVING NOT bool_or(abs(up - fp) > fp * 0.01 OR inst <> fi)"""
)
def ambiguity_cutoff_match(spark, sf):
    day = F.lit(datetime(2024, 1, 1))
    u = spark_sql_units(spark, sf).withColumns(
        {"institution_id": F.col("inst"), "street": F.lit(None).cast("string"), "investment": F.lit("Park"), "first_price": F.lit(None).cast("long"), "highest_price": F.lit(None).cast("long"), "first_seen": day, "last_seen": day}
    )
    t = read(spark, sf, "customer").selectExpr("c_custkey AS id", "concat('town', CAST(c_custkey % 3 AS VARCHAR(5))) AS town", "3e1 + c_custkey % 200 / 1e1 AS area", "CAST(1 + c_custkey % 3 AS INT) AS rooms", "CAST(300000 + c_custkey % 13 * 20000 AS BIGINT) AS price")
    t = t.withColumns({"street_key": F.lit(None).cast("string"), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    return developer.matches(t, developer.with_keys(u)).select("id", "unit_id")


def spark_sql_units(spark, sf):
    return read(spark, sf, "part").selectExpr(
        "p_partkey AS id", "concat('Town', CAST(p_size % 3 AS VARCHAR(5))) AS town", "3e1 + p_partkey % 200 / 1e1 AS area", "CAST(1 + p_partkey % 3 AS INT) AS rooms", "CAST(300000 + p_partkey % 17 * 20000 AS BIGINT) AS price", "p_partkey % 4 AS inst"
    )


@query(f"SELECT round(min(latitude) - 1e-2, 8) AS south, round(min(longitude) - 1e-2, 8) AS west, round(max(latitude) + 1e-2, 8) AS north, round(max(longitude) + 1e-2, 8) AS east FROM {FLATS_SQL}")
def city_bounds(spark, sf):
    got = stats.bounds(flats(spark, sf), "latitude", "longitude", 0.01)
    return got.select(*(F.round(c, 8).alias(c) for c in got.columns))
