"""Statistics, facets and set operations over the driver's tables."""

from pyspark.sql import functions as F

from ..functions.numbers import is_round
from ..operators import stats
from .registry import query
from .tables import read

_Q = "round(quantile_cont(o_totalprice, {p}), 4)"


@query(
    f"""SELECT c_nationkey, c_mktsegment, o_orderstatus, CAST(grouping(c_mktsegment) AS INT) AS is_coarse, count(*) AS n,
    {_Q.format(p=0.25)} AS p25_price, {_Q.format(p=0.5)} AS median_price, {_Q.format(p=0.75)} AS p75_price, round(quantile_cont(c_acctbal, 0.5), 4) AS median_area
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment, o_orderstatus), (c_nationkey, o_orderstatus))"""
)
def price_stats_grouping_sets(spark, sf):
    df = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    got = stats.price_stats(df, ["c_nationkey", "c_mktsegment", "o_orderstatus"], ["c_nationkey", "o_orderstatus"], "o_totalprice", "c_acctbal")
    return got.withColumns({c: F.round(c, 4) for c in ("p25_price", "median_price", "p75_price", "median_area")})


@query(
    f"""SELECT n_name, count(*) AS n, {", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))},
    round(avg(c_acctbal), 4) AS mean_score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 30"""
)
def district_stats_having(spark, sf):
    df = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    got = stats.district_stats(df, ["n_name"], "o_totalprice", "c_acctbal", 30)
    return got.withColumns({c: F.round(c, 4) for c in ("p10", "p25", "p50", "p75", "p90", "mean_score")})


@query(
    """SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
    UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size"""
)
def facet_counts(spark, sf):
    return stats.facet_counts(read(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query(
    """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
    SELECT CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'by size' WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'cheap' ELSE p_type END AS label, max(n) AS n FROM c GROUP BY 1"""
)
def facet_relabel_max(spark, sf):
    return stats.relabelled_facet(read(spark, sf, "part"), "p_type", {"by size": ("SMALL", "MEDIUM", "LARGE"), "cheap": ("ECONOMY", "PROMO")})


@query(" UNION ALL ".join(f"SELECT '{c}' AS facet, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def range_facets(spark, sf):
    return stats.ranges(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    """SELECT l_orderkey, "group", value, count(*) AS n FROM (SELECT l_orderkey, 'flag' AS "group", l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linestatus FROM lineitem) t
    GROUP BY l_orderkey, "group", value"""
)
def features_union_view(spark, sf):
    view = stats.union_view(read(spark, sf, "lineitem"), "l_orderkey", {"flag": "l_returnflag", "status": "l_linestatus"})
    return view.groupBy("l_orderkey", "group", "value").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def share_of_total(spark, sf):
    return stats.share_of_total(read(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 6))


@query(
    """SELECT round((c_acctbal + 5000) / 1000, 0) AS lat, round(c_nationkey / 4.0, 0) AS lon, count(*) AS n, round(avg(c_acctbal), 4) AS mean_price FROM customer GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def price_grid(spark, sf):
    df = read(spark, sf, "customer").select(((F.col("c_acctbal") + 5000) / 1000).alias("la"), (F.col("c_nationkey") / 4).alias("lo"), "c_acctbal")
    return stats.grid(df, "la", "lo", "c_acctbal", 0, 3).withColumn("mean_price", F.round("mean_price", 4))


@query(
    """SELECT CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1 WHEN o_totalprice < 350000 THEN 2 ELSE 3 END AS bucket, count(*) AS n, min(o_totalprice) AS least
    FROM orders GROUP BY 1 ORDER BY 3"""
)
def histogram_case(spark, sf):
    return stats.histogram(read(spark, sf, "orders"), "o_totalprice", [100_000, 200_000, 350_000])


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R', 'N') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def relational_division(spark, sf):
    return stats.relational_division(read(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "R", "N"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS multiplicity FROM lineitem WHERE l_orderkey IS NOT NULL")
def multiplicity_window(spark, sf):
    return stats.multiplicity(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT l_shipdate) AS n_l_shipdate FROM lineitem GROUP BY l_suppkey")
def multi_distinct_counts(spark, sf):
    return stats.distinct_counts(read(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"])


@query("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) >= 7")
def array_agg_distinct(spark, sf):
    return stats.collected(read(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", 7).select("l_suppkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("lines"))


@query(
    """WITH s AS (SELECT c_nationkey, c_mktsegment, CAST(grouping(c_mktsegment) AS INT) AS g, count(*) AS n, round(quantile_cont(c_acctbal, 0.5), 4) AS m FROM customer
        GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey)))
    SELECT c_custkey, coalesce(f.m, k.m) AS median_price, CASE WHEN f.m IS NOT NULL THEN 'fine' WHEN k.m IS NOT NULL THEN 'coarse' END AS level
    FROM customer c LEFT JOIN s f ON f.g = 0 AND f.n >= 12 AND f.c_nationkey IS NOT DISTINCT FROM c.c_nationkey AND f.c_mktsegment IS NOT DISTINCT FROM c.c_mktsegment
    LEFT JOIN s k ON k.g = 1 AND k.n >= 12 AND k.c_nationkey IS NOT DISTINCT FROM c.c_nationkey"""
)
def null_safe_stats_lookup(spark, sf):
    customer = read(spark, sf, "customer")
    s = stats.price_stats(customer, ["c_nationkey", "c_mktsegment"], ["c_nationkey"], "c_acctbal").withColumn("median_price", F.round("median_price", 4))
    return stats.null_safe_lookup(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), s, ["c_nationkey", "c_mktsegment"], ["c_nationkey"], "median_price", 12).select("c_custkey", "median_price", "level")


@query("SELECT p_partkey, round(p_size * 1000 / nullif(p_retailprice, 0), 6) AS value_score, p_retailprice = floor(p_retailprice) AS is_round FROM part")
def value_score(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(stats.value_score(F.col("p_size"), F.col("p_retailprice")), 6).alias("value_score"), is_round(F.col("p_retailprice")).alias("is_round"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def best_of_group(spark, sf):
    return stats.best_of(read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")])


@query("SELECT c_nationkey, c_mktsegment, CAST(grouping_id(c_nationkey, c_mktsegment) AS INT) AS level, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def cube_counts(spark, sf):
    return stats.cube_counts(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])
