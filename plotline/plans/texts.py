"""Text, number and array functions over the driver's tables."""

from pyspark.sql import functions as F

from ..functions import arrays, numbers, sketch, text
from ..operators import similar
from .registry import query
from .tables import read


@query("SELECT doc_id, length(strip_accents(lower(translate(text, 'łŁßẞæœøđðþı', '-----------')))) AS n, strip_accents(translate(lower(regexp_replace(text, '[^a-zA-ZàâçéèêëîïôûùüÿñæœäöüßÀÉÊÇáíóú ,.]', '', 'g')), 'ßæœ', '---')) AS plain FROM documents")
def normalize_name(spark, sf):
    c = F.col("text")
    kept = F.regexp_replace(c, "[^a-zA-ZàâçéèêëîïôûùüÿñæœäöüßÀÉÊÇáíóú ,.]", "")
    plain = text.normalize_name(F.translate(F.lower(kept), "ßæœ", "---"))
    n = F.length(text.normalize_name(F.translate(F.lower(F.translate(c, "łŁßẞæœøđðþı", "-----------")), "ł", "-")))
    return read(spark, sf, "documents").select("doc_id", n.alias("n"), plain.alias("plain"))


@query(
    r"""SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[0-9a-ząćęłńóśźż]+'), lambda x: length(x) >= 3))) AS INT) AS words FROM documents"""
)
def word_set_sizes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(sketch.word_set(F.col("text"))).alias("words"))


@query("SELECT event_id, round(user_id * 1.5 / 7, 4) AS parsed, CASE WHEN abs((value / 10 - 1) * 100) <= 999 THEN round_even((value / 10 - 1) * 100, 1) END AS pct FROM events WHERE value <> 0")
def parsed_numbers(spark, sf):
    said = F.concat(F.lit(" ca "), F.replace(F.round(F.col("user_id") * 1.5 / 7, 4).cast("string"), F.lit("."), F.lit(",")), F.lit(" zł"))
    return read(spark, sf, "events").where("value <> 0").select("event_id", numbers.lenient_float(said).alias("parsed"), numbers.change_pct(F.col("value"), F.lit(10.0)).alias("pct"))


@query("SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS a, CAST(floor(o_totalprice) AS BIGINT) AS b, round(o_totalprice, 2) AS c FROM orders")
def amounts(spark, sf):
    """Amounts written in three ways and read again."""
    p = F.col("o_totalprice")
    english, polish = F.format_number(p, 2), F.replace(F.format_number(F.floor(p), 0), F.lit(","), F.lit(" "))
    plain = F.replace(F.translate(F.format_number(p, 2), ",.", "_,"), F.lit("_"), F.lit("."))
    return read(spark, sf, "orders").select("o_orderkey", numbers.amount(english).alias("a"), numbers.amount(F.concat(polish, F.lit(" zł"))).alias("b"), numbers.amount(plain, False).alias("c"))


@query("SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS label, 'street' || CAST(p_size AS VARCHAR) AS k, lower(p_type) AS place FROM part")
def labels_and_keys(spark, sf):
    c = F.col
    return read(spark, sf, "part").select(
        "p_partkey",
        text.humanize(F.replace(c("p_name"), F.lit(" "), F.lit("_"))).alias("label"),
        text.street_key(F.concat(F.lit("ul. Wielka Street"), c("p_size").cast("string"))).alias("k"),
        text.place_name(F.concat(F.lit("Gmina  "), c("p_type"))).alias("place"),
    )


@query("SELECT n_nationkey, -CAST(('0x' || left(sha256('city:' || n_name), 15)) AS BIGINT) AS id FROM nation")
def synthetic_ids(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", arrays.synthetic_id("city", F.col("n_name")).alias("id"))


def _grams(c: str) -> str:
    words = f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))"


@query(
    f"""SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect({_grams('a.p_name')}, {_grams('b.p_name')})) / len(list_distinct(list_concat({_grams('a.p_name')}, {_grams('b.p_name')}))), 6) AS similarity
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""
)
def trigram_similarity(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.round(text.trigram_similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


_GOODS = "lower(concat_ws(' ', p_name, p_brand, p_type))"


@query(
    f"""WITH t AS (SELECT min(p_partkey) AS id, {_GOODS} AS x FROM part GROUP BY 2), g AS (SELECT id, unnest({_grams('x')}) AS gram FROM t), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, round(k / (x.n + y.n - k), 6) AS similarity FROM p JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE k / (x.n + y.n - k) >= 0.6"""
)
def trigram_join(spark, sf):
    """Descriptions of parts that are alike."""
    goods = read(spark, sf, "part").selectExpr("p_partkey", f"{_GOODS} AS goods")
    return similar.similar_texts(goods, "p_partkey", "goods", 0.6).withColumn("similarity", F.round("similarity", 6))


@query()
def html_plain_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'S7/DK52' WHEN event_type = 'view' THEN 'A4' ELSE 'main' END AS label FROM events")
def road_labels(spark, sf):
    ref = F.when(F.col("event_type") == "click", "S7; 52").when(F.col("event_type") == "view", "A4;A4;")
    return read(spark, sf, "events").select("event_id", text.road_label(ref, F.lit("main")).alias("label"))
