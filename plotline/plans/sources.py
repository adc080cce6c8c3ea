"""Sources over files made of the driver's tables: each is written as text here and read by the source's own reader."""

from pyspark.sql import functions as F

from ..sources import geodata, payload, pricelists
from .registry import query
from .tables import read


@query("SELECT o_orderkey AS id, 'Advert ' || CAST(o_orderkey AS VARCHAR) AS title, o_orderdate AS created_at, CAST(round_even(floor(o_totalprice), 0) AS BIGINT) AS price, CAST(1 + o_orderkey % 4 AS INT) AS rooms, o_custkey AS owner_id FROM orders")
def listing_payloads(spark, sf):
    c = F.col
    s = lambda x: x.cast("string")
    item = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    ad = F.struct(
        c("o_orderkey").alias("id"),
        F.concat(F.lit("Advert "), s(c("o_orderkey"))).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.struct(c("o_custkey").alias("id")).alias("owner"),
        F.array(item("price", s(F.floor("o_totalprice"))), item("rooms_num", s(1 + c("o_orderkey") % 4))).alias("characteristics"),
    )
    page = F.concat(F.lit('<html><script type="application/json">'), F.to_json(F.struct(F.struct(F.struct(ad.alias("ad")).alias("pageProps")).alias("props"))), F.lit("</script></html>"))
    kind = dict(read(spark, sf, "orders").dtypes)["o_orderdate"]
    pages = read(spark, sf, "orders").select(payload.page_json(page).alias("json"), F.lit("x").alias("url"))
    return payload.listings(pages).select("id", "title", c("created_at").cast(kind).alias("created_at"), "price", "rooms", "owner_id")


@query(
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS file, 'Town' || CAST(p_size AS VARCHAR) AS town, 'L' || CAST(p_partkey AS VARCHAR) AS unit, CAST(300000 + p_partkey * 100 AS BIGINT) AS price, round_even(40 + p_partkey % 50 / 10.0, 2) AS area FROM part"""
)
def price_list_files(spark, sf):
    """Price lists in CSV, one file for each half of part, read back as units."""
    c = F.col
    s = lambda x: x.cast("string")
    area = F.replace(s(F.round(F.lit(40) + c("p_partkey") % 50 / 10.0, 2)), F.lit("."), F.lit(","))
    zloty = lambda x: F.concat(F.replace(F.format_number(x, 0), F.lit(","), F.lit(" ")), F.lit(" zł"))
    line = F.concat_ws(";", F.concat(F.lit("Town"), s(c("p_size"))), F.concat(F.lit("L"), s(c("p_partkey"))), zloty(300_000 + c("p_partkey") * 100), zloty(F.lit(9_000) + c("p_partkey") % 7), area)
    # the template's own columns: without a price for a square metre a sheet is not read by it
    head = "Miejscowość inwestycji;Nr lokalu nadany przez dewelopera;Cena lokalu;Cena m 2;Powierzchnia użytkowa"
    rows = read(spark, sf, "part").groupBy(F.when(c("p_partkey") % 2 == 0, "even").otherwise("odd").alias("file")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).cast("binary").alias("content"))
    return pricelists.units(pricelists.rows_of_files(rows.withColumn("format", F.lit("csv")))).select("file", "town", "unit", "price", "area")


@query("SELECT s_suppkey AS osm_id, CASE WHEN s_suppkey % 3 = 0 THEN 'expressway' ELSE 'railway' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN 'DK' || CAST(s_suppkey AS VARCHAR) ELSE 'line' END AS label FROM supplier WHERE s_suppkey % 3 <> 2")
def map_features(spark, sf):
    c = F.col
    s = lambda x: x.cast("string")
    road = F.create_map(F.lit("highway"), F.lit("trunk"), F.lit("ref"), s(c("s_suppkey")))
    rail = F.create_map(F.lit("railway"), F.lit("rail"), F.lit("name"), F.lit("line"))
    buried = F.create_map(F.lit("railway"), F.lit("rail"), F.lit("tunnel"), F.lit("yes"))
    pts = F.array(*(F.struct(F.lit(50.0 + i).alias("lat"), F.lit(20.0).alias("lon")) for i in (0, 1)))
    way = F.struct(c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 3 == 0, road).when(c("s_suppkey") % 3 == 1, rail).otherwise(buried).alias("tags"), pts.alias("geometry"))
    json = read(spark, sf, "supplier").select(F.to_json(F.struct(F.array(way).alias("elements"))).alias("json"))
    return geodata.nuisance_features(geodata.elements(json)).select("osm_id", "kind", "label")


@query("SELECT o_orderkey AS id, CAST(date_trunc('day', o_orderdate) AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'SECONDARY' ELSE 'PRIMARY' END AS market, CAST(o_custkey AS DOUBLE) AS area, 'krotka' AS street_key FROM orders")
def register_documents(spark, sf):
    c = F.col
    s = lambda x: x.cast("string")
    tag = lambda n, v: F.concat(F.lit(f"<ms:{n}>"), v, F.lit(f"</ms:{n}>"))
    xml = F.concat(
        F.lit('<wfs:member><ms:lokale gml:id="ms.lokale.'),
        s(c("o_orderkey")),
        F.lit('">'),
        tag("GEOMETRIA", F.lit('<gml:Point><gml:pos>240000 570000</gml:pos></gml:Point>')),
        tag("DOK_DATA", F.concat(F.lit("<gml:timePosition>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</gml:timePosition>"))),
        tag("TRAN_RODZAJ_RYNKU", F.when(c("o_orderkey") % 2 == 0, "rynekWtorny").otherwise("rynekPierwotny")),
        tag("LOK_POW_UZYT", s(c("o_custkey"))),
        tag("LOK_ADRES", F.lit("MSC:Miasto;UL:ul. Krótka;NR:1")),
        F.lit("</ms:lokale></wfs:member>"),
    )
    return geodata.register_sales(read(spark, sf, "orders").select(xml.alias("xml"))).select("id", c("sold_at").cast("date").alias("day"), "market", "area", "street_key")


@query("SELECT page_id FROM pages")
def archive_round_trip(spark, sf):
    """Payloads deflated and inflated again; those that come back changed would be left out."""
    json = F.to_json(F.struct("page_id", "url", "html"))
    df = read(spark, sf, "pages").select("page_id", "html", json.alias("json"))
    return df.withColumn("back", payload.inflated(payload.deflated(F.col("json")))).where(F.col("back").eqNullSafe(F.col("json")) & F.get_json_object("back", "$.html").eqNullSafe(F.col("html"))).select("page_id")
