"""Map features, borders and the sale register: JSON and XML by a declared schema, shapes as arrays of points."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import road_label, street_key

#: What makes a road an expressway and a runway none.
EXPRESSWAYS = ["motorway", "trunk", "motorway_link", "trunk_link"]
UNPAVED = ["grass", "dirt", "ground", "gravel", "sand", "earth", "unpaved"]
RUNWAY_M = 1800
MARKETS = {"rynekWtorny": "SECONDARY", "rynekPierwotny": "PRIMARY"}

ELEMENTS = "struct<elements: array<struct<type: string, id: bigint, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>>>"
POINTS = "array<struct<lat: double, lon: double>>"


def elements(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """osm_id, tags, points of every way of Overpass answers."""
    e = F.col("e")
    tags = F.coalesce(e["tags"], F.from_json(F.lit("{}"), "map<string, string>"))
    return payloads.select(F.explode(F.from_json(json_col, ELEMENTS)["elements"]).alias("e")).select(e["id"].alias("osm_id"), tags.alias("tags"), F.coalesce(e["geometry"], F.array().cast(POINTS)).alias("points"))


def nuisance_features(ways: DataFrame) -> DataFrame:
    """osm_id, kind, label, points of expressways, railways and paved runways above ground."""
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    paved = ~F.coalesce(tag("surface").isin(UNPAVED), F.lit(False)) & (geo.line_length(F.col("points")) >= RUNWAY_M)
    kind = F.when(tag("aeroway") == "runway", F.when(paved, "runway")).when(tag("highway").isin(EXPRESSWAYS), "expressway").when(tag("railway") == "rail", "railway")
    label = F.when(F.col("kind") == "expressway", road_label(tag("ref"), tag("name"))).otherwise(F.coalesce(F.nullif(tag("name"), F.lit("")), tag("ref")))
    above = (F.size("points") >= 2) & F.coalesce(tag("tunnel") == "no", F.lit(True))
    return ways.where(above).withColumn("kind", kind).where("kind IS NOT NULL").select("osm_id", "kind", label.alias("label"), "points")


def named_streets(ways: DataFrame) -> DataFrame:
    """osm_id, name, street_key, points of streets with a telling name."""
    name = F.try_element_at(F.col("tags"), F.lit("name"))
    return ways.select("osm_id", name.alias("name"), street_key(name).alias("street_key"), "points").where("street_key IS NOT NULL AND size(points) >= 2")


def ring(pos_list: Column, lat_first: bool = True) -> Column:
    """A ring from a GML position list, two numbers a point."""
    n = F.transform(F.split(F.trim(pos_list), r"\s+"), lambda x: x.try_cast("double"))
    at = F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1)
    a, b = (0, 1) if lat_first else (1, 0)
    return F.transform(at, lambda i: F.struct(F.get(n, i * 2 + a).alias("lat"), F.get(n, i * 2 + b).alias("lon")))


def layer_parts(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """code, name, ring of the outer rings in border documents (WFS members). Members without a code, a name or a ring are left out."""
    member = F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<wfs:member\b[^>]*>(.*?)</wfs:member>"), F.lit(1))).alias("m")
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("m", rf"(?s)<ms:{name}\b[^>]*>(.*?)</ms:{name}>", 1)), F.lit(""))
    outer = F.regexp_extract_all("m", F.lit(r"(?s)<gml:exterior\b.*?<gml:posList\b[^>]*>(.*?)</gml:posList>"), F.lit(1))
    told = documents.select(member).select(tag("JPT_KOD_JE").alias("code"), tag("JPT_NAZWA_").alias("name"), F.explode(outer).alias("at"))
    return told.where("code IS NOT NULL AND name IS NOT NULL").select("code", "name", ring(F.col("at")).alias("ring"))


def areas(parts: DataFrame, gminas: DataFrame | None = None) -> DataFrame:
    """code, name, province_code, sides, area_km2 of areas from their parts (code, name, ring). Codes of a split city's parts are one by their first four digits.

    A city takes the name of its gmina where gminas (code, name) are given.
    """
    whole = parts.withColumn("code", F.when(F.length("code") > 4, F.substring("code", 1, 4)).otherwise(F.col("code"))) if gminas is not None else parts
    got = whole.groupBy("code").agg(F.min("name").alias("name"), F.collect_list("ring").alias("rings")).withColumns({"sides": geo.outer_sides(F.col("rings")), "area_km2": geo.rings_area_km2(F.col("rings"))})
    out = got.select("code", "name", F.substring("code", 1, 2).alias("province_code"), "sides", "area_km2")
    if gminas is None:
        return out
    named = gminas.groupBy("code").agg(F.min("name").alias("_g"))
    return out.join(named, "code", "left").withColumn("name", F.coalesce("_g", "name")).drop("_g")


def tiles(south: float, west: float, north: float, east: float, size: float) -> list[tuple[float, float, float, float]]:
    """The tiles of a box, from its first corner, those at its far sides cut."""
    rows, cols = math.ceil((north - south) / size), math.ceil((east - west) / size)
    return [(south + i * size, west + j * size, min(south + (i + 1) * size, north), min(west + (j + 1) * size, east)) for j in range(cols) for i in range(rows)]


def to_degrees(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the national grid (transverse Mercator, central meridian 19 E, scale 0.9993), by the inverse series."""
    a, f, k0, false_e, false_n, lon0 = 6378137.0, 1 / 298.257222101, 0.9993, 500_000.0, -5_300_000.0, math.radians(19)
    n = f / (2 - f)
    r = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (northing - false_n) / (k0 * r), (easting - false_e) / (k0 * r)
    x, e = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.lit(lon0) + F.atan2(F.sinh(e), F.cos(x)))


REGISTER = ["TERYT", "DOK_OZNACZENIE", "DOK_TWORCA", "TRAN_LOKALNY_ID_IIP", "TRAN_RODZAJ_RYNKU", "TRAN_RODZAJ_TRANS", "TRAN_CENA_BRUTTO", "LOK_FUNKCJA", "LOK_CENA_BRUTTO", "LOK_POW_UZYT", "LOK_POW_PRZYN", "LOK_LICZBA_IZB", "LOK_NR_KOND", "LOK_ADRES", "NIER_UDZIAL"]


def register_sales(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Flat sales of register documents (WFS members): typed columns, the position in degrees. Members without a date, position or id are left out."""
    member = F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<wfs:member\b[^>]*>(.*?)</wfs:member>"), F.lit(1))).alias("m")
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("m", rf"(?s)<ms:{name}\b[^>]*>(.*?)</ms:{name}>", 1)), F.lit(""))
    pos = F.split(F.trim(F.regexp_extract("m", r"(?s)<ms:GEOMETRIA\b.*?<gml:pos\b[^>]*>(.*?)</gml:pos>", 1)), r"\s+")
    day = F.regexp_extract("m", r"(?s)<ms:DOK_DATA\b.*?<gml:timePosition\b[^>]*>\s*(.*?)\s*</gml:timePosition>", 1)
    fid = F.regexp_extract("m", r'gml:id="[^"]*\.(\d+)"', 1)
    rows = documents.select(member).select(
        fid.try_cast("long").alias("id"), F.try_to_timestamp(F.substring(day, 1, 10)).alias("sold_at"), F.get(pos, F.lit(0)).try_cast("double").alias("northing"), F.get(pos, F.lit(1)).try_cast("double").alias("easting"), *(tag(n).alias(n) for n in REGISTER)
    )
    lat, lon = to_degrees(F.col("easting"), F.col("northing"))
    market = F.create_map(*(F.lit(x) for kv in MARKETS.items() for x in kv))
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    from ..functions.text import register_street

    return rows.where("id IS NOT NULL AND sold_at IS NOT NULL AND northing IS NOT NULL AND easting IS NOT NULL").select(
        "id",
        F.col("TERYT").alias("teryt"),
        "sold_at",
        F.coalesce("TRAN_LOKALNY_ID_IIP", F.concat_ws("|", "DOK_OZNACZENIE", F.col("sold_at").cast("date").cast("string"), "DOK_TWORCA")).alias("transaction_key"),
        F.try_element_at(market, F.col("TRAN_RODZAJ_RYNKU")).alias("market"),
        F.col("TRAN_RODZAJ_TRANS").alias("transaction_kind"),
        F.col("LOK_FUNKCJA").alias("function"),
        F.col("NIER_UDZIAL").alias("share"),
        number("TRAN_CENA_BRUTTO").alias("transaction_price"),
        number("LOK_CENA_BRUTTO").alias("unit_price"),
        number("LOK_POW_UZYT").alias("area"),
        F.col("LOK_LICZBA_IZB").try_cast("int").alias("rooms"),
        F.col("LOK_NR_KOND").try_cast("int").alias("floor"),
        F.col("LOK_ADRES").alias("address"),
        register_street(F.col("LOK_ADRES")).alias("street_key"),
        lat.alias("latitude"),
        lon.alias("longitude"),
    )


def refresh_due(loaded: DataFrame, at: str, now: Column, hours: float) -> bool:
    """Whether a table's newest load is older than allowed, or it is empty."""
    if hours <= 0:
        return False
    last = loaded.agg((F.max(at) <= now - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")).alias("due")).first()[0]
    return last is None or bool(last)
