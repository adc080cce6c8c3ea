"""Listing pages and result pages: JSON inside HTML, read with a declared schema; and the archive of compressed payloads."""

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_timestamp
from ..functions.numbers import lenient_float
from ..functions.rules import FLOOR_WORDS, rooms_number, word_number
from ..functions.text import last_segment

LISTING = """
struct<props: struct<pageProps: struct<
  ad: struct<id: bigint, publicId: string, slug: string, url: string, title: string, description: string, createdAt: string, modifiedAt: string,
    status: string, market: string, advertiserType: string, features: array<string>,
    characteristics: array<struct<key: string, value: string, localizedValue: string, currency: string>>,
    images: array<struct<large: string>>, owner: struct<id: bigint, name: string, type: string>,
    location: struct<coordinates: struct<latitude: double, longitude: double>,
      address: struct<street: struct<name: string, number: string>, city: struct<id: string, code: string, name: string>, district: struct<id: string, code: string, name: string>,
        county: struct<id: string, code: string, name: string>, province: struct<id: string, code: string, name: string>, postalCode: string>,
      reverseGeocoding: struct<locations: array<struct<id: string, name: string, locationLevel: string>>>>>,
  adTrackingData: struct<city_id: string, city_name: string, region_id: string, subregion_id: string>>>>
"""

RESULTS = """
struct<props: struct<pageProps: struct<data: struct<searchAds: struct<
  pagination: struct<totalPages: int, totalResults: int>,
  items: array<struct<id: bigint, href: string, title: string, slug: string, estate: string, transaction: string, isPrivateOwner: boolean, isPromoted: boolean,
    roomsNumber: string, floorNumber: string, areaInSquareMeters: double, createdAtFirst: string, pushedUpAt: string, totalPrice: struct<value: double, currency: string>,
    rentPrice: struct<value: double, currency: string>, pricePerSquareMeter: struct<value: double, currency: string>, investmentState: string, investmentUnitsNumber: int>>>>>>>
"""


def page_json(html: Column) -> Column:
    """The first JSON script of a page; null if it has none."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1), F.lit(""))


def characteristics(items: Column) -> Column:
    """A map of key to value; of a repeated key the last."""
    keys = F.array_distinct(F.transform(items, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(items, lambda x: x["key"] == k), -1)["value"]))


def listings(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """Adverts of listing pages. A page without an advert is a tombstone: its url, `gone` and nulls."""
    ad = pages.withColumn("_p", F.from_json(json_col, LISTING)["props"]["pageProps"]).withColumn("_a", F.col("_p.ad"))
    a, c = F.col("_a"), characteristics(F.col("_a.characteristics"))
    number = lambda k: lenient_float(F.try_element_at(c, F.lit(k)))
    text = lambda k: F.try_element_at(c, F.lit(k))
    rest = [x for x in pages.columns if x not in (json_col, "url")]
    return ad.select(
        *rest,
        F.coalesce(a["url"], F.col("url") if "url" in pages.columns else F.lit(None)).alias("url"),
        a.isNull().alias("gone"),
        a["id"].alias("id"),
        a["publicId"].alias("public_id"),
        a["slug"].alias("slug"),
        a["title"].alias("title"),
        a["description"].alias("description"),
        iso_timestamp(a["createdAt"]).alias("created_at"),
        iso_timestamp(a["modifiedAt"]).alias("modified_at"),
        a["status"].alias("status"),
        a["market"].alias("market"),
        a["advertiserType"].alias("advertiser_type"),
        a["owner"]["id"].alias("owner_id"),
        F.bround(number("price"), 0).cast("long").alias("price"),
        number("price_per_m").alias("price_per_m2"),
        number("m").alias("area"),
        number("rent").alias("rent"),
        number("rooms_num").cast("int").alias("rooms"),
        text("floor_no").alias("floor"),
        number("building_floors_num").cast("int").alias("building_floors"),
        number("build_year").cast("int").alias("building_year"),
        text("building_type").alias("building_type"),
        text("building_material").alias("building_material"),
        text("heating").alias("building_heating"),
        a["location"]["coordinates"]["latitude"].alias("latitude"),
        a["location"]["coordinates"]["longitude"].alias("longitude"),
        a["location"]["address"]["street"]["name"].alias("street"),
        F.transform(a["location"]["reverseGeocoding"]["locations"], lambda x: F.struct(x["locationLevel"].alias("level"), x["id"].alias("id"), x["name"].alias("name"))).alias("levels"),
        F.col("_p.adTrackingData.region_id").alias("region_id"),
        F.col("_p.adTrackingData.subregion_id").alias("subregion_id"),
        F.col("_p.adTrackingData.city_id").alias("tracked_city_id"),
        F.col("_p.adTrackingData.city_name").alias("tracked_city_name"),
        F.coalesce(a["features"], F.array().cast("array<string>")).alias("features"),
        F.coalesce(F.transform(a["images"], lambda i: i["large"]), F.array().cast("array<string>")).alias("images"),
    )


def results(pages: DataFrame, site: str, json_col: str = "json") -> DataFrame:
    """A row for each item of result pages, with the total of pages. site: what comes before a listing's slug."""
    found = pages.withColumn("_r", F.from_json(json_col, RESULTS)["props"]["pageProps"]["data"]["searchAds"])
    i = F.col("_i")
    only = lambda c: F.when(i["estate"] == "INVESTMENT", c)
    return found.select(F.col("_r.pagination.totalPages").alias("total_pages"), F.explode("_r.items").alias("_i")).select(
        i["id"].alias("id"),
        F.when(F.coalesce(i["href"], F.lit("")) != "", F.concat(F.lit(site), last_segment(i["href"]))).otherwise("").alias("url"),
        i["title"].alias("title"),
        i["slug"].alias("slug"),
        i["estate"].alias("estate"),
        i["transaction"].alias("transaction"),
        i["isPrivateOwner"].alias("is_private_owner"),
        rooms_number(i["roomsNumber"]).alias("rooms"),
        word_number(i["floorNumber"], FLOOR_WORDS, 0).alias("floor"),
        i["areaInSquareMeters"].alias("area"),
        i["totalPrice"]["value"].alias("price"),
        i["rentPrice"]["value"].alias("rent"),
        i["pricePerSquareMeter"]["value"].alias("price_per_m2"),
        iso_timestamp(i["createdAtFirst"]).alias("created_at"),
        iso_timestamp(i["pushedUpAt"]).alias("pushed_up_at"),
        only(i["investmentState"]).alias("investment_state"),
        only(i["investmentUnitsNumber"]).alias("investment_units"),
        "total_pages",
    )


def search_urls(base: str, **parts: list) -> list[str]:
    """The addresses of all combinations of query values, in their order."""
    from itertools import product
    from urllib.parse import urlencode

    return [f"{base}?{urlencode(dict(zip(parts, values)))}" for values in product(*parts.values())]


def deflated(c: Column) -> Column:
    """Compact JSON, compressed."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: zlib.compress(json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":")).encode(), 6), na_action="ignore")

    return run(c)


def inflated(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: zlib.decompress(b).decode(), na_action="ignore")

    return run(c)


def reparsed(archive: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adverts read again from the archive (key, payload) where a column now differs from what is stored."""
    again = listings(archive.select(F.col(key).alias("_k"), inflated(F.col("payload")).alias("json"), F.lit(None).cast("string").alias("url"))).where("NOT gone").select(F.col("_k").alias(key), *columns)
    old = stored.select(key, F.struct(*columns).alias("_old"))
    return again.join(old, key).where(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")
