"""Filling in an advert's place from the hints it carries and the places known already."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import synthetic_id
from ..functions.text import last_segment


def hints(ads: DataFrame) -> DataFrame:
    """id and codes, names and paths by level, from `levels` (array of struct level, id, name) and the tracking ids, which come first."""
    of = lambda level: F.get(F.filter("levels", lambda x: x["level"] == level), F.lit(0))
    none = lambda c: F.nullif(c, F.lit(""))
    v, c, d = of("voivodeship"), of("city_or_village"), of("district")
    return ads.select(
        "id",
        F.coalesce(none(F.col("region_id")), v["id"]).alias("province_code"),
        v["name"].alias("province_name"),
        none(F.col("subregion_id")).alias("county_code"),
        F.col("tracked_city_id").try_cast("long").alias("city_id"),
        F.coalesce(none(F.col("tracked_city_name")), last_segment(c["id"])).alias("city_code"),
        c["name"].alias("city_name"),
        c["id"].alias("city_path"),
        last_segment(d["id"]).alias("district_code"),
        d["name"].alias("district_name"),
        d["id"].alias("district_path"),
    )


def best_districts(usage: DataFrame) -> DataFrame:
    """city_id, district_code, district_id: of districts with one code in a city the one with most adverts. usage: city_id, code, district_id."""
    n = usage.groupBy("city_id", F.col("code").alias("district_code"), "district_id").agg(F.count("*").alias("n"))
    return n.groupBy("city_id", "district_code").agg(F.max_by("district_id", F.struct("n", -F.col("district_id"))).alias("district_id"))


def completed(hinted: DataFrame, provinces: DataFrame, counties: DataFrame, districts: DataFrame, usage: DataFrame) -> DataFrame:
    """hinted with province_id, county_id, city_id, district_id: a known id, else one made from the path.

    A district is known by its city and code, else by a code that only one district has and no city uses yet.
    """
    prov = provinces.groupBy(F.col("code").alias("province_code")).agg(F.max("id").alias("_p"))
    coun = counties.groupBy(F.col("code").alias("county_code")).agg(F.max("id").alias("_c"))
    best = best_districts(usage).withColumnRenamed("district_id", "_d")
    unique = districts.groupBy(F.col("code").alias("district_code")).agg(F.count("*").alias("n"), F.max("id").alias("_u")).where("n = 1").select("district_code", "_u")
    unused = unique.join(usage.select(F.col("district_id").alias("_u")).distinct(), "_u", "left_anti")
    city = F.coalesce("city_id", F.when(F.col("city_code").isNotNull(), synthetic_id("city", F.coalesce("city_path", "city_code"))))
    out = hinted.join(prov, "province_code", "left").join(coun, "county_code", "left").withColumn("city_id", city)
    out = out.join(best, ["city_id", "district_code"], "left").join(unused, "district_code", "left").join(unique.withColumnRenamed("_u", "_any"), "district_code", "left")
    known = F.coalesce("_d", "_u", F.when(F.col("city_id").isNull(), F.col("_any")))
    # one unused district serves one city: the first by id
    first = F.min("city_id").over(Window.partitionBy("_u"))
    known = F.when(F.col("_d").isNull() & F.col("_u").isNotNull() & F.col("city_id").isNotNull() & (F.col("city_id") != first), F.lit(None)).otherwise(known)
    made = F.when(F.col("district_code").isNotNull(), F.coalesce(known, synthetic_id("district", F.coalesce("district_path", "district_code"))))
    return out.withColumns(
        {
            "province_id": F.coalesce("_p", F.when(F.col("province_code").isNotNull(), synthetic_id("province", F.col("province_code")))),
            "county_id": F.coalesce("_c", F.when(F.col("county_code").isNotNull(), synthetic_id("county", F.col("county_code")))),
            "district_id": made,
        }
    ).drop("_p", "_c", "_d", "_u", "_any")
