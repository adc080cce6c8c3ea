"""Joins and sums that do without all pairs or one task for a key, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plotline import session
from plotline.operators import history, merge, similar


def grams(text):
    words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_similar_texts(spark, least):
    rng = random.Random(1)
    words = ["kraków", "zielonki", "mieszkanie", "flat", "sunny", "x", "ab", "balkon", "balkony", "Balkon"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(120)]
    rows += [(500 + i, "the same text") for i in range(40)] + [(600, None), (601, ""), (602, "-- !"), (603, "THE SAME TEXT")]
    first = {}
    for i, t in rows:
        if t is not None and grams(t):
            first.setdefault(t.lower(), i)
    sets = sorted((i, grams(t)) for t, i in first.items())
    want = {(i, j): round(len(x & y) / len(x | y), 9) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if len(x & y) / len(x | y) >= least}
    got = similar.similar_texts(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", least).collect()
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == want and len(got) == len(want) > 0


@pytest.mark.parametrize("parts", [1, 3, 24])
def test_trailing_sums(spark, parts):
    """One hot key, ties, gaps, borders of buckets, nulls in key, time and value."""
    rng, start = random.Random(parts), dt.datetime(2024, 1, 1)
    rows = [(i, 1, start + dt.timedelta(minutes=rng.randrange(60 * 24 * 6)), rng.choice([None, 1, 2, 5])) for i in range(600)]
    rows += [(1000 + i, 2, start + dt.timedelta(hours=i), i) for i in range(60)] + [(1100, 2, start, 7), (1101, None, start, 3), (1102, None, start + dt.timedelta(hours=24), 4), (1103, 3, None, 8), (1104, 3, None, 9), (1105, 3, start, 1), (1106, 4, start, None)]
    df = spark.createDataFrame(rows, "id long, k int, at timestamp, v long")
    got = {r.id: r.trailing_sum for r in history.trailing_sum(df, "k", "at", "v", 24, parts).collect()}
    want = {}
    for i, k, at, _ in rows:
        held = [v for _, k2, at2, v in rows if k2 == k and v is not None and (at2 is None if at is None else at2 is not None and at - dt.timedelta(hours=24) <= at2 <= at)]
        want[i] = sum(held) if held else None
    assert got == want


def test_a_hot_key_is_dealt_over_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id"))).alias("at"), F.lit(1).alias("v"))
    plan = history.trailing_sum(df, "k", "at", "v", 24)._jdf.queryExecution().optimizedPlan().toString()
    over_key = [x for x in plan.splitlines() if "Window" in x and "_b" not in x.split("], [")[1]]
    assert not over_key  # every window over rows is by bucket; the one by key alone is over buckets' totals


def test_units_and_listings_alike_are_matched_once(spark):
    """Thirty thousand of each, alike in all that counts: 900 million pairs if they all met."""
    from plotline.operators import developer

    listings = spark.range(30_000).selectExpr("id", "'Town' AS town", "CAST(NULL AS STRING) AS street_key", "50.0D AS area", "2 AS rooms", "CAST(500000 AS BIGINT) AS price", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude")
    units = spark.range(30_000).selectExpr(
        "id + 7 AS id", "'Town' AS town", "CAST(NULL AS STRING) AS street", "'Park' AS investment", "50.0D AS area", "2 AS rooms", "CAST(500000 AS BIGINT) AS price", "CAST(NULL AS BIGINT) AS first_price", "CAST(NULL AS BIGINT) AS highest_price", "1 AS institution_id",
        "TIMESTAMP_NTZ '2024-01-01' AS first_seen", "TIMESTAMP_NTZ '2024-01-01' AS last_seen",
    )
    got = developer.matches(listings, developer.with_keys(units))
    assert got.groupBy("unit_id").count().collect() == [(7, 30_000)]


def test_previous_sale_over_whole_square_metres(spark):
    """Areas within the tolerance meet on either side of a whole square metre, and others of the place don't."""
    from datetime import datetime

    from plotline.operators import comparables

    kinds = "id long, {at} timestamp_ntz, price double, area double, rooms int, floor int, latitude double, longitude double"
    day = datetime(2020, 1, 1)
    listings = spark.createDataFrame([(i, datetime(2021, 1, 1), 5e5, a, None, None, 50.0 + i, 20.0) for i, a in enumerate((50.9, 51.1, 50.5, 20.1))], kinds.format(at="listed_at"))
    sales = spark.createDataFrame([(i, day, 4e5, a, None, None, 50.0 + i, 20.0) for i, a in enumerate((51.2, 50.8, 51.1, 19.85))], kinds.format(at="sold_at"))
    got = {r.id: r.area for r in comparables.previous_sale(listings, sales).collect()}
    assert got == {0: 51.2, 1: 50.8, 3: 19.85}
    plan = comparables.previous_sale(listings, sales)._jdf.queryExecution().optimizedPlan().toString()
    assert "_whole" in next(line for line in plan.splitlines() if "Join Inner" in line)


def test_texts_are_not_sent_to_all_tasks(spark):
    """Texts meet the places they name in a sorted join, however few of them there are."""
    from plotline.operators import checks

    ads = spark.createDataFrame([(1, 50.0, 20.0, "Kraków", "Działka w Zielonkach", "opis")], "id long, latitude double, longitude double, city_name string, title string, description string")
    centres = spark.createDataFrame([(2, "Zielonki", 50.01, 20.01)], "city_id long, city_name string, latitude double, longitude double")
    got = checks.place_verdicts(ads, centres)
    assert [r.id for r in got.collect()] == [1] and "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_deleted_parents_children_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks take a bounded number of rows, however well keys compress and however few partitions shuffles have."""
    monkeypatch.setattr(session, "TASK_ROWS", 1_000)
    child, gone = spark.range(20_000).selectExpr("id div 4 AS k", "id"), spark.range(0, 5_000, 2).withColumnRenamed("id", "parent")
    kept = merge.without(child, gone, "k", "parent")
    sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) >= 15 and max(sizes) < 1_500
    assert {r.k for r in kept.collect()} == set(range(1, 5_000, 2))


def stored(spark, path, df):
    df.write.parquet(f"{path}")
    return spark.read.parquet(f"{path}")


def test_stems_of_texts_are_not_sent_to_all_tasks(spark, tmp_path):
    """The listings' files are small: Spark would gather all stems of their texts, as it counts the bytes of the files."""
    from plotline.operators import checks

    ads = stored(spark, tmp_path / "ads", spark.range(50).selectExpr("id", "50.0D AS latitude", "20.0D AS longitude", "'Kraków' AS city_name", "IF(id % 2 = 0, 'Działka w Zielonkach', 'Działka') AS title", "'opis' AS description"))
    centres = spark.createDataFrame([(2, "Zielonki", 50.01, 20.01)], "city_id long, city_name string, latitude double, longitude double")
    got = checks.place_verdicts(ads, centres)
    assert {r.id for r in got.collect()} == set(range(0, 50, 2))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_in_nine_cells_are_not_sent_to_all_tasks(spark, tmp_path):
    """The listings' files are small: Spark would gather them in nine cells each, as it counts the bytes of the files."""
    from plotline.operators import comparables

    flats = stored(spark, tmp_path / "flats", spark.range(30).selectExpr("id", "TIMESTAMP_NTZ '2021-01-01' AS listed_at", "5e5D AS price", "50.5D AS area", "CAST(NULL AS INT) AS rooms", "CAST(NULL AS INT) AS floor", "50.0D + id AS latitude", "20.0D AS longitude"))
    sales = stored(spark, tmp_path / "sales", flats.drop("listed_at").withColumn("sold_at", F.expr("TIMESTAMP_NTZ '2020-01-01'")))
    got = comparables.previous_sale(flats, sales)
    assert {r.id for r in got.collect()} == set(range(30))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_units_that_score_too_little_ask_for_no_street(spark, monkeypatch):
    """Of two units of another street one has the listing's price; only its street is looked for, and its names are brought to it once it is chosen."""
    from plotline.operators import developer

    seen, nearest_line = [], developer.nearest_line
    monkeypatch.setattr(developer, "nearest_line", lambda asked, *a: seen.append([r.street_key for r in asked.select("street_key").collect()]) or nearest_line(asked, *a))
    listings = spark.range(1).selectExpr("id", "'Town' AS town", "'x' AS street_key", "50.05D AS area", "2 AS rooms", "CAST(500000 AS BIGINT) AS price", "50.0D AS latitude", "20.0D AS longitude")
    units = spark.range(2).selectExpr(
        "id + 7 AS id", "'Town' AS town", "concat('ul. Polna', id) AS street", "concat('Park', id) AS investment", "50.05D AS area", "2 AS rooms", "CAST(500000 + id * 400000 AS BIGINT) AS price", "CAST(NULL AS BIGINT) AS first_price", "CAST(NULL AS BIGINT) AS highest_price",
        "1 AS institution_id", "TIMESTAMP_NTZ '2024-01-01' AS first_seen", "TIMESTAMP_NTZ '2024-01-01' AS last_seen",
    )
    keyed = developer.with_keys(units)
    key = {r.id: r.street_key for r in keyed.collect()}
    streets = spark.createDataFrame([(key[7], [(50.0, 20.0), (50.0, 20.01)])], "street_key string, points array<struct<lat: double, lon: double>>")
    got = developer.matches(listings, keyed, streets).collect()
    assert seen == [[key[7]]] and [(r.unit_id, r.unit_investment) for r in got] == [(7, "Park0")]
