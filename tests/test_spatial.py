"""Covers of areas, the nearest k and comparisons against plain loops; percentiles by selection against those Spark takes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.functions import geo
from plotline.operators import comparables, cover, spatial, stats


def metres(a, b):
    y, x = (b[0] - a[0]) * 111_320, (b[1] - a[1]) * 111_320 * math.cos(math.radians((a[0] + b[0]) / 2))
    return math.sqrt(y * y + x * x)


@pytest.mark.parametrize("k", [1, 10, 50])
def test_k_nearest(spark, k):
    """Dense and empty places, positions alike, some missing, and one at the other end of the earth."""
    rng = random.Random(k)
    right = [(i, 50 + rng.gauss(0, 0.01), 20 + rng.gauss(0, 0.01)) for i in range(300)] + [(300 + i, rng.uniform(30, 70), rng.uniform(-20, 60)) for i in range(60)] + [(400 + i, 50.0, 20.0) for i in range(20)] + [(500, None, 1.0), (501, 0.0, 0.0)]
    left = [(i, 50 + rng.gauss(0, 0.02), 20 + rng.gauss(0, 0.02)) for i in range(60)] + [(100 + i, rng.uniform(-60, 80), rng.uniform(-170, 170)) for i in range(30)] + [(200, -45.0, -160.0), (201, 50.0, 20.0), (202, None, None), (203, 89.0, 10.0)]
    kinds = "id long, latitude double, longitude double"
    got = spatial.k_nearest(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds).withColumnRenamed("id", "other"), k, "id", "other").collect()
    known = [r for r in right if r[1]]
    want = {}
    for i, *at in left:
        if at[0]:
            for rank, (d, o) in enumerate(sorted((metres(at, r[1:]), r[0]) for r in known)[:k], 1):
                want[i, rank] = (o, round(d, 4))
    assert {(r.id, r.rank): (r.other, round(r.distance_m, 4)) for r in got} == want
    few = spatial.k_nearest(spark.createDataFrame(left[:3], kinds), spark.createDataFrame(right[:2], kinds).withColumnRenamed("id", "other"), k, "id", "other")
    assert few.count() == 3 * min(k, 2)


def star(n, seed, lat, lon, size):
    """A border that goes in and out, of n sides."""
    rng = random.Random(seed)
    at = [(lat + size * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * i / n), lon + size * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * i / n)) for i in range(n)]
    return [*at, at[0]]


def test_cover_of_ragged_areas(spark):
    rings = {"a": [star(900, 1, 50.1, 19.9, 0.5)], "b": [star(40, 2, 50.6, 20.9, 0.3), star(40, 3, 50.6, 20.9, 0.1)], "c": [star(7, 4, -33.1, -70.2, 2.0)]}
    areas = spark.createDataFrame(list(rings.items()), "name string, rings array<array<struct<lat: double, lon: double>>>").select("name", geo.outer_sides(F.col("rings")).alias("sides"))
    rng = random.Random(9)
    at = [(i, rng.uniform(49.5, 50.9), rng.uniform(19.3, 21.3)) for i in range(3000)] + [(5000 + i, rng.uniform(-35.2, -31), rng.uniform(-72.3, -68)) for i in range(500)]
    df = spark.createDataFrame(at, "id long, latitude double, longitude double")
    plain = df.join(areas, geo.inside(F.col("sides"), F.col("latitude"), F.col("longitude"))).groupBy("id").agg(F.min("name").alias("name"))
    want = {r.id: r.name for r in plain.collect()}
    assert {r.id: r.name for r in spatial.containing(df, areas, "id", ["name"]).collect()} == want and set(want.values()) == set(rings)


def test_a_long_border_is_copied_little():
    n = 50_000
    ring = np.array([(50 + (0.8 + 0.01 * math.sin(40 * t)) * math.sin(t), 20 + (1.1 + 0.01 * math.sin(40 * t)) * math.cos(t)) for t in np.linspace(0, 2 * math.pi, n)])
    sides = np.stack([ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]])
    cells = cover.cells_of(sides)
    held = sum(len(c[-1]) for c in cells)
    whole = [cover.SIZES[c[0]] for c in cells if c[3]]
    assert held < 2 * n and max(whole) > min(whole) and len(cells) < n / 2
    area = sum(s * s for s in whole) + sum(cover.SIZES[c[0]] ** 2 for c in cells if not c[3]) / 2
    assert abs(area - math.pi * 0.8 * 1.1) < 0.02


def test_comparables_against_plain_loops(spark):
    """Dense and sparse places, relistings, unknown kinds, own groups; markets else any market."""
    rng = random.Random(4)

    def flat(i, spread):
        return (i, rng.randrange(60), rng.choice(["a", "b", None]), 50 + rng.gauss(0, spread), 20 + rng.gauss(0, spread), rng.uniform(30, 120), float(rng.randrange(5000, 20000)))

    rows = [flat(i, 0.002) for i in range(250)] + [flat(300 + i, 0.1) for i in range(150)]
    rows += [(600 + i, *r[1:6], r[6] + i) for i, r in enumerate(rows[:80])] + [(900, 5, "a", None, 20.0, 50.0, 9000.0), (901, 5, "a", 51.5, 22.0, 50.0, 9000.0)]
    df = spark.createDataFrame(rows, "id long, group_id long, kind string, latitude double, longitude double, area double, price_per_m2 double")

    def quartile(values, q):
        x = (len(values) - 1) * q
        low, part = int(x), x - int(x)
        return round(values[low] if part == 0 else (1 - part) * values[low] + part * values[low + 1])

    def search(t, of, least):
        near = {}
        for o in of:
            d = metres(t[3:5], o[3:5])
            if t[5] / 1.35 <= o[5] <= t[5] * 1.35 and (o[1] not in near or (d, o[0]) < near[o[1]][:2]):
                near[o[1]] = (d, o[0], o[6])
        for radius in comparables.RADII_M:
            prices = sorted(p for d, _, p in near.values() if d <= radius)
            if len(prices) >= least:
                return (len(prices), radius, *(quartile(prices, q) for q in (0.5, 0.25, 0.75)))
        return None

    known = [r for r in rows if r[3]]
    want = {t[0]: s for t in known if (s := search(t, [o for o in known if o[2] == t[2] and o[1] != t[1]], 10))}
    assert {r.id: tuple(r)[1:] for r in comparables.comparables(df, df).collect()} == want
    assert {v[1] for v in want.values()} >= {750, 10000}
    single = [(r[0], -r[0], *r[2:]) for r in known]
    want = {}
    for t in known:
        s = search(t, [o for o in single if o[2] == t[2]], 8) or search(t, single, 8)
        if s:
            want[t[0]] = s
    assert {r.id: tuple(r)[1:] for r in comparables.transactions(df, df).collect()} == want


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_by_selection(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [("hot", "x", float(rng.randrange(2000))) for _ in range(20_000)] + [("hot", None, rng.gauss(0, 1)) for _ in range(3000)] + [(None, "x", 1.5), (None, "x", None), ("few", "y", 1.0), ("few", "y", 2.0), ("none", "z", None)] + [("ties", "x", 7.0)] * 500
    df = spark.createDataFrame(rows, "a string, b string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.a, r.b): (r.n, r.q) for r in stats.selected_percentiles(df, ["a", "b"], "v", shares, accuracy).collect()}
    want = {(r.a, r.b): (r.n, r.q) for r in df.where("v IS NOT NULL").groupBy("a", "b").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(n == got[k][0] and np.allclose(q, got[k][1], atol=1e-9) for k, (n, q) in want.items())


def test_price_stats_of_large_groups(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice(["x", None]), rng.random(), rng.choice([None, 1.0, 2.5])) for _ in range(700)], "city string, district string, price double, area double")
    plain = lambda at_once: sorted(map(str, stats.price_stats(df, ["city", "district"], ["city"], "price", "area", at_once).withColumns({c: F.round(c, 9) for c in ("p25_price", "median_price", "p75_price")}).collect()))
    assert plain(0) == plain(1000)
    some = lambda at_once: sorted(map(str, stats.district_stats(df, ["city"], "price", "area", 30, at_once).withColumns({c: F.round(c, 9) for c in ("p10", "p50", "p90", "mean_score")}).select("city", "n", "p10", "p50", "p90", "mean_score").collect()))
    assert some(0) == some(1000)


def test_nearest_by_tiles_with_empty_and_far_tiles(spark):
    """Tiles that no position looks into first, positions far from all rows, ties at one position: as a loop over all pairs has it."""
    kinds = "id long, latitude double, longitude double"
    right = [(i, 50 + (i * 7919 % 1009) / 3000, 19.8 + (i * 104729 % 1013) / 2500) for i in range(6000)] + [(7000 + i, 50.2, 20.1) for i in range(5)]
    left = [(i, 50.2 + i / 1e4, 20.1) for i in range(20)] + [(100 + i, 55.0, 20.0 + i / 10) for i in range(5)] + [(200, 0.0, 20.0)]
    l, r = spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds).withColumnRenamed("id", "other")

    def metres(a, b):
        return math.hypot(b[1] - a[1], (b[2] - a[2]) * math.cos(math.radians((a[1] + b[1]) / 2))) * 111_320

    want = {(a[0], k + 1, b[0]) for a in left[:-1] for k, b in enumerate(sorted(right, key=lambda b: (round(metres(a, b), 6), b[0]))[:8])}
    assert {(x.id, x.rank, x.other) for x in spatial.k_nearest(l, r, 8, "id", "other").collect()} == want
    near = {(x.id, x.other) for x in spatial.nearest(l, r, 2000, "id", ["other"]).collect()}
    assert near == {(i, o) for i, k, o in want if k == 1 and i < 100}


def test_sides_that_lie_alike_are_asked_once(spark):
    """Many lines at one place: the least of them by its columns, found through small cells and large ones alike."""
    lines = [(f"s{i:03}", [(50.0, 20.0), (50.02, 20.05)]) for i in range(300)] + [("far", [(50.1, 20.0), (50.1, 20.1)])]
    df = spark.createDataFrame(lines, "label string, points array<struct<lat: double, lon: double>>")
    at = spark.createDataFrame([(1, 50.0101, 20.025), (2, 50.06, 20.02), (3, 51.0, 20.0), (4, 50.0, 20.0)], "id long, latitude double, longitude double")
    got = {r.id: (r.label, round(r.distance_m)) for r in spatial.nearest_line(at, df, 6000, "id", ["label"]).collect()}
    assert got == {1: ("s000", 9), 2: ("far", 4453), 4: ("s000", 0)}
    taken = spark.createDataFrame([(1.0,)], "x double").select(F.size(spatial.covering_cells(F.struct(F.lit(50.0).alias("lat1"), F.lit(20.0).alias("lon1"), F.lit(50.2).alias("lat2"), F.lit(20.3).alias("lon2")), 100.0)).alias("n")).first().n
    assert taken < 3000  # of the box around it 50,000
