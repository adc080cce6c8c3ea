"""Scenarios for the rules, and functions on single values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotline.functions import arrays, dates, geo, labels, numbers, rules, sketch, text
from plotline.operators import assistant, checks, comparables, cover, developer, enrich, history, lineage, merge, search, spatial


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r[0] for r in df.orderBy("_i").select(column).collect()]


def test_text(spark):
    assert values(spark, [("Łódź Śródmieście",), ("Żółć É",), (None,)], "a string", text.normalize_name(F.col("a"))) == ["lodz srodmiescie", "zolc e", None]
    assert values(spark, [("ul. Jana Pawła II",), ("os. Zielone",), ("Rynek Główny",), ("Krótka 5",), ("***",), ("",), (None,)], "a string", text.street_key(F.col("a"))) == ["pawla", None, None, "krotka", None, None, None]
    assert values(spark, [("Gmina  Zabierzów",), ("m. Kraków",), ("  ",), (None,)], "a string", text.place_name(F.col("a"))) == ["zabierzow", "krakow", None, None]
    assert values(spark, [("MSC:Kraków;UL:Długa;NR:3",), ("MSC:Kraków",), (None,)], "a string", text.register_street(F.col("a"))) == ["dluga", None, None]
    assert values(spark, [("S7;52",), ("A4;A4",), (None,), ("",)], "a string", text.road_label(F.col("a"), F.lit("n"))) == ["S7/DK52", "A4", "n", "n"]
    assert values(spark, [("GROUND_FLOOR",), ("a",)], "a string", text.humanize(F.col("a"))) == ["Ground floor", "A"]
    assert values(spark, [("unitPriceGross",), ("a_b",)], "a string", text.camel_words(F.col("a"))) == ["unit Price Gross", "a b"]
    assert text.html_text("<p>a<br>b</p><script>x</script><ul><li>c</li></ul>") == "a\nb\nc"
    assert text.html_text("<p>abcdef</p>", 3).startswith("abc\n[") and text.html_text("") is None
    cut = lambda content, found, margin: one(spark, text.excerpt(F.lit(content), *text.first_match(F.lit(content), found), margin).alias("x")).x
    assert cut("one two three four", "two", 0) == "…two…" and cut("one two three four", "two", 50) == "one two three four"
    assert cut("one two three four", "three", 5) == "one two three four" and cut("aaa bbb ccc ddd eee", "ccc", 2) == "…bbb ccc ddd…"
    assert cut("one two", "one", 0) == "one…" and cut("one two", "two", 0) == "…two"
    assert values(spark, [(1234567.0,)], "a double", text.money(F.col("a"))) == ["1 234 567 zł"]
    assert values(spark, [(-12.5,), (3.0,)], "a double", text.percent(F.col("a"))) == ["-12,5%", "+3%"]


def test_html_against_patterns(spark):
    """Well-formed pages, by taking tags away with patterns."""
    import html
    import random
    import re

    rng = random.Random(9)

    def piece(deep):
        kind = rng.choice(["text", "text", "b", "p", "li", "div", "br", "script", "h2"] if deep else ["text"])
        inner = "".join(piece(deep - 1) for _ in range(rng.randint(0, 3))) if kind not in ("text", "br", "script") else ""
        return {"text": rng.choice(["word ", "a &amp; b", "x &lt; y ", "é\n"]), "br": rng.choice(["<br>", "<br/>"]), "script": "<script>if (1) { x }</script>"}.get(kind, f"<{kind} class='c'>{inner}</{kind}>")

    pages = ["".join(piece(3) for _ in range(rng.randint(1, 6))) for _ in range(60)]

    def plain(page):
        page = re.sub(r"<script>.*?</script>", "", page)
        page = re.sub(r"<br/?>|</(?:p|li|div|h2)>", "\n", page)
        said = html.unescape(re.sub(r"<[^>]+>", "", page))
        while "\n\n\n" in said:
            said = said.replace("\n\n\n", "\n\n")
        return said.strip() or None

    assert values(spark, [(p,) for p in pages], "a string", text.html_to_text(F.col("a"))) == [plain(p) for p in pages]


def test_numbers(spark):
    said = ["1.234.567,00", "12,345.50", "1 099 000 zł", "12,5", "0,00", "12 i 13", None, "450000.00", "1.234"]
    assert values(spark, [(s,) for s in said], "a string", numbers.amount(F.col("a"))) == [1234567, 12346, 1099000, 12, None, None, None, 450000, 1234]
    assert values(spark, [("ok. 45,5 m2",), ("-3",), ("x",), (None,)], "a string", numbers.lenient_float(F.col("a"))) == [45.5, -3.0, None, None]
    assert values(spark, [(999.0,), (-1000.4,), (12.25,)], "a double", numbers.bounded_pct(F.col("a"))) == [999.0, None, 12.2]
    assert values(spark, [("X",), (" brak ",), ("5",)], "a string", numbers.cell(F.col("a"))) == [None, None, "5"]
    assert values(spark, [(0,), (3,), (9,)], "a int", numbers.backoff_seconds(F.col("a"))) == [60.0, 480.0, 1800.0]


def test_dates(spark):
    said = ["2024-05-03", "3.05.2024 r.", "2024-02-30", "none", None]
    assert values(spark, [(s,) for s in said], "a string", dates.free_date(F.col("a"))) == [dt.date(2024, 5, 3)] * 2 + [None] * 3
    a, b = F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("2024-01-03 11:00:00").cast("timestamp")
    assert tuple(one(spark, dates.whole_days(a, b).alias("x"), dates.whole_days(b, a).alias("y"))) == (1, 0)


def test_rules(spark):
    codes = ["GROUND_FLOOR", "CELLAR", "FLOOR_HIGHER_10", "FLOOR_7", "GARRET", None]
    assert values(spark, [(c,) for c in codes], "a string", rules.floor_number(F.col("a"))) == [0, -1, 11, 7, None, None]
    titles = ["Piękny dom z ogrodem", "Mieszkanie 3 pokoje", "Domofon", "Segment na sprzedaż", None]
    none = F.lit(None).cast("string")
    assert values(spark, [(t,) for t in titles], "a string", rules.object_type(none, none, none, none, none, F.col("a"))) == ["HOUSE", "APARTMENT", None, "HOUSE", None]
    assert values(spark, [("SIX",), ("2",), (None,)], "a string", rules.rooms_number(F.col("a"))) == [6, None, None]
    assert values(spark, [("TENTH",), ("GROUND",), ("12",)], "a string", rules.word_number(F.col("a"), rules.FLOOR_WORDS, 0)) == [10, 0, 12]
    day = lambda s: F.lit(s).cast("timestamp")
    ends = [rules.listing_end(F.lit(s), day(c), day(m), day("2026-10-24")) for s, c, m in (("active", "2026-10-20", "2026-10-01"), ("active", "2026-03-02", "2026-03-01"), ("removed_by_user", "2026-05-05", "2026-05-01"))]
    live, stale, gone = one(spark, *ends)
    assert live.ended_at is None and live.known
    assert stale.ended_at.month == 3 and not stale.known and stale.seen_until == stale.ended_at
    assert gone.known and gone.ended_at.day == 1


def test_labels_and_arrays(spark):
    assert labels.values_of("balkon") == ["balcony", "balkon"] and labels.values_of("odd") == ["odd"]
    assert one(spark, arrays.sampled_days(F.array(*(F.lit(f"2024-01-{d:02d}").cast("date") for d in (1, 2, 3, 9, 10, 20))), 7).alias("x")).x == [dt.date(2024, 1, d) for d in (1, 9, 20)]
    assert one(spark, arrays.evenly(F.array(*map(F.lit, range(10))), 4).alias("x")).x == [0, 3, 6, 9]
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ((" a ", "1"), ("b", " "), ("a", "2"))))
    assert one(spark, arrays.attributes(pairs).alias("x")).x == {"a": "2"}
    s = sketch.similarity(sketch.sketch(F.lit("one two three four")), sketch.sketch(F.lit("one two three five")))
    assert one(spark, s.alias("x"), sketch.similarity(sketch.sketch(F.lit("")), sketch.sketch(F.lit(None).cast("string"))).alias("y")) == (0.6, 0.0)


def test_geometry(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in square))
    sides = geo.edges(ring)
    got = one(spark, geo.inside(sides, F.lit(0.5), F.lit(0.5)).alias("a"), geo.inside(sides, F.lit(0.5), F.lit(1.5)).alias("b"), geo.boundary_distance(sides, F.lit(0.5), F.lit(0.99)).alias("c"))
    assert got.a and not got.b and abs(got.c - 0.01 * 111_320) < 2
    shift = F.transform(ring, lambda p: F.struct(p["lat"].alias("lat"), (p["lon"] + 1).alias("lon")))
    assert one(spark, F.size(geo.outer_sides(F.array(ring, shift))).alias("n")).n == 6
    assert abs(one(spark, geo.rings_area_km2(F.array(ring)).alias("x")).x - 111.32**2) < 5


def test_runway(spark):
    runway = spark.createDataFrame([("EPKK", [(50.0753999, 19.7680992), (50.0801982, 19.8026141)])], "label string, points array<struct<lat: double, lon: double>>")
    at = spark.createDataFrame([(1, 50.0802 + 0.0048 * 2, 19.8026 + 0.0345 * 2), (2, 50.2, 19.9)], "id long, latitude double, longitude double")
    got = spatial.beyond_runways(at, runway, "id").collect()
    assert [r.id for r in got] == [1] and abs(got[0].approach_m - 5000) < 200


@pytest.mark.parametrize("base", [(50.0, 19.8), (-0.01, 0.01), (69.5, -30.0)])
def test_near_pairs_and_lines_at_any_latitude(spark, base):
    import math
    import random

    rng = random.Random(5)
    at = [(i, base[0] + rng.uniform(0, 0.05), base[1] + rng.uniform(0, 0.1)) for i in range(150)]
    df = spark.createDataFrame(at, "id long, latitude double, longitude double")

    def apart(a, b):
        dy, dx = (b[1] - a[1]) * 111_320, (b[2] - a[2]) * 111_320 * math.cos(math.radians((a[1] + b[1]) / 2))
        return math.hypot(dx, dy)

    got = {(r.id, r.r_id) for r in spatial.near_pairs(df, df, 700).collect()}
    assert got == {(a[0], b[0]) for a in at for b in at if apart(a, b) <= 700}

    ways = [(k, [(base[0] + rng.uniform(0, 0.05), base[1] + rng.uniform(0, 0.1)) for _ in range(3)]) for k in range(12)]
    lines = spark.createDataFrame(ways, "line long, points array<struct<lat: double, lon: double>>")

    def to_line(a, points):
        best = math.inf
        for (y1, x1), (y2, x2) in zip(points, points[1:]):
            k = math.cos(math.radians(a[1]))
            px, py, dx, dy = (x1 - a[2]) * k, y1 - a[1], (x2 - x1) * k, y2 - y1
            t = max(0.0, min(1.0, -(px * dx + py * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(px + t * dx, py + t * dy) * 111_320)
        return best

    near = {r.id: (r.line, round(r.distance_m, 3)) for r in spatial.nearest_line(df, lines, 300, "id", ["line"]).collect()}
    want = {a[0]: min((to_line(a, w), k) for k, w in ways) for a in at}
    assert near == {i: (k, round(d, 3)) for i, (d, k) in want.items() if d <= 300}


def test_containing_areas_of_many_cells(spark):
    """An area with a hole and a bay over many cells, another beside it; points on all sides of them."""
    import random

    rng = random.Random(6)
    outer = [(50.0, 19.0), (50.0, 20.0), (50.33, 20.1), (50.21, 19.61), (50.61, 19.5), (50.5, 19.0), (50.0, 19.0)]
    hole = [(50.11, 19.2), (50.11, 19.4), (50.22, 19.4), (50.22, 19.2), (50.11, 19.2)]
    beside = [(50.0, 20.0), (50.0, 20.02), (50.02, 20.02), (50.02, 20.0), (50.0, 20.0)]
    pt = "array<array<struct<lat: double, lon: double>>>"
    areas = spark.createDataFrame([("big", [outer, hole]), ("small", [beside])], f"name string, rings {pt}").select("name", geo.outer_sides(F.col("rings")).alias("sides"))
    at = [(i, rng.uniform(49.9, 50.7), rng.uniform(18.9, 20.2)) for i in range(1500)]
    at += [(2000 + i, rng.uniform(49.99, 50.03), rng.uniform(19.99, 20.03)) for i in range(200)]

    def held(y, x, rings):
        n = 0
        for ring in rings:
            for (y1, x1), (y2, x2) in zip(ring, ring[1:]):
                n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return n % 2 == 1

    want = {i: "big" if held(y, x, [outer, hole]) else "small" for i, y, x in at if held(y, x, [outer, hole]) or held(y, x, [beside])}
    df = spark.createDataFrame(at, "id long, latitude double, longitude double")
    assert {r.id: r.name for r in spatial.containing(df, areas, "id", ["name"]).collect()} == want
    cells = cover.cover(areas, ["name"]).collect()
    assert all(0 < len(c.sides) <= cover.MOST_SIDES for c in cells if not c.whole) and {"big", "small"} == set(want.values())
    near = {r.id for r in spatial.within_area(df, areas, 2000, "id").collect()}
    sides = areas.select(F.explode("sides").alias("e"))
    close = df.join(sides, geo.side_distance(F.col("e"), F.col("latitude"), F.col("longitude")) <= 2000, "left_semi")
    assert near == set(want) | {r.id for r in close.collect()}


def flats(spark, rows):
    return spark.createDataFrame(rows, "id long, group_id long, kind string, latitude double, longitude double, area double, price_per_m2 double")


def test_comparables(spark):
    near = [(i, i, "flat", 50.06 + i / 1e5, 19.94, 60.0, 15_000.0) for i in range(1, 11)]
    other = [(50, 1, "flat", 50.0601, 19.94, 60.0, 99_000.0), (51, 60, "flat", 50.06, 19.94, 200.0, 1.0), (52, 61, "house", 50.06, 19.94, 60.0, 1.0)]
    target = flats(spark, [(99, 99, "flat", 50.06, 19.94, 60.0, 9_000.0)])
    got = comparables.comparables(target, flats(spark, near + other)).collect()
    assert [(r.id, r.n, r.radius_m, r.median) for r in got] == [(99, 10, 750, 15_000)]
    assert comparables.comparables(target, flats(spark, near[:9])).count() == 0


def test_previous_sale(spark):
    schema = "id long, sold_at timestamp, price double, area double, rooms int, floor int, latitude double, longitude double"
    sale = (1, dt.datetime(2021, 9, 3), 694_000.0, 96.7, 4, None, 50.06, 19.94)
    change = lambda **k: tuple({**dict(zip(("id", "sold_at", "price", "area", "rooms", "floor", "latitude", "longitude"), sale)), **k}.values())
    listing = spark.createDataFrame([(7, dt.datetime(2026, 9, 29), 998_000, 96.7, 4, None, 50.06, 19.94)], "id long, listed_at timestamp, price long, area double, rooms int, floor int, latitude double, longitude double")
    match = lambda *rows: [r.price for r in comparables.previous_sale(listing, spark.createDataFrame(list(rows), schema)).collect()]
    assert match(sale) == [694_000]
    assert match(sale, change(id=2, sold_at=dt.datetime(2023, 1, 1), price=800_000.0)) == [800_000]
    assert match(sale, change(id=2), change(id=3)) == []
    for odd in ({"sold_at": dt.datetime(2027, 1, 1)}, {"price": 10_000.0}, {"latitude": 50.08}, {"rooms": 2}, {"area": 99.0}):
        assert match(change(**odd)) == []


def test_checks(spark):
    verdict = lambda *a: one(spark, checks.pin_verdict(F.lit("Kraków"), *(F.lit(x) for x in a)).alias("v")).v.flags
    assert verdict(True, 327.0, True, 835, "Kraków", None) == ["near_city_border"]
    assert verdict(True, 327.0, False, 289, None, "Zielonki") == ["pin_outside_city"]
    assert verdict(True, 20.0, True, 600, None, None) == [] and verdict(False, 327.0, False, 9000, None, None) == []
    flags = one(spark, checks.nuisance_verdict(F.lit(180), F.lit("A4"), F.lit(400), F.lit(4250)).alias("v")).v
    assert flags.flags == ["near_expressway", "under_approach"] and "4,2" in flags.notes[1]


def test_area_rules(spark):
    said = [
        ("Dom 180 m2, 96 m2 powierzchni użytkowej", 180.0, 96.0),
        ("parter 96 m2 powierzchni użytkowej", 180.0, None),
        ("Pow. użytkowa: 96,5 m², w tym poziom 1 90 m2 pow. użytkowej", 180.0, 96.5),
        ("użytkowa wg księdze wieczystej 100 m2", 180.0, 100.0),
        ("powierzchni użytkowej 70 m2", 180.0, None),
        ("powierzchni użytkowej 175 m2", 180.0, None),
        ("powierzchni użytkowej 96 m2", None, None),
        ("Łączna 120 m2 użytkowej oraz 110 m2 użytkowej", 180.0, 110.0),
    ]
    assert values(spark, [x[:2] for x in said], "t string, area double", checks.usable_area(F.col("t"), F.col("area"))) == [x[2] for x in said]
    rows = [("Mieszkanie ze skosami, w tym piwnica 5 m2", 60.0), ("Dom 180 m2, 96 m2 powierzchni użytkowej", 180.0), ("nic", 50.0), (None, 1.0)]
    got = values(spark, rows, "t string, area double", checks.area_verdict(F.col("t"), F.col("area"), checks.usable_area(F.col("t"), F.col("area"))))
    assert [g.flags for g in got] == [["attic_slopes", "appurtenant_included"], ["usable_area_smaller"], [], []]
    assert got[1].notes == ["Opis podaje 96 m² powierzchni użytkowej, a ogłoszenie 180 m². Cena za metr użytkowy jest o 88% wyższa."]
    assert got[0].notes[0] == "Opis wspomina skosy albo powierzchnię po podłodze: „Mieszkanie ze skosami, w tym piwnica 5 m2”."
    df = spark.createDataFrame([(1, 60.0, None, "Ładne skosy"), (2, 60.0, "skosy", "bez"), (3, 60.0, "skosy", "***"), (4, 60.0, "skosy", None)], "id long, area double, title string, description string")
    assert [r.id for r in checks.area_verdicts(df).collect()] == [1]


def test_border_rules(spark):
    said = [
        ("Działka na granicy Krakowa i Zielonek", "Skawina", [], "na granicy Krakowa"),
        ("blisko, 3 km od granicy z Czechami", "Cieszyn", [], "3 km od granicy"),
        ("gmina Skawina", "Skawina", [], None),
        ("w gminie Zabierzów, cisza", "Kraków", [], "gminie Zabierzów"),
        ("na granicy Podgórza i Dębnik", "Kraków", ["Podgórze"], None),
        ("na granicy Czech", "Cieszyn", None, None),
        ("przy granicy Działka, pod Krakowem", "Skawina", None, "pod Krakowem"),
        ("spokojna okolica", None, None, None),
        (None, "Kraków", None, None),
    ]
    assert values(spark, [x[:3] for x in said], "t string, city string, names array<string>", checks.border_phrase(F.col("t"), F.col("city"), F.col("names"))) == [x[3] for x in said]


def test_place_rules(spark):
    said = [
        ("Dom w Zielonkach, cisza", "Zielonki", True),
        ("dojazd do Zielonek", "Zielonki", False),
        ("Zielonki 5 km stąd", "Zielonki", False),
        ("dom zielonkowski", "Zielonki", False),
        ("blisko Zielonek. Ładny dom w Zielonkach", "Zielonki", True),
        ("działka w Nowym Targu", "Nowy Targ", False),
        ("działka, Nowy Targ", "Nowy Targ", True),
        ("ul. Zielonki 3", "Zielonki", False),
        ("PodZielonki", "Zielonki", False),
        ("Nowa Wieś (okolica)", "Nowa Wieś", True),
    ]

    def mentions(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, t string, name string")
        told = {r._i: r.said for r in checks.with_mention(df, "t", "name").collect()}
        return [told.get(i) for i in range(len(rows))]

    got = mentions([x[:2] for x in said])
    assert [g is not None for g in got] == [x[2] for x in said]
    assert got[4] == "blisko Zielonek. Ładny dom w Zielonkach"
    long = "a" * 60 + " blisko Zielonek. " + "b " * 40 + "Dom w Zielonkach jest cichy " + "c " * 40
    assert mentions([(long, "Zielonki")])[0].strip("…b c").startswith("Dom w Zielonkach jest cichy")


def test_lineage_of_monthly_relistings(spark):
    rows = [(i, 7, "SECONDARY", "SALE", "APARTMENT", dt.datetime(2026, 3 + i, 1), dt.datetime(2026, 3 + i, 28) if i < 4 else None, True, None, 1_099_000 - i * 1000, 120.4, 4, "FLOOR_1", 2011, "BLOCK", 50.11, 19.8876, 38, "Ładne mieszkanie z widokiem") for i in range(1, 5)]
    rows.append((9, 8, "SECONDARY", "SALE", "APARTMENT", dt.datetime(2026, 4, 5), None, True, None, 900_000, 60.3, 2, "FLOOR_1", 2011, "BLOCK", 50.11, 19.8876, 38, "Kawalerka"))
    names = lineage.FIELDS[:-2]
    df = spark.createDataFrame(rows, "id long, owner_id long, market string, offer_type string, object_type string, created_at timestamp, ended_at timestamp, ended_at_known boolean, seen_until timestamp, price long, area double, rooms int, floor string, building_year int, building_type string, latitude double, longitude double, city_id long, title string")
    ads = df.select(*names, sketch.sketch(F.col("title")).alias("title_sketch"), sketch.sketch(F.col("title")).alias("text_sketch"))
    got = {r.id: r.group_id for r in lineage.lineages(ads, F.lit(dt.datetime(2026, 10, 24))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_developer_score(spark):
    s = lambda street, rooms, price: one(spark, developer.score(F.lit(street), F.lit("dluga"), F.lit(rooms), F.lit(3), F.lit(price), F.lit(998_000), F.lit(1_017_600), F.lit(None).cast("int")).alias("s")).s
    assert s("dluga", 3, 998_000) == 5 and s("inna", 3, 998_000) == 3 and s("dluga", 2, 998_000) == 2 and s("dluga", 3, 2_000_000) == 0 and s(None, None, 1_040_000) == 1


def test_histories(spark):
    rows = [(1, 1, 100, "a"), (1, 2, 100, "a"), (1, 3, 90, "a"), (1, 4, 90, None), (1, 5, 0, "a"), (2, 1, 50, "a")]
    df = spark.createDataFrame(rows, "ad long, t int, price int, status string")
    assert sorted((r.ad, r.t) for r in history.changes(df, "ad", ["t"], ["price", "status"], "price").collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    old = spark.createDataFrame([(1, "long text", 50.0), (2, "b", 51.0)], "id long, description string, latitude double")
    new = spark.createDataFrame([(1, "***", None), (3, "c", 52.0)], "id long, description string, latitude double")
    got = {r.id: (r.description, r.latitude) for r in merge.refreshed(old, new, "id", ["description"], ["latitude"], []).collect()}
    assert got == {1: ("long text", 50.0), 2: ("b", 51.0), 3: ("c", 52.0)}


def test_snapshots_restart_after_renumbering(spark):
    rows = [(1, "u", dt.date(2024, 1, 1), 50.0, 300, 6), (1, "u", dt.date(2024, 2, 1), 50.0, 280, 6), (1, "u", dt.date(2024, 3, 1), 70.0, 400, 6), (1, "u", dt.date(2024, 4, 1), 70.0, 410, 6)]
    units, events = merge.apply_snapshots(spark.createDataFrame(rows, "institution_id long, unit_key string, day date, area double, price long, price_per_m2 long"))
    u = units.first()
    assert (u.first_price, u.price, u.lowest_price, u.first_seen) == (400, 410, 400, dt.date(2024, 3, 1)) and events.count() == 2


def test_replace_all_refuses_nothing(spark, tmp_path):
    path = str(tmp_path / "x")
    merge.replace_all(spark.range(4), path, "streets")
    with pytest.raises(ValueError, match="no streets"):
        merge.replace_all(spark.range(0), path, "streets")
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        merge.replace_all(broken, path, "streets")
    assert merge.published(spark, path).count() == 4


def test_saved_searches(spark):
    saved = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (5, "c", "z")], "id long, name string, query string")
    new = spark.createDataFrame([("d", "1", 1), ("a", "2", 2), ("d", "3", 3), ("e", "4", 4)], "name string, query string, at int")
    kept, refused = merge.created_searches(saved, new)
    assert sorted(map(tuple, kept.collect())) == [(1, "a", "x"), (2, "b", "y"), (5, "c", "z"), (6, "d", "1"), (7, "e", "4")] and sorted(r.query for r in refused.collect()) == ["2", "3"]
    changes = spark.createDataFrame([(1, "a", "new"), (2, "c", "no"), (5, "f", "yes"), (9, "g", "unknown"), (6, "f", "late")], "id long, name string, query string")
    got, why = merge.updated_searches(kept, changes)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "new"), (2, "b", "y"), (5, "f", "yes"), (6, "d", "1"), (7, "e", "4")]
    assert {r.id: r.why for r in why.collect()} == {2: "name is taken", 9: "unknown", 6: "name is taken"}
    left, unknown = merge.deleted_searches(saved, spark.createDataFrame([(2,), (2,), (8,)], "id long"))
    assert sorted(r.id for r in left.collect()) == [1, 5] and [r.id for r in unknown.collect()] == [8]


def test_said_folds_case():
    assert assistant.said([" Balkon", "balkon ", "", "Garaż", "BALKON"]) == ["Balkon", "Garaż"]


def test_search_and_plan():
    assert search.parsed_attributes(["kitchen_type: open", "x", ":y"]) == [("kitchen_type", "open")]
    with pytest.raises(ValueError):
        search.Search(limit=500)
    facets = {"cities": ["Kraków", "Łódź"], "features": ["balkon"]}
    answer = {
        "cities": ["krakow", "Atlantis"],
        "markets": ["PRIMARY", "ALL"],
        "building_types": ["BLOCK", "CASTLE"],
        "features": ["balkon", "x"],
        "limits": [{"field": "max_price", "value": 499_999.6}, {"field": "min_area", "value": 40}, {"field": "min_rooms", "value": -1}, {"field": "odd", "value": 1}, {"field": "max_rent"}],
        "near": [{"latitude": 50.06, "longitude": 19.94, "radius_m": 9_000_000, "place": "Rynek"}],
        "keywords": ["park", " park ", " "],
        "criteria": [{"text": " cisza ", "importance": "must"}, {"text": ""}, {"text": "widok"}],
        "understood": " tak ",
        "sort": "odd",
    }
    p = assistant.plan(answer, facets)
    q = p.query
    assert q.cities == [] and q.radius_m == 50_000 and q.features == ["balkon"] and q.markets == ["PRIMARY"] and q.building_types == ["BLOCK"]
    assert (q.max_price, q.min_area, q.min_rooms, q.max_rent) == (500_000, 40.0, None, None)
    assert (p.keywords, p.criteria, p.understood, p.sort, q.sort) == (["park"], [("cisza", "must"), ("widok", "nice")], "tak", "relevance", "created_at")
    assert p.warnings == ["Nie znalazłem miejscowości „Atlantis” w ogłoszeniach, pomijam ten filtr.", "Szukam w promieniu 50 km od „Rynek”, więc nie zawężam do samego miasta."]
    p = assistant.plan({"cities": ["ŁÓDŹ", "lodz"], "near": [{"latitude": 54.95, "longitude": 14.0, "place": "plaża", "radius_m": 100}], "sort": "price_value", "direction": "asc"}, facets)
    assert (p.query.cities, p.query.radius_m, p.query.sort, p.query.direction, p.warnings) == (["Łódź"], 300, "price_value", "asc", [])
    p = assistant.plan({"near": [{"latitude": 40.0, "longitude": 14.0, "place": "Rzym"}]}, facets)
    assert p.query.radius_m is None and p.warnings == ["Nie znam położenia miejsca „Rzym”, pomijam szukanie wokół niego."]


def test_ranking(spark):
    cards = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    said = [{"ad_id": 2, "fit_score": 5, "headline": " a "}, {"ad_id": 9, "fit_score": 9}, {"ad_id": 2, "fit_score": 8}, {"ad_id": 3, "fit_score": 5, "matches": ["x", " "], "gaps": ["y"]}, {"ad_id": 1, "fit_score": 7}]
    got = [(r.id, r.fit_score, r.headline, r.matches, r.gaps) for r in assistant.ranked(spark, cards, said).collect()]
    assert got == [(1, 7, "", [], []), (2, 5, "a", [], []), (3, 5, "", ["x"], ["y"])]


def test_code_labels(spark):
    codes = ["BLOCK", "ODD_ONE", "", None]
    assert values(spark, [(c,) for c in codes], "a string", labels.code_label(F.col("a"), "building_types")) == ["Blok", "Odd one", "", None]
    assert values(spark, [(c,) for c in ("", "ALL")], "a string", labels.code_label(F.col("a"), "markets")) == ["Nie podano", "Bez podziału"]


def test_scoring_keeps_failures(spark):
    ads = spark.createDataFrame([(1,), (50,)], "id long")
    from plotline.plans.scorers import evaluate

    got = {r.ad_id: (r.status, r.attempts) for r in enrich.scored(ads, evaluate, "overall_score int").collect()}
    assert got == {1: ("ok", 1), 50: ("failed", 3)}
