"""Sources over small documents written here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plotline.sources import geodata, headers, payload, pricelists

HEAD = "Miejscowość inwestycji;Ulica inwestycji;Nr lokalu nadany przez dewelopera;Cena lokalu [zł];Cena m 2;Powierzchnia użytkowa;Rodzaj części nieruchomości;Oznaczenie części;Cena części;Data od której cena m2 obowiązuje"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, format string, content binary")


def test_csv_price_list(spark):
    text = HEAD + "\nKraków;ul. Długa;A1;1 017 600,00;14.965,00;68,00;miejsce;12;50 000;2026-05-01\nKraków;ul. Długa;A1;1 017 600,00;14.965,00;68,00;komórka;X;brak;2026-05-01\nKraków;ul. Długa;;5;X;;;;;\n"
    got = pricelists.units(pricelists.rows_of_files(files(spark, ("f", "csv", bytearray(b"\xef\xbb\xbf" + text.encode()))))).collect()
    assert len(got) == 1
    u = got[0]
    assert (u.town, u.street, u.unit, u.price, u.price_per_m2, u.area) == ("Kraków", "ul. Długa", "A1", 1_017_600, 14_965, 68.0)
    assert u.extras == ["miejsce 12: 50 000", "komórka"] and str(u.price_since) == "2026-05-01"
    other = pricelists.rows_of_files(files(spark, ("g", "csv", bytearray(text.encode("cp1250"))))).count()
    assert other == 3


def test_headers_of_official_and_free_sheets():
    """A sheet of the template takes nothing from the words of other sheets; one of its own kind is read at the ends of its headers."""
    official = [*HEAD.split(";"), "floor", "city", "Valid from", "Województwo siedziby dewelopera", "Województwo inwestycji"]
    got = headers.columns_of(official)
    assert (got["town"], got["unit"], got["price"], got["price_per_m2"], got["price_since"], got["voivodeship"]) == (0, 2, 3, 4, 9, 14) and "floor" not in got
    free = ["Sales office city", "city", "building number", "unit number", "net price", "total price", "price per meter", "valid from", "plot area", "usable area", "name set"]
    assert headers.columns_of(free) == {"town": 1, "building_number": 2, "unit": 3, "price": 5, "price_per_m2": 6, "price_since": 7, "area": 9}
    assert headers.columns_of(["Nr lokalu", "Cena", "x"]) is None and headers.columns_of([None, 5, ""]) is None


def test_area_from_prices(spark):
    text = "Miejscowość;Nr lokalu;Cena brutto;Cena za m2\nKraków;1;500000;10000\n"
    u = pricelists.units(pricelists.rows_of_files(files(spark, ("f", "csv", bytearray(text.encode()))))).first()
    assert u.area == 50.0


def test_json_and_xml_trees():
    data = b'{"developer": "D", "investments": [{"city": "Krak\xc3\xb3w", "buildings": [{"unitNumber": "1", "price": 5, "priceHistory": [{"p": 1}]}, {"unitNumber": "2", "price": 6}]}]}'
    rows = pricelists.json_rows(data)
    assert rows[0] == ["developer", "investments city", "investments buildings unit Number", "investments buildings price"] and [r[2] for r in rows[1:]] == ["1", "2"]
    xml = b"<d><r><city>A</city><n>1</n></r><r><city>B</city><n>2</n></r></d>"
    assert pricelists.xml_rows(xml) == [["r city", "r n"], ["A", "1"], ["B", "2"]]
    assert pricelists.json_rows(b"{") == [] and pricelists.xml_rows(b"<") == []


def test_xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>city</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    assert pricelists.xlsx_rows(out.getvalue()) == [["city", None, "x"], [None, "5"]]
    assert pricelists.xlsx_rows(b"no zip") == []


def test_harvester():
    xml = b"<rs><resource><url>http://a/1.csv</url><dataDate>2026-01-01</dataDate></resource><resource><url>http://a/2.csv</url><dataDate>2026-02-01</dataDate></resource></rs>"
    assert pricelists.harvested(xml, "2026-01-15") == "http://a/1.csv" and pricelists.harvested(xml, None) == "http://a/2.csv" and pricelists.harvested(b"<x/>", None) is None


def test_listing_page_and_tombstone(spark):
    page = """<script id="d" type="application/json">{"props": {"pageProps": {"ad": {"id": 5, "title": "T", "createdAt": "2026-04-27T10:00:00Z", "features": ["balkon"],
      "characteristics": [{"key": "price", "value": "750 000"}, {"key": "m", "value": "60,5"}], "location": {"coordinates": {"latitude": 50.1, "longitude": 19.9},
      "reverseGeocoding": {"locations": [{"id": "malopolskie/krakow", "name": "Kraków", "locationLevel": "city_or_village"}]}}}, "adTrackingData": {"city_id": "38"}}}}</script>"""
    df = spark.createDataFrame([(page, "u1"), ('<script type="application/json">{"props": {"pageProps": {}}}</script>', "u2"), ("gone", "u3")], "html string, url string").select(payload.page_json(F.col("html")).alias("json"), "url")
    got = {r.url: r for r in payload.listings(df).collect()}
    ad = got["u1"]
    assert (ad.id, ad.price, ad.area, ad.features, ad.tracked_city_id, ad.levels[0].id, ad.gone) == (5, 750_000, 60.5, ["balkon"], "38", "malopolskie/krakow", False)
    assert got["u2"].gone and got["u3"].gone and got["u3"].features == []


def test_archive(spark):
    df = spark.createDataFrame([('{"a": "ż"}',), (None,)], "j string").select(payload.inflated(payload.deflated(F.col("j"))).alias("b"))
    assert [r.b for r in df.collect()] == ['{"a":"ż"}', None]


def test_grid_position(spark):
    """The national grid's central meridian, and a known point of the south."""
    lat, lon = geodata.to_degrees(F.lit(500_000.0), F.lit(486_000.0))
    got = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(got.lon - 19) < 1e-9 and 52 < got.lat < 52.3
    lat, lon = geodata.to_degrees(F.lit(566_900.0), F.lit(244_200.0))
    got = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(got.lat - 50.06) < 0.02 and abs(got.lon - 19.94) < 0.02


def test_tiles_and_areas(spark):
    assert len(geodata.tiles(0, 0, 2.5, 1, 1)) == 3
    ring = lambda x: f"0 {x} 0 {x + 1} 1 {x + 1} 1 {x} 0 {x}"
    parts = spark.createDataFrame([("126101", "a", ring(0)), ("126102", "b", ring(1))], "code string, name string, pos string").withColumn("ring", geodata.ring(F.col("pos")))
    got = geodata.areas(parts, spark.createDataFrame([("1261", "Kraków")], "code string, name string")).first()
    assert (got.code, got.name, got.province_code, len(got.sides)) == ("1261", "Kraków", "12", 6)


def test_search_urls():
    from plotline.sources.payload import search_urls

    assert search_urls("https://x/y", page=[1, 2], kind=["a b"]) == ["https://x/y?page=1&kind=a+b", "https://x/y?page=2&kind=a+b"]


def test_versions_of_a_table(spark, tmp_path):
    from plotline.operators import merge

    path = str(tmp_path / "signals")
    merge.publish(spark.range(3), path)
    merge.rebuilt(spark.range(5), path, ["id"])
    assert merge.published(spark, path).count() == 5 and merge.published(spark, path, -2).count() == 3
    (tmp_path / "signals" / "version=99999999999999999999").mkdir()  # one that is not whole yet
    assert merge.published(spark, path).count() == 5
    with pytest.raises(ValueError):
        merge.rebuilt(spark.range(5), path, ["ad_id"])
    with pytest.raises(ValueError):
        merge.rebuilt(spark.sql("SELECT CAST(NULL AS LONG) AS id"), path, ["id"])


def test_shards():
    from plotline.operators.upkeep import levels_from, parsed_shard

    assert parsed_shard("2/4") == (2, 4) and parsed_shard(None) is None
    for odd in ("0/4", "5/4", "a/b", "1", "1/2/3"):
        with pytest.raises(ValueError):
            parsed_shard(odd)
    assert levels_from("error") == ["ERROR", "CRITICAL"] and len(levels_from("loud")) == 5


def test_price_list_files_hold_every_unit(spark):
    """The files that the query makes are of the template, so each unit of part comes back."""
    from plotline.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["price_list_files"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/part.parquet").count() and got.where("town IS NULL OR unit IS NULL OR price IS NULL OR area IS NULL").isEmpty()
