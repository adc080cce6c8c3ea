"""Listings as nested records: what a reader of one listing sees, built for all of them at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import money


def _picked(columns: list[str]):
    return lambda r: F.struct(*(r[c].alias(c) for c in columns))


def nested(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str], list[str]]) -> DataFrame:
    """parents with an array of struct for each child table: (table, columns, order). A parent without rows has an empty array."""
    out = parents
    for name, (child, columns, order) in children.items():
        sort = [c for c in order if c not in columns]
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("_rows"))
        shaped = F.transform("_rows", _picked(columns))
        kept = rows.select(key, (shaped if sort or order != columns else F.col("_rows")).alias(name))
        out = out.join(kept, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kept.schema[name].dataType)))
    return out


def feature_groups(features: DataFrame, key: str = "id") -> DataFrame:
    """key and a map of group to its sorted, distinct labels. features: key, group, value."""
    each = features.groupBy(key, "group").agg(F.array_sort(F.array_distinct(F.collect_list(labels.label(F.col("value"))))).alias("labels"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "labels")))).alias("features"))


def lineage_history(groups: DataFrame, ads: DataFrame, observations: DataFrame) -> DataFrame:
    """group_id and its adverts in order of age, each with its prices in order of time."""
    members = groups.select("id", "group_id").join(ads.select("id", "created_at", "price", "owner_id"), "id")
    told = nested(members, "id", prices=(observations.select(F.col("ad_id").alias("id"), "observed_at", "price"), ["observed_at", "price"], ["observed_at", "price"]))
    return told.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "owner_id", "price", "prices"))).alias("adverts"))


def event_list(events: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """key and its events, newest first."""
    return events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, *columns)), False).alias("events"))


def history_phrase(listings: Column, days: Column, since: Column, advertisers: Column, active: Column, first_price: Column, price: Column) -> Column:
    """What a lineage tells in one sentence; null for one new advert."""
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("ten sam lokal ogłaszany od "), F.date_format(since, "yyyy-MM-dd"), F.lit(", "), days.cast("string"), F.lit(" dni na rynku")),
            F.when(listings > 1, F.concat(listings.cast("string"), F.lit(" ogłoszeń od "), advertisers.cast("string"), F.lit(" ogłoszeniodawców"))),
            F.when(active > 1, F.concat(F.lit("teraz wystawiony równolegle w "), active.cast("string"), F.lit(" ogłoszeniach"))),
            F.when(~first_price.eqNullSafe(price) & first_price.isNotNull(), F.concat(F.lit("pierwsza znana cena "), money(first_price))),
        )
    )
    return F.when((listings >= 2) | (days >= 45), F.array_join(parts, ", "))


def _said(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _against(phrase: Column, pct: Column) -> Column:
    """A phrase with how far the offer is above or below what it tells, if that is known."""
    where = F.when(pct > 0, "powyżej").otherwise("poniżej")
    return F.when(pct.isNull(), phrase).otherwise(_said(phrase, ", ta oferta jest ", F.bround(F.abs(pct), 0).cast("long"), "% ", where))


# The words of the phrases below and their order.


def market_phrases(signals: DataFrame) -> DataFrame:
    """ad_id and what its signals tell in words: comparables, transactions, street_transactions, previous_sale, developer, area_warnings, nuisances, location_warnings.

    Null where there is nothing to tell. signals: as signals.signals gives.
    """
    c = F.col
    known = lambda value, phrase: F.when(F.coalesce(c(value) != 0, F.lit(False)), phrase)
    notes = lambda name, between: F.when(F.size(name) > 0, F.array_join(name, between))
    offers = _said("wśród ", c("comparables_count"), " podobnych ofert (metraż ±35%) do ", c("comparables_radius_m"), " m od pinezki mediana to ", c("comparables_median_price_per_m2"), " zł za metr")
    sold = _said("mediana ", c("transactions_count"), " prawdziwych transakcji z ostatnich 2 lat (RCN, metraż ±35%, do ", c("transactions_radius_m"), " m) to ", c("transactions_median_price_per_m2"), " zł za metr")
    street = _said(
        "na tej samej ulicy (do 1,5 km, metraż ±35%, mogą to być budynki z innych lat) mediana ", c("street_transactions_count"), " transakcji to ", c("street_transactions_median_price_per_m2"), " zł za metr"
    )
    before = _said("prawdopodobnie ten sam lokal sprzedano ", F.date_format("previous_sale_at", "yyyy-MM"), " za ", money(c("previous_sale_price")), " (RCN: ten sam metraż, ", c("previous_sale_distance_m"), " m od pinezki)")
    return signals.select(
        "ad_id",
        known("comparables_median_price_per_m2", _against(offers, c("price_vs_comparables_pct"))).alias("comparables"),
        known("transactions_median_price_per_m2", _against(sold, c("price_vs_transactions_pct"))).alias("transactions"),
        known("street_transactions_median_price_per_m2", _against(street, c("price_vs_street_transactions_pct"))).alias("street_transactions"),
        known("previous_sale_price", before).alias("previous_sale"),
        known("developer_price", _developer_phrase()).alias("developer"),
        notes("area_notes", " ").alias("area_warnings"),
        notes("nuisance_notes", "; ").alias("nuisances"),
        notes("location_notes", " ").alias("location_warnings"),
    )


def _developer_phrase() -> Column:
    c = F.col
    day = lambda name: F.date_format(name, "yyyy-MM-dd")
    off = c("price_vs_developer_pct")
    told = _said("oficjalny cennik dewelopera ", F.coalesce("developer_name", F.lit("")), " na dane.gov.pl (lokal ", c("developer_unit"), ", ", c("developer_investment"), "): ", money(c("developer_price")))
    told = F.concat(F.replace(told, F.lit("  "), F.lit(" ")), F.coalesce(_said(" od ", day("developer_price_since")), F.lit("")))
    parts = [
        told,
        F.when(F.abs(off) >= 1, _said("ogłoszenie jest ", F.bround(F.abs(off), 0).cast("long"), "% ", F.when(off > 0, "powyżej").otherwise("poniżej"), " cennika")),
        F.when(c("developer_first_price") != c("developer_price"), _said("w cenniku od ", day("developer_first_seen"), ", pierwsza cena ", money(c("developer_first_price")))),
        F.when(c("developer_highest_price") > c("developer_price"), _said("najwyższa cena w cenniku ", money(c("developer_highest_price")))),
        F.when(c("developer_price_with_extras") > c("developer_price"), _said("z obowiązkowymi składnikami ", money(c("developer_price_with_extras")))),
        F.when(F.size("developer_extras") > 0, _said("dodatkowo w cenniku: ", F.array_join("developer_extras", "; "))),
        F.when(c("developer_unit_gone"), _said("lokal zniknął z cennika po ", day("developer_last_seen"), ", może być już sprzedany lub zarezerwowany")),
        F.when(
            c("investment_units_listed").isNotNull(),
            _said("w inwestycji ", c("investment_units_listed"), " lokali w cenniku, ", c("investment_units_gone"), " zniknęło od ", F.date_format("investment_tracked_since", "yyyy-MM")),
        ),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def cards(listings: DataFrame) -> DataFrame:
    """id, title and what a reader, or a model that ranks, is shown of a listing: kind, address, prices, area, building, labels, features.

    listings: offer_type, object_type, street, district_name, city_name, province_name, price_value, price_per_m2, rent_value, area_value, rooms, building_year,
    building_type, building_material, building_heating, market, property_condition, features (raw values).
    """
    c = F.col
    filled = lambda between, *parts: F.concat_ws(between, *(F.nullif(p, F.lit("")) for p in parts))
    or_else = lambda said, none: F.coalesce(F.nullif(said, F.lit("")), F.lit(none))
    code = lambda name, field: labels.code_label(c(name), field)
    building = filled(", ", F.nullif(c("building_year"), F.lit(0)).cast("string"), code("building_type", "building_types"), code("building_material", "building_materials"), code("building_heating", "building_heating"))
    features = F.array_sort(F.array_distinct(F.transform(F.coalesce("features", F.array().cast("array<string>")), lambda v: labels.label(v))))
    return listings.select(
        "id",
        "title",
        or_else(filled(" ", code("offer_type", "offer_types"), code("object_type", "object_types")), "nie wiadomo").alias("kind"),
        or_else(filled(", ", c("street"), c("district_name"), c("city_name"), c("province_name")), "brak danych").alias("address"),
        F.coalesce(money(c("price_value")), F.lit("do ustalenia")).alias("price"),
        money(c("price_per_m2")).alias("price_per_m2"),
        money(c("rent_value")).alias("rent"),
        F.when(c("area_value") != 0, F.format_string("%.1f m2", F.bround(c("area_value").cast("double"), 1))).alias("area"),
        "rooms",
        or_else(building, "brak danych").alias("building"),
        code("market", "markets").alias("market"),
        code("property_condition", "property_conditions").alias("condition"),
        or_else(F.array_join(features, ", "), "brak").alias("features"),
    )
