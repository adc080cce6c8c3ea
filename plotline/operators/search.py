"""Parametric search over listings: a query's conditions, its page and its total in one declarative plan.

Listings are one DataFrame with the columns of an advert, `features` (array of raw values) and, joined before by their id,
the columns of an evaluation, of market signals and of tracking where there are any. Empty lists and None filter nothing.
Comparisons fail for null unless said otherwise.
"""

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, labels
from ..functions.rules import floor_number
from ..functions.text import contains_ci

SCORES = [
    "overall_score",
    "finish_quality_score",
    "freshness_score",
    "move_in_readiness_score",
    "layout_score",
    "natural_light_score",
    "building_condition_score",
    "location_score",
    "value_for_money_score",
    "photo_trust_score",
]
SORTS = [
    "created_at",
    "modified_at",
    "price_value",
    "price_per_m2",
    "area_value",
    "rooms",
    "building_year",
    "distance",
    "features_count",
    "days_on_market",
    "price_vs_comparables_pct",
    "price_change_pct",
    "price_vs_transactions_pct",
    *SCORES,
]
DISMISSED = ["rejected", "unavailable"]
UNCHECKED_DAYS = 45


@dataclass
class Search:
    text: str | None = None
    voivodeships: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    districts: list[str] = field(default_factory=list)
    latitude: float | None = None
    longitude: float | None = None
    radius_m: float | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_price_per_m2: float | None = None
    max_price_per_m2: float | None = None
    max_rent: float | None = None
    min_area: float | None = None
    max_area: float | None = None
    min_rooms: int | None = None
    max_rooms: int | None = None
    min_floor: int | None = None
    max_floor: int | None = None
    exclude_ground_floor: bool = False
    exclude_top_floor: bool = False
    min_building_year: int | None = None
    max_building_year: int | None = None
    building_types: list[str] = field(default_factory=list)
    building_materials: list[str] = field(default_factory=list)
    building_heating: list[str] = field(default_factory=list)
    markets: list[str] = field(default_factory=list)
    advertiser_types: list[str] = field(default_factory=list)
    property_types: list[str] = field(default_factory=list)
    property_conditions: list[str] = field(default_factory=list)
    object_types: list[str] = field(default_factory=list)
    offer_types: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=lambda: ["active"])
    features: list[str] = field(default_factory=list)
    feature_match: str = "all"
    excluded_features: list[str] = field(default_factory=list)
    min_features_count: int | None = None
    created_after: datetime | None = None
    modified_after: datetime | None = None
    require_evaluation: bool = False
    min_scores: dict[str, float] = field(default_factory=dict)
    renovation_needed: list[str] = field(default_factory=list)
    style_tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    min_days_on_market: int | None = None
    max_days_on_market: int | None = None
    min_listings_count: int | None = None
    price_trends: list[str] = field(default_factory=list)
    max_price_vs_comparables_pct: float | None = None
    min_price_vs_comparables_pct: float | None = None
    max_price_vs_transactions_pct: float | None = None
    hide_unchecked: bool = True
    excluded_location_flags: list[str] = field(default_factory=list)
    excluded_area_flags: list[str] = field(default_factory=list)
    excluded_nuisance_flags: list[str] = field(default_factory=list)
    tracking_statuses: list[str] = field(default_factory=list)
    hide_dismissed: bool = True
    sort: str = "created_at"
    direction: str = "desc"
    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        if not 1 <= self.limit <= 200 or self.offset < 0:
            raise ValueError("limit is 1 to 200, offset 0 or more")
        if self.sort not in SORTS or self.direction not in ("asc", "desc"):
            raise ValueError(f"unknown sort {self.sort} {self.direction}")


def parsed_attributes(raw: list[str]) -> list[tuple[str, str]]:
    """key:value filters; those without either side are ignored."""
    split = [tuple(x.strip() for x in r.partition(":")[::2]) for r in raw]
    return [(k, v) for k, v in split if k and v]


def has_feature(features: Column, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(features, F.array(*map(F.lit, values))), F.lit(False))


def features_all(features: Column, wanted: list[str]) -> Column:
    """Each wanted feature in one of its raw values."""
    return reduce(Column.__and__, (has_feature(features, labels.values_of(f)) for f in wanted))


def features_any(features: Column, wanted: list[str]) -> Column:
    return has_feature(features, sorted({v for f in wanted for v in labels.values_of(f)}))


def within_radius(lat: Column, lon: Column, at_lat: float, at_lon: float, metres: float) -> Column:
    """A box first, which a scan can prune by, then the distance."""
    dy = metres / geo.METRES_PER_DEGREE * 1.01
    dx = geo.lon_degrees(metres, abs(at_lat) + dy) * 1.01
    return lat.between(at_lat - dy, at_lat + dy) & lon.between(at_lon - dx, at_lon + dx) & (geo.haversine(lat, lon, F.lit(at_lat), F.lit(at_lon)) <= metres)


def free_of_flags(has_signals: Column, flags: Column, excluded: list[str]) -> Column:
    """A listing without signals passes; so does one with none of the flags."""
    return ~has_signals | ~F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, excluded))), F.lit(False))


def price_trend(change: Column, trends: list[str]) -> Column:
    each = {"dropped": change < 0, "raised": change > 0, "unchanged": change == 0}
    return reduce(Column.__or__, (each[t] for t in trends))


def not_ground(floor: Column) -> Column:
    return floor.isNull() | (floor > 0)


def not_top(code: Column, floor: Column, floors: Column) -> Column:
    return ~code.eqNullSafe(F.lit("GARRET")) & (floor.isNull() | floors.isNull() | (floor < floors))


def conditions(q: Search, now: Column) -> list[Column]:
    c = F.col
    found: list[Column] = []
    add = found.append
    if q.statuses:
        add(c("status").isin(q.statuses))
    if q.text:
        add(c("title").ilike(f"%{q.text}%") | c("description").ilike(f"%{q.text}%"))
    for column, names in (("province_name", q.voivodeships), ("city_name", q.cities), ("district_name", q.districts)):
        if names:
            add(F.lower(column).isin([n.lower() for n in names]))
    if None not in (q.latitude, q.longitude, q.radius_m):
        add(within_radius(c("latitude"), c("longitude"), q.latitude, q.longitude, q.radius_m))
    floor = floor_number(c("floor"))
    ranges = [
        ("price_value", q.min_price, q.max_price),
        ("price_per_m2", q.min_price_per_m2, q.max_price_per_m2),
        ("area_value", q.min_area, q.max_area),
        ("rooms", q.min_rooms, q.max_rooms),
        (floor, q.min_floor, q.max_floor),
        ("building_year", q.min_building_year, q.max_building_year),
        ("days_on_market", q.min_days_on_market, q.max_days_on_market),
        ("listings_count", q.min_listings_count, None),
        ("price_vs_comparables_pct", q.min_price_vs_comparables_pct, q.max_price_vs_comparables_pct),
        ("price_vs_transactions_pct", None, q.max_price_vs_transactions_pct),
        ("created_at", q.created_after, None),
        ("modified_at", q.modified_after, None),
        *((name, least, None) for name, least in q.min_scores.items()),
    ]
    for column, least, most in ranges:
        column = c(column) if isinstance(column, str) else column
        if least is not None:
            add(column >= F.lit(least))
        if most is not None:
            add(column <= F.lit(most))
    if q.max_rent is not None:
        add(c("rent_value").isNull() | (c("rent_value") <= q.max_rent))
    if q.exclude_ground_floor:
        add(not_ground(floor))
    if q.exclude_top_floor:
        add(not_top(c("floor"), floor, c("building_floors")))
    for column, values in (
        ("building_type", q.building_types),
        ("building_material", q.building_materials),
        ("building_heating", q.building_heating),
        ("market", q.markets),
        ("advertiser_type", q.advertiser_types),
        ("property_type", q.property_types),
        ("property_condition", q.property_conditions),
        ("object_type", q.object_types),
        ("offer_type", q.offer_types),
        ("renovation_needed", q.renovation_needed),
        ("style_tag", q.style_tags),
        ("tracking_status", q.tracking_statuses),
    ):
        if values:
            add(c(column).isin(values))
    if q.features:
        add(features_all(c("features"), q.features) if q.feature_match == "all" else features_any(c("features"), q.features))
    if q.excluded_features:
        add(~features_any(c("features"), q.excluded_features))
    if q.min_features_count is not None:
        add(F.coalesce(F.size("features"), F.lit(0)) >= q.min_features_count)
    if q.require_evaluation:
        add(c("overall_score").isNotNull())
    for k, v in parsed_attributes(q.attributes):
        add(F.try_element_at(c("attributes"), F.lit(k)) == v)
    trends = [t for t in q.price_trends if t in ("dropped", "raised", "unchanged")]
    if trends:
        add(price_trend(c("price_change_pct"), trends))
    if q.hide_unchecked:
        add((c("status") != "active") | (c("scraped_at") >= now - F.expr(f"INTERVAL {UNCHECKED_DAYS} DAYS")))
    signals = c("days_on_market").isNotNull()
    for column, flags in (("area_flags", q.excluded_area_flags), ("nuisance_flags", q.excluded_nuisance_flags), ("location_flags", q.excluded_location_flags)):
        if flags:
            add(free_of_flags(signals, c(column), flags))
    if q.hide_dismissed:
        add(c("tracking_status").isNull() | ~c("tracking_status").isin(DISMISSED))
    return found


def relevance(keywords: list[str]) -> Column:
    """How many keywords the title or the description holds."""
    held = [F.coalesce((contains_ci(F.col("title"), k) | contains_ci(F.col("description"), k)).cast("int"), F.lit(0)) for k in keywords]
    return reduce(Column.__add__, held) if held else F.lit(0)


def matching(listings: DataFrame, q: Search, now: Column) -> DataFrame:
    found = conditions(q, now)
    return listings.where(reduce(Column.__and__, found)) if found else listings


def page(listings: DataFrame, q: Search, now: Column, keywords: list[str] = (), relevance_first: bool = True) -> DataFrame:
    """The page of a query in its order: nulls last either way, then the newest id; with distance_m where a point is given."""
    point = q.latitude is not None and q.longitude is not None
    distance = geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(q.latitude), F.lit(q.longitude)) if point else F.lit(None).cast("double")
    df = matching(listings, q, now).withColumn("distance_m", distance)
    key = F.col("distance_m" if point else "id") if q.sort == "distance" else F.coalesce(F.size("features"), F.lit(0)) if q.sort == "features_count" else F.col(q.sort)
    order = [key.desc_nulls_last() if q.direction == "desc" else key.asc_nulls_last(), F.col("id").desc()]
    if keywords:
        best = [relevance(list(keywords)).desc()]
        if "overall_score" in listings.columns:
            best.append(F.col("overall_score").desc_nulls_last())
        order = best + order if relevance_first else order[:1] + best + order[1:]
    return df.orderBy(*order).offset(q.offset).limit(q.limit)


def total(listings: DataFrame, q: Search, now: Column) -> DataFrame:
    return matching(listings, q, now).agg(F.count("*").alias("total"))


def joined(ads: DataFrame, **others: DataFrame) -> DataFrame:
    """Listings with evaluations, signals, tracking and inferred types, each by ad_id; a listing without stays."""
    for other in others.values():
        ads = ads.join(other.withColumnRenamed("ad_id", "id"), "id", "left")
    return ads


def similar_to(listings: DataFrame, target_id: int, within: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """Listings whose columns differ from a target's by no more than `within`, the most alike first. The target is one row."""
    target = listings.where(F.col("id") == target_id).select(*(F.col(k).alias(f"_{k}") for k in within))
    near = reduce(Column.__and__, (F.abs(F.col(k) - F.col(f"_{k}")) <= v for k, v in within.items()))
    score = reduce(Column.__add__, (F.abs(F.col(k) - F.col(f"_{k}")) * w for k, w in weights.items()))
    found = listings.where(F.col("id") != target_id).join(F.broadcast(target.limit(1)), near)
    return found.withColumn("difference", score).drop(*(f"_{k}" for k in within)).orderBy("difference", "id")
