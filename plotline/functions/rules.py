"""Rules that fill in what an advert leaves out, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in titles and codes by which kinds of objects are told.
LETTER = "a-ząćęłńóśźż"
HOUSE_TITLE = (
    f"((^|[^{LETTER}])(dom|domek|domu|domy|domów|domki|willa|segment|siedlisko|rezydencja|bliźniak|blizniak)"
    f"([^{LETTER}]|$)|bliźniacz|blizniacz|szeregow|szeregówk|parterow|wolnostoj|działk|dzialk)"
)
FLAT_TITLE = "(mieszkani|kawalerk|apartament|garsonier|kamienic|pokój|pokoj|pokoi|[0-9] ?-?pok|studio|loft|penthouse)"
HOUSE_BUILDINGS = ["DETACHED", "SEMI_DETACHED", "FARM", "RESIDENCE"]
FLAT_BUILDINGS = ["BLOCK", "APARTMENT", "TENEMENT", "INFILL", "LOFT"]
SALE_MARKETS = ["PRIMARY", "SECONDARY"]
INVESTMENT_URL = "/inwestycja/"
RENT_BELOW = 30_000
KNOWN_END = ["removed_by_user", "removed_by_parent_ad"]
ROOM_WORDS = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX"]
FLOOR_WORDS = ["GROUND", "FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH"]


def offer_type(stored: Column, market: Column, price: Column) -> Column:
    return F.coalesce(stored, F.when(market.isin(SALE_MARKETS), "SALE").when(price < RENT_BELOW, "RENT").otherwise("SALE"))


def object_type(url: Column, stored: Column, floor: Column, building: Column, property_type: Column, title: Column) -> Column:
    """The first of: an investment's address, what is stored, a floor, the building, the property, words of the title."""
    return (
        F.when(F.contains(F.coalesce(url, F.lit("")), F.lit(INVESTMENT_URL)), "INVESTMENT")
        .when(stored.isNotNull(), stored)
        .when(floor.isNotNull(), "APARTMENT")
        .when(building.isin(HOUSE_BUILDINGS), "HOUSE")
        .when((property_type == "FLAT") | building.isin(FLAT_BUILDINGS), "APARTMENT")
        .when(F.lower(title).rlike(HOUSE_TITLE), "HOUSE")
        .when(F.lower(title).rlike(FLAT_TITLE), "APARTMENT")
    )


def floor_number(code: Column) -> Column:
    """Of a search: ground 0, cellar -1, above ten 11, FLOOR_n n; anything else null."""
    return (
        F.when(code == "GROUND_FLOOR", 0)
        .when(code == "CELLAR", -1)
        .when(code == "FLOOR_HIGHER_10", 11)
        .when(code.rlike("^FLOOR_[0-9]+$"), F.substring(code, 7, 10).try_cast("int"))
    )


def floor_of_sale(code: Column) -> Column:
    """Of a comparison with sales: only ground and FLOOR_n."""
    return F.when(code == "GROUND_FLOOR", 0).when(code.rlike("^FLOOR_[0-9]+$"), F.substring(code, 7, 10).try_cast("int"))


def word_number(c: Column, words: list[str], first: int) -> Column:
    """The number a word of the list stands for; digits as they are."""
    place = F.array_position(F.array(*map(F.lit, words)), c)
    return F.when(place > 0, (place + (first - 1)).cast("int")).otherwise(c.try_cast("int"))


def rooms_number(c: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, ROOM_WORDS)), c)
    return F.when(place > 0, place.cast("int"))


def listing_end(status: Column, scraped: Column, modified: Column, now: Column, stale: str = "45 days") -> Column:
    """struct ended_at, known, seen_until: when an advert ended, and whether that is known or inferred from the last look at it."""
    last = F.coalesce(scraped, modified)
    unseen = (status == "active") & F.coalesce(now - F.expr(f"INTERVAL {stale}") > last, F.lit(False))
    gone = status.isin(KNOWN_END) & modified.isNotNull()
    ended = F.when(unseen, last).when(status == "active", F.lit(None)).when(gone, F.least(modified, F.coalesce(scraped, modified))).otherwise(last)
    known = F.when(unseen, False).when(status == "active", True).otherwise(F.coalesce(gone, F.lit(False)))
    return F.struct(ended.alias("ended_at"), known.alias("known"), F.when(unseen, last).alias("seen_until"))


def market_position(price: Column, median: Column, p25: Column, p75: Column) -> Column:
    """struct quarter, difference_pct of a price against its market."""
    quarter = F.when(price < p25, "cheapest").when(price > p75, "dearest").when(price.isNotNull() & median.isNotNull(), "middle")
    return F.struct(quarter.alias("quarter"), F.bround((price / median - 1) * 100, 0).cast("int").alias("difference_pct"))


def request_outcome(screening_status: Column, rejection: Column, evaluation_status: Column, ad_status: Column, evaluation_error: Column, screening_error: Column) -> Column:
    """struct status, message of a request for an evaluation."""
    said = lambda s, m: F.struct(F.lit(s).alias("status"), m.cast("string").alias("message"))
    return (
        F.when(screening_status == "rejected", said("rejected", rejection))
        .when(evaluation_status.isin("ok", "no_images"), said("done", F.lit(None)))
        .when(~F.coalesce(ad_status == "active", F.lit(False)), said("failed", F.lit("Ogłoszenie nie jest już aktywne.")))
        .when(F.coalesce(evaluation_error, F.lit("")) != "", said("failed", evaluation_error))
        .when(F.coalesce(screening_error, F.lit("")) != "", said("failed", screening_error))
        .otherwise(said("failed", F.lit("Nie udało się ocenić ogłoszenia.")))
    )


def liveness(updated: Column, now: Column, seconds: int = 180) -> Column:
    return F.when(updated.isNull(), "unknown").when(now - F.expr(f"INTERVAL {seconds} SECONDS") > updated, "stale").otherwise("alive")
