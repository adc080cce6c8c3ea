"""Labels of features, of which raw values of one meaning share one, and of codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import humanize

#: A feature's label and the raw values that mean it.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "balkon": ("balkon", "balcony"),
    "taras": ("taras", "terrace"),
    "ogródek": ("ogródek", "garden"),
    "piwnica": ("piwnica", "basement"),
    "pomieszczenie użytkowe": ("pom. użytkowe", "usable_room"),
    "strych": ("strych",),
    "oddzielna kuchnia": ("oddzielna kuchnia",),
    "mieszkanie dwupoziomowe": ("dwupoziomowe",),
    "garaż / miejsce parkingowe": ("garaż/miejsce parkingowe", "garage", "garaż"),
    "winda": ("winda", "LIFT"),
    "domofon / wideofon": ("domofon / wideofon", "ENTRYPHONE"),
    "monitoring / ochrona": ("monitoring / ochrona", "MONITORING"),
    "teren zamknięty": ("teren zamknięty", "CLOSED_AREA"),
    "drzwi / okna antywłamaniowe": ("drzwi / okna antywłamaniowe", "ANTI_BURGLARY_DOOR"),
    "rolety antywłamaniowe": ("rolety antywłamaniowe", "ROLLER_SHUTTERS"),
    "system alarmowy": ("system alarmowy", "ALARM"),
    "internet": ("internet", "INTERNET"),
    "telewizja kablowa": ("telewizja kablowa",),
    "telefon": ("telefon",),
    "klimatyzacja": ("klimatyzacja", "air_conditioning"),
    "meble": ("meble", "furniture", "umeblowanie"),
    "lodówka": ("lodówka", "fridge"),
    "piekarnik": ("piekarnik", "oven"),
    "kuchenka": ("kuchenka", "stove"),
    "pralka": ("pralka", "washing_machine"),
    "zmywarka": ("zmywarka", "dishwasher"),
    "telewizor": ("telewizor", "tv"),
    "basen": ("basen",),
    "okna plastikowe": ("PLASTIC",),
    "okna drewniane": ("WOODEN",),
    "okna aluminiowe": ("ALUMINIUM",),
    "również dla studentów": ("Wynajmę również studentom",),
    "tylko dla niepalących": ("tylko dla niepalących",),
    "dom parterowy": ("Dom parterowy",),
    "dom rekreacyjny": ("Rekreacyjny",),
    "media: prąd": ("prąd",),
    "media: woda": ("woda",),
    "media: gaz": ("gaz",),
    "media: kanalizacja": ("kanalizacja",),
    "media: szambo": ("szambo",),
    "media: przydomowa oczyszczalnia": ("oczyszczalnia",),
    "ogrzewanie gazowe": ("gazowe",),
    "ogrzewanie węglowe": ("węglowe",),
    "ogrzewanie kominkowe": ("kominkowe",),
    "ogrzewanie elektryczne": ("elektryczne",),
    "ogrzewanie olejowe": ("olejowe",),
    "ogrzewanie miejskie": ("miejskie",),
    "ogrzewanie piecami kaflowymi": ("piece kaflowe",),
    "ogrzewanie biomasą": ("biomasa",),
    "pompa ciepła": ("pompa ciepła",),
    "geotermia": ("geotermika",),
    "kolektor słoneczny": ("kolektor słoneczny",),
    "dojazd asfaltowy": ("asfaltowy",),
    "dojazd utwardzony": ("utwardzony",),
    "dojazd polny": ("polny",),
    "ogrodzenie z siatki": ("siatka",),
    "ogrodzenie murowane": ("murowane",),
    "ogrodzenie metalowe": ("metalowe",),
    "ogrodzenie drewniane": ("drewniane",),
    "ogrodzenie betonowe": ("betonowe",),
    "żywopłot": ("żywopłot",),
    "w okolicy: las": ("las",),
    "w okolicy: jezioro": ("jezioro",),
    "w okolicy: góry": ("góry",),
    "w okolicy: morze": ("morze",),
}


def label_of(value: str, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> str:
    return next((label for label, raws in synonyms.items() if value in raws), value)


def values_of(feature: str, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> list[str]:
    """The raw values that satisfy a selected feature, itself among them."""
    return sorted({feature, *synonyms.get(label_of(feature, synonyms), ())})


def label(c: Column, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """The label of a raw value; a value without one is its own."""
    known = F.create_map(*(F.lit(x) for name, raws in synonyms.items() for raw in raws for x in (raw, name)))
    return F.coalesce(F.try_element_at(known, c), c)


#: The labels of codes, by the field that holds them.
CODED: dict[str, dict[str, str]] = {
    "offer_types": {"SALE": "Kupno", "RENT": "Wynajem"},
    "object_types": {"APARTMENT": "Mieszkanie", "HOUSE": "Dom", "INVESTMENT": "Inwestycja"},
    "building_types": {
        "BLOCK": "Blok",
        "APARTMENT": "Apartamentowiec",
        "TENEMENT": "Kamienica",
        "DETACHED": "Dom wolnostojący",
        "SEMI_DETACHED": "Bliźniak",
        "RIBBON": "Szeregowiec",
        "HOUSE": "Dom",
        "INFILL": "Plomba",
        "FARM": "Siedlisko",
        "LOFT": "Loft",
        "RESIDENCE": "Rezydencja",
        "OTHER": "Inny",
    },
    "building_materials": {
        "BRICK": "Cegła",
        "BREEZEBLOCK": "Pustak",
        "CONCRETE_PLATE": "Wielka płyta",
        "SILIKAT": "Silikat",
        "REINFORCED_CONCRETE": "Żelbet",
        "CELLULAR_CONCRETE": "Beton komórkowy",
        "CONCRETE": "Beton",
        "WOOD": "Drewno",
        "HYDROTON": "Keramzyt",
        "OTHER": "Inny",
    },
    "building_heating": {"URBAN": "Miejskie", "GAS": "Gazowe", "BOILER_ROOM": "Kotłownia", "ELECTRICAL": "Elektryczne", "TILED_STOVE": "Piece kaflowe", "OTHER": "Inne"},
    "markets": {"PRIMARY": "Pierwotny", "SECONDARY": "Wtórny", "ALL": "Bez podziału", "": "Nie podano"},
    "advertiser_types": {"business": "Biuro lub deweloper", "private": "Osoba prywatna"},
    "property_conditions": {"READY_TO_USE": "Do zamieszkania", "TO_COMPLETION": "Do wykończenia", "TO_RENOVATION": "Do remontu"},
    "property_ownership": {"FULL_OWNERSHIP": "Pełna własność", "LIMITED_OWNERSHIP": "Spółdzielcze własnościowe", "SHARE": "Udział", "USUFRUCT": "Użytkowanie"},
    "property_types": {"FLAT": "Mieszkanie"},
    "style_tags": {
        "MODERN": "Nowoczesny",
        "SCANDINAVIAN": "Skandynawski",
        "MINIMALIST": "Minimalistyczny",
        "CLASSIC": "Klasyczny",
        "INDUSTRIAL": "Industrialny",
        "GLAMOUR": "Glamour",
        "RUSTIC": "Rustykalny",
        "DATED": "Przestarzały",
        "WORN": "Zniszczony",
        "RAW": "Surowy",
        "UNKNOWN": "Nieokreślony",
    },
    "renovation_needed": {"none": "Nic do zrobienia", "cosmetic": "Odświeżenie", "partial": "Remont częściowy", "full": "Remont generalny"},
}


def code_label(c: Column, field: str) -> Column:
    """The label of a field's code; of an unknown one its words. Null has none."""
    known = F.create_map(*(F.lit(x) for pair in CODED[field].items() for x in pair))
    return F.coalesce(F.try_element_at(known, c), humanize(c))
