"""Positions as latitude and longitude in degrees; shapes as arrays of points. All in Column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320
EARTH_M = 6_371_000


def has_position(lat: Column, lon: Column) -> Column:
    """A zero is a position that is missing."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane at the mean latitude: right to a few metres at city scale."""
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b))


def cell(value: Column, size: float | Column) -> Column:
    return F.floor(value / size).cast("long")


def lon_degrees(metres: float, highest_latitude: float) -> float:
    """How many degrees of longitude hold the metres anywhere up to the latitude."""
    return metres / (METRES_PER_DEGREE * max(math.cos(math.radians(min(abs(highest_latitude), 89.0))), 0.01))


def edges(points: Column) -> Column:
    """The sides of a line or ring (an array of struct lat, lon), in order, as struct lat1, lon1, lat2, lon2."""
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), after, lambda p, q: F.struct(p["lat"].alias("lat1"), p["lon"].alias("lon1"), q["lat"].alias("lat2"), q["lon"].alias("lon2"))
    )


def inside(sides: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies inside the rings whose sides are given: it crosses an odd number of them on its way east."""

    def crosses(e):
        at = (e["lon2"] - e["lon1"]) * (lat - e["lat1"]) / (e["lat2"] - e["lat1"]) + e["lon1"]
        return ((e["lat1"] > lat) != (e["lat2"] > lat)) & (lon < at)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def side_distance(e: Column, lat: Column, lon: Column) -> Column:
    """Metres from a point to a side, on the plane at the point's latitude."""
    scale = F.cos(F.radians(lat))
    x1, y1 = (e["lon1"] - lon) * scale, e["lat1"] - lat
    dx, dy = (e["lon2"] - e["lon1"]) * scale, e["lat2"] - e["lat1"]
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / length)))
    px, py = x1 + t * dx, y1 + t * dy
    return F.sqrt(px * px + py * py) * METRES_PER_DEGREE


def boundary_distance(sides: Column, lat: Column, lon: Column) -> Column:
    return F.array_min(F.transform(sides, lambda e: side_distance(e, lat, lon)))


def line_length(points: Column) -> Column:
    return F.aggregate(edges(points), F.lit(0.0), lambda acc, e: acc + flat_distance(e["lat1"], e["lon1"], e["lat2"], e["lon2"]))


def outer_sides(rings: Column) -> Column:
    """The sides of all rings but those two parts of an area share, which are not on its boundary."""
    every = F.flatten(F.transform(rings, edges))
    turned = F.transform(
        every,
        lambda e: F.when((e["lat1"] < e["lat2"]) | (e["lat1"] == e["lat2"]) & (e["lon1"] <= e["lon2"]), e).otherwise(
            F.struct(e["lat2"].alias("lat1"), e["lon2"].alias("lon1"), e["lat1"].alias("lat2"), e["lon1"].alias("lon2"))
        ),
    )
    ordered = F.array_sort(turned)  # equal ones stand next to each other
    alone = lambda e, i: ~F.coalesce(F.get(ordered, i - 1) == e, F.lit(False)) & ~F.coalesce(F.get(ordered, i + 1) == e, F.lit(False))
    return F.filter(ordered, alone)


def rings_area_km2(rings: Column) -> Column:
    """The areas of outer rings that do not overlap, each from the sum of its sides on the plane at the ring's mean latitude."""

    def one(ring):
        mean = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p["lat"]) / F.size(ring)
        twice = F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + e["lon1"] * e["lat2"] - e["lon2"] * e["lat1"])
        return F.abs(twice) / 2 * F.cos(F.radians(mean))

    return F.aggregate(F.transform(rings, one), F.lit(0.0), lambda acc, x: acc + x) * METRES_PER_DEGREE * METRES_PER_DEGREE / 1e6
