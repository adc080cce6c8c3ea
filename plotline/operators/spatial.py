"""Spatial joins on grid cells: an equi-join on cells finds who may be near, an exact test decides.

Cells are as high as the search reaches, and in each row of them as wide as it reaches anywhere in that row or the next ones; so a position meets
nine cells at most, at any latitude, and no table has to be looked through first. No side is broadcast unless Spark finds it small.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import spread, written
from .cover import cells_at, cover, holds
from .tiles import nearest_rows


def row_of(lat: Column, metres: float | Column) -> Column:
    return geo.cell(lat, metres / geo.METRES_PER_DEGREE * 1.0001)


def highest_latitude(row: Column, metres: float | Column) -> Column:
    """Of a row of cells and the next ones."""
    return F.least((F.greatest(F.abs(row), F.abs(row + 1)) + 1) * (metres / geo.METRES_PER_DEGREE * 1.0001), F.lit(89.4))


def column_of(row: Column, lon: Column, metres: float | Column) -> Column:
    """The cell of a longitude in a row of cells."""
    return geo.cell(lon, metres / geo.METRES_PER_DEGREE * 1.0001 / F.cos(F.radians(highest_latitude(row, metres))))


def cell_of(lat: Column, lon: Column, metres: float) -> Column:
    row = row_of(lat, metres)
    return F.struct(row.alias("y"), column_of(row, lon, metres).alias("x"))


def neighbours(lat: Column, lon: Column, metres: float) -> Column:
    """The cell of a position and those around it, as struct y, x."""
    row = row_of(lat, metres)
    return F.array(*(F.struct((row + i).alias("y"), (column_of(row + i, lon, metres) + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def tight_cells(df: DataFrame, metres: str) -> DataFrame:
    """df with the cell _y, _x of its position, of a size that no two positions in one are further apart than the column metres."""
    height = F.col(metres) * (0.9999 / math.sqrt(2) / geo.METRES_PER_DEGREE)
    lowest = F.least(F.abs("_y"), F.abs(F.col("_y") + 1)) * height  # of the row's latitudes, where a degree of longitude is longest
    return df.withColumn("_y", geo.cell(F.col("latitude"), height)).withColumn("_x", geo.cell(F.col("longitude"), height / F.cos(F.radians(lowest))))


def with_cell(df: DataFrame, metres: float | Column, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """df with the cell _y, _x of its position. metres may be a column."""
    return df.withColumn("_y", row_of(F.col(lat), metres)).withColumn("_x", column_of(F.col("_y"), F.col(lon), metres))


def with_cells_around(df: DataFrame, metres: float | Column, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """df with a row for each of the nine cells _y, _x of its position and those around it, as neighbours gives them, in little code to compile."""
    row = row_of(F.col(lat), metres)
    rows = df.withColumn("_y", F.explode(F.array(row - 1, row, row + 1)))
    column = column_of(F.col("_y"), F.col(lon), metres)
    return rows.withColumn("_x", F.explode(F.array(column - 1, column, column + 1)))


def near_pairs(left: DataFrame, right: DataFrame, metres: float, keys: list[str] = (), lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pairs within so many metres with equal keys: left's columns, right's as r_*, and distance_m. Missing positions pair with none."""
    known = lambda df: df.where(geo.has_position(F.col(lat), F.col(lon)))
    a = with_cells_around(known(left), metres, lat, lon)
    r = with_cell(known(right), metres, lat, lon)
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.col("_y").alias("_ry"), F.col("_x").alias("_rx"))
    met = (F.col("_y") == F.col("_ry")) & (F.col("_x") == F.col("_rx"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"r_{k}"))
    d = geo.flat_distance(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}"))
    # left stands in nine cells and is far larger than its files tell Spark, so it is not gathered and sent to all tasks
    return a.hint("merge").join(r, met).drop("_y", "_x", "_ry", "_rx").withColumn("distance_m", d).where(F.col("distance_m") <= metres)


def nearest(left: DataFrame, right: DataFrame, metres: float, key: str, take: list[str], keys: list[str] = ()) -> DataFrame:
    """For each of left's keys the nearest of right within so many metres: key, distance_m and right's columns to take."""
    if not keys:
        return nearest_rows(left, right, 1, key, F.struct(*take), metres).select(key, "distance_m", *(F.col(f"_take.{c}").alias(c) for c in take))
    pairs = near_pairs(left.select(key, "latitude", "longitude", *keys), right, metres, keys)
    first = F.min_by(F.struct("distance_m", *(F.col(f"r_{c}").alias(c) for c in take)), F.struct("distance_m", *(f"r_{c}" for c in take)))
    return pairs.groupBy(key).agg(first.alias("n")).select(key, "n.distance_m", *(F.col(f"n.{c}").alias(c) for c in take))


#: Heights of the pyramid's cells: doubled from the first to what holds the whole earth.
LEAST_CELL_M, LEVELS = 62.5, 20


def k_nearest(left: DataFrame, right: DataFrame, k: int, key: str, right_key: str, keys: list[str] = ()) -> DataFrame:
    """key, rank (from 1), right_key, distance_m: the k nearest of right for each of left, however far; fewer only where right has fewer. Ties by right_key.

    Rows are met by tiles (tiles.py). With keys, columns that have to be equal, counts of a pyramid of cells tell, before any pair is made, in how large a cell of its own a position has k others; it looks for them in cells
    twice as high. If its k-th lies within their height they are the nearest; else that distance bounds them, and one more round looks as far as it.
    Positions that are missing have none.
    """
    c = F.col
    if not keys:
        return nearest_rows(left, right, k, key, F.col(right_key)).select(key, "rank", c("_take").alias(right_key), "distance_m")
    a = left.where(geo.has_position(c("latitude"), c("longitude"))).select(key, *keys, "latitude", "longitude")
    b = right.where(geo.has_position(c("latitude"), c("longitude"))).select(c(right_key).alias("_id"), *keys, "latitude", "longitude")
    every = list(range(LEVELS + 1))
    heights = lambda of: F.array(*(F.struct(F.lit(n).alias("_n"), F.lit(LEAST_CELL_M * 2**n).alias("_m")) for n in of))
    level = lambda df, of: with_cell(df.withColumn("_l", F.explode(heights(of))).select("*", "_l.*").drop("_l"), c("_m"))
    cell = [*keys, "_n", "_y", "_x"]
    full = level(b, every).groupBy(*cell).agg(F.count("*").alias("_held")).where(c("_held") >= k).select(*cell)
    first = level(a, every).join(full, cell, "left_semi").groupBy(key).agg((F.min("_n") + 1).alias("_at"))
    asked = written(a.join(first, key, "left").withColumn("_at", F.least(F.coalesce("_at", F.lit(LEVELS)), F.lit(LEVELS))), "asked")

    def around(wanted: DataFrame) -> DataFrame:
        """wanted (key, keys, position, _at) with up to k of right in the cells around it at level _at."""
        levels = [r._at for r in wanted.select("_at").distinct().collect()] or [0]
        wanted = with_cells_around(wanted.withColumn("_m", F.lit(LEAST_CELL_M) * F.pow(F.lit(2.0), c("_at"))), c("_m")).withColumn("_n", c("_at"))
        near = wanted.select(key, c("latitude").alias("_lat"), c("longitude").alias("_lon"), *cell).join(level(b, levels), cell)
        d = geo.flat_distance(c("_lat"), c("_lon"), c("latitude"), c("longitude"))
        order = Window.partitionBy(key).orderBy("distance_m", "_id")
        return near.select(key, "_id", d.alias("distance_m")).withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)

    found = written(around(asked), "nearest")
    reach = asked.join(found.groupBy(key).agg(F.max("rank").alias("_found"), F.max("distance_m").alias("_far")), key, "left")
    sure = (c("_at") == LEVELS) | ((c("_found") == k) & (c("_far") <= F.lit(LEAST_CELL_M) * F.pow(F.lit(2.0), c("_at"))))
    reach = reach.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    higher = F.when(c("_found") == k, F.greatest(F.ceil(F.log2(c("_far") / LEAST_CELL_M)).cast("int"), c("_at") + 1)).otherwise(LEVELS)
    again = around(reach.where("not _sure").withColumn("_at", F.least(higher, F.lit(LEVELS))).select(*asked.columns))
    done = found.join(reach.where("_sure").select(key), key, "left_semi").unionByName(again)
    return done.select(key, "rank", c("_id").alias(right_key), "distance_m")


def covering_cells(side: Column, metres: float | Column) -> Column:
    """The cells around a side, as struct y, x: it is cut into pieces no longer than the search reaches, so their number grows with its length, not with the box around it."""
    across_m = F.greatest(F.abs(side["lat2"] - side["lat1"]), F.abs(side["lon2"] - side["lon1"])) * geo.METRES_PER_DEGREE
    n = F.greatest(F.ceil(across_m / metres), F.lit(1)).cast("int")
    at = lambda k: (side["lat1"] + (side["lat2"] - side["lat1"]) * (k / n), side["lon1"] + (side["lon2"] - side["lon1"]) * (k / n))

    def around(k):
        (lat1, lon1), (lat2, lon2) = at(k), at(k + 1)
        ys = F.sequence(row_of(F.least(lat1, lat2), metres) - 1, row_of(F.greatest(lat1, lat2), metres) + 1)

        def across(y):
            xs = F.sequence(column_of(y, F.least(lon1, lon2), metres) - 1, column_of(y, F.greatest(lon1, lon2), metres) + 1)
            return F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))

        return F.flatten(F.transform(ys, across))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), around)))


def containing(points: DataFrame, areas: DataFrame, key: str, take: list[str]) -> DataFrame:
    """key and an area's columns to take, for each point inside an area (areas: sides, as geo.outer_sides gives). Of several areas the first by its columns.

    A point looks for its cell at each of the cover's levels, and finds it at one for an area at most.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    at = points.where(geo.has_position(lat, lon)).select(key, "latitude", "longitude", F.explode(cells_at(lat, lon)).alias("_c")).select(key, "latitude", "longitude", "_c.*")
    held = at.join(cover(areas, take), ["level", "y", "x"]).where(holds(lat, lon))
    return held.groupBy(key).agg(F.min(F.struct(*take)).alias("a")).select(key, *(F.col(f"a.{c}").alias(c) for c in take))


def within_area(points: DataFrame, areas: DataFrame, metres: float, key: str) -> DataFrame:
    """The keys of points inside an area or within so many metres of its border. areas: sides."""
    inside = containing(points.select(key, "latitude", "longitude"), areas.select(F.lit(True).alias("_here"), "sides"), key, ["_here"]).select(key)
    if not metres:
        return inside
    border = areas.select(F.explode("sides").alias("e")).select(F.array(F.struct(F.col("e.lat1").alias("lat"), F.col("e.lon1").alias("lon")), F.struct(F.col("e.lat2").alias("lat"), F.col("e.lon2").alias("lon"))).alias("points"))
    return inside.unionByName(nearest_line(points, border, metres, key, []).select(key)).distinct()


#: How often the reach of a search for lines is halved, and at how many places a side tells that it is in a cell.
HALVINGS, SAMPLES = 4, 8


def nearest_line(points: DataFrame, lines: DataFrame, metres: float, key: str, take: list[str], keys: list[str] = ()) -> DataFrame:
    """For each point the nearest line (lines: points, an array of struct lat, lon) within so many metres, on lines with equal keys.

    Lines are taken apart into sides, each dealt to the cells around it; so a long line is no hot spot. Of sides that lie alike one is asked, with
    the least columns to take of those that have it, as they are what a tie takes. A point in a small cell that a side passes through is sure to have
    one within that cell's size, and looks no further; so it meets few sides where there are many.
    """
    c, s, rest = F.col, F.col("side"), [x for x in take if x not in keys]
    every = lines.select(*keys, *rest, F.explode(geo.edges(c("points"))).alias("side"))
    sides = every.groupBy(*keys, "side").agg(F.min(F.struct(*rest)).alias("_t")).select(*keys, "side", "_t.*") if rest else every.distinct()
    reaches = F.explode(F.array(*(F.struct(F.lit(n).alias("_n"), F.lit(metres / 2**n).alias("_m")) for n in range(HALVINGS + 1))))
    level = lambda df: df.withColumn("_l", reaches).select("*", "_l.*").drop("_l")
    at = spread(points.where(geo.has_position(c("latitude"), c("longitude"))).select(key, *keys, "latitude", "longitude"), key)
    cell = [*keys, "_n", "_y", "_x"]
    along = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES)), lambda k: F.struct((s["lat1"] + (s["lat2"] - s["lat1"]) * (k / SAMPLES)).alias("latitude"), (s["lon1"] + (s["lon2"] - s["lon1"]) * (k / SAMPLES)).alias("longitude")))
    passed = tight_cells(level(sides.select(*keys, F.inline(along))), "_m").select(*cell).distinct()
    sure = tight_cells(level(at), "_m").join(passed, cell, "left_semi").groupBy(key, *keys, "latitude", "longitude").agg(F.max("_n").alias("_n"))
    same = F.lit(True)
    for x in (key, *keys, "latitude", "longitude"):
        same = same & c(f"p.{x}").eqNullSafe(c(f"q.{x}"))
    asked = at.alias("p").join(sure.alias("q"), same, "left").select("p.*", F.coalesce("q._n", F.lit(0)).alias("_n"))
    reach = F.lit(metres) / F.pow(F.lit(2.0), c("_n"))
    asked = asked.withColumn("_cell", F.struct(row_of(c("latitude"), reach).alias("y"), column_of(row_of(c("latitude"), reach), c("longitude"), reach).alias("x")))
    # few bytes, and many cells to make of each
    dealt = level(spread(sides, "side")).withColumn("_cell", F.explode(covering_cells(s, c("_m")))).drop("_m")
    near = asked.join(dealt, ["_cell", "_n", *keys]).withColumn("distance_m", geo.side_distance(s, c("latitude"), c("longitude"))).where(c("distance_m") <= metres)
    best = near.groupBy(key).agg(F.min(F.struct("distance_m", *take)).alias("b"))
    return best.select(key, "b.distance_m", *(c(f"b.{x}").alias(x) for x in take))


def beyond_runways(points: DataFrame, runways: DataFrame, key: str, length_m: float = 8000, half_width_m: float = 400, widening: float = 0.05) -> DataFrame:
    """key, approach_m, label: how far points lie on the extended centre line behind the end of a runway, the nearest end first.

    runways: label, points. Ends are dealt to the cells their corridor can reach, so points meet only the ends near them.
    """
    first, last = F.col("points")[0], F.element_at("points", -1)
    ends = runways.select("label", F.explode(F.array(F.struct(first.alias("a"), last.alias("b")), F.struct(last.alias("a"), first.alias("b")))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    east = (b["lon"] - a["lon"]) * geo.METRES_PER_DEGREE * F.cos(F.radians((a["lat"] + b["lat"]) / 2))
    north = (b["lat"] - a["lat"]) * geo.METRES_PER_DEGREE
    size = F.nullif(F.sqrt(east * east + north * north), F.lit(0.0))
    told = ends.select("label", b["lat"].alias("end_lat"), b["lon"].alias("end_lon"), F.coalesce(east / size, F.lit(0.0)).alias("east"), F.coalesce(north / size, F.lit(0.0)).alias("north"))
    reach = (length_m + half_width_m + widening * length_m) * 1.0001
    dealt = told.withColumn("_cell", F.explode(neighbours(F.col("end_lat"), F.col("end_lon"), reach)))
    at = points.where(geo.has_position(F.col("latitude"), F.col("longitude"))).select(key, "latitude", "longitude", cell_of(F.col("latitude"), F.col("longitude"), reach).alias("_cell"))
    dx = (F.col("longitude") - F.col("end_lon")) * geo.METRES_PER_DEGREE * F.cos(F.radians("end_lat"))
    dy = (F.col("latitude") - F.col("end_lat")) * geo.METRES_PER_DEGREE
    along, aside = dx * F.col("east") + dy * F.col("north"), F.abs(dx * F.col("north") - dy * F.col("east"))
    met = at.join(dealt, "_cell").withColumns({"along": along, "aside": aside})
    under = met.where((F.col("along") > 0) & (F.col("along") <= length_m) & (F.col("aside") <= half_width_m + F.col("along") * widening))
    return under.groupBy(key).agg(F.min(F.struct("along", "label")).alias("b")).select(key, F.bround("b.along", 0).cast("int").alias("approach_m"), "b.label")
