"""The nearest rows by tiles: rows are cut into tiles of about as many along a curve that keeps neighbours together, and a position meets few of them.

What a tile's box and count tell bounds how far a position's k-th can be. It looks into the nearest tile first, and what it finds there says which
others can hold one that is nearer. So pairs grow with the positions, not with the rows around them, and a position far from all rows meets
the tiles on the side it looks at. Boxes and counts (40 bytes for each ROWS rows) are sent to the tasks.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions import geo
from ..session import spread, written

#: Rows of a tile, and positions that a task compares with tiles or rows at once.
ROWS, AT_ONCE = 2048, 128
SLACK = 1 + 1e-9


def _bits_apart(v: np.ndarray) -> np.ndarray:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << shift) & mask
    return v


def _coded(batches):
    for b in batches:
        y, x = (np.clip((b.column(c).to_numpy() + half) / (2 * half) * (1 << 26), 0, (1 << 26) - 1).astype(np.int64) for c, half in (("latitude", 90), ("longitude", 180)))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_bits_apart(y) << 1 | _bits_apart(x))], [*b.schema.names, "_code"])


def _dealt(cuts: np.ndarray, batches):
    for b in batches:
        tile = np.searchsorted(cuts, b.column("_code").to_numpy(), side="right").astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile)], [*b.schema.names, "_tile"])


class Boxes:
    """The boxes of tiles, and bounds of the distance from other boxes (or positions) to them."""

    def __init__(self, tile, n, south, north, west, east):
        self.tile, self.n, self.south, self.north, self.west, self.east = tile, n, south, north, west, east

    def of(self, k: np.ndarray) -> "Boxes":
        return Boxes(*(x[k] for x in (self.tile, self.n, self.south, self.north, self.west, self.east)))

    def bounds(self, south, north, west, east) -> tuple[np.ndarray, np.ndarray]:
        """Least and most metres, on planes at the mean latitude as flat_distance has them."""
        low, high = np.radians((south + self.south) / 2), np.radians((north + self.north) / 2)
        a, b = np.cos(low), np.cos(high)
        least, most = np.maximum(np.minimum(a, b), 0), np.where((low <= 0) & (high >= 0), 1.0, np.maximum(a, b))
        dy, dx = np.maximum(np.maximum(self.south - north, south - self.north), 0), np.maximum(np.maximum(self.west - east, west - self.east), 0)
        ey, ex = np.maximum(self.north - south, north - self.south), np.maximum(self.east - west, east - self.west)
        return np.hypot(dy, dx * least) * geo.METRES_PER_DEGREE, np.hypot(ey, ex * most) * geo.METRES_PER_DEGREE

    def near(self, lat: np.ndarray, lon: np.ndarray, bound: np.ndarray | None, k: int) -> "Boxes":
        """Those that can hold one of the k nearest of any of the positions; bound: how far each of these looks."""
        least, most = self.bounds(lat.min(), lat.max(), lon.min(), lon.max())
        return self.of(np.flatnonzero(least <= (self.holding(most[None, :], k)[0] if bound is None else bound.max()) * SLACK))

    def holding(self, most: np.ndarray, k: int) -> np.ndarray:
        """For each row of bounds how far k rows are at most; infinite if there are fewer."""
        order = np.argsort(most, axis=1)
        held = np.cumsum(self.n[order], axis=1) >= k
        at = np.take_along_axis(most, order, axis=1)
        return np.where(held.any(axis=1), at[np.arange(len(at)), np.argmax(held, axis=1)], np.inf)


def _chunks(lat: np.ndarray, lon: np.ndarray, code: np.ndarray):
    order = np.argsort(code, kind="stable")
    for i in range(0, len(order), AT_ONCE):
        at = order[i : i + AT_ONCE]
        yield at, lat[at], lon[at]


def _places(t) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in ("latitude", "longitude", "_code")]


def _first(boxes: Boxes, k: int, metres: float, batches):
    """Positions with the tile they look into first, and how far their k-th is at most."""
    for b in batches:
        tile, bound = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
        for at, lat, lon in _chunks(*_places(b)):
            able = boxes.near(lat, lon, None, k)
            least, most = able.bounds(lat[:, None], lat[:, None], lon[:, None], lon[:, None])
            tile[at] = able.tile[np.argmin(least + most * 1e-6, axis=1)]
            bound[at] = np.minimum(able.holding(most, k), metres)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile), pa.array(bound)], [*b.schema.names, "_tile", "_bound"])


def _found(boxes: Boxes | None, k: int, asked: pa.Table, rows: pa.Table) -> pa.Table:
    """What positions find in one tile (those that may be among their k nearest), and, with boxes, which others they have to look into."""
    names = ["_key", "latitude", "longitude", "_code"]
    kinds = [*(asked.schema.field(c).type for c in names), pa.int64(), *[pa.float64()] * 3, rows.schema.field("_take").type, pa.bool_()]
    out = [pa.table([pa.nulls(0, kind) for kind in kinds], names=FOUND)]  # a tile may have no positions
    y, x = (rows.column(c).to_numpy() for c in ("latitude", "longitude"))
    bounds, own = asked.column("_bound").to_numpy(), asked.column("_tile").to_numpy()
    for at, lat, lon in _chunks(*_places(asked)):
        bound = bounds[at]
        if len(y):
            d = np.hypot(y - lat[:, None], (x - lon[:, None]) * np.cos(np.radians((y + lat[:, None]) / 2))) * geo.METRES_PER_DEGREE
            if len(y) >= k:
                bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(d <= bound[:, None] * SLACK + 1e-6)
            told = asked.select(names).take(pa.array(at[i]))
            out.append(pa.table([*told.columns, pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.float64()), pa.array(y[j]), pa.array(x[j]), rows.column("_take").take(pa.array(j)), pa.array(np.ones(len(i), bool))], names=FOUND))
        if boxes is not None:
            able = boxes.near(lat, lon, bound, k)
            least, _ = able.bounds(lat[:, None], lat[:, None], lon[:, None], lon[:, None])
            i, j = np.nonzero((least <= bound[:, None] * SLACK + 1e-6) & (able.tile != own[at][:, None]))
            told = asked.select(names).take(pa.array(at[i]))
            none = pa.nulls(len(i), pa.float64())
            out.append(pa.table([*told.columns, pa.array(able.tile[j]), pa.array(bound[i]), none, none, pa.nulls(len(i), rows.schema.field("_take").type), pa.array(np.zeros(len(i), bool))], names=FOUND))
    return pa.concat_tables(out)


FOUND = ["_key", "latitude", "longitude", "_code", "_tile", "_bound", "r_latitude", "r_longitude", "_take", "_found"]


def nearest_rows(left: DataFrame, right: DataFrame, k: int, key: str, take: Column, metres: float = float("inf")) -> DataFrame:
    """key, rank (from 1), take, distance_m: the k nearest rows of right for each of left within so many metres, ties by take. Both have latitude, longitude; a zero is a position that is missing."""
    c = F.col
    known = geo.has_position(c("latitude"), c("longitude"))
    at = [c(x).cast("double").alias(x) for x in ("latitude", "longitude")]
    code = lambda df: df.mapInArrow(_coded, StructType([*df.schema.fields, StructField("_code", LongType())]))
    # of rows at one position k do, so no tile is much larger than others
    here = Window.partitionBy("latitude", "longitude").orderBy("_take")
    rows = right.where(known).select(take.alias("_take"), *at).withColumn("_r", F.row_number().over(here)).where(c("_r") <= k).drop("_r")
    rows = written(code(rows), "rows")
    many = rows.count()
    tiles = max(1, -(-many // ROWS))
    parts = [i / tiles for i in range(1, tiles)]
    cuts = np.unique(np.array(rows.select(F.percentile_approx("_code", parts, max(10_000, 10 * tiles))).first()[0] if parts else [], np.int64))
    rows = rows.mapInArrow(partial(_dealt, cuts), StructType([*rows.schema.fields, StructField("_tile", LongType())]))
    told = rows.groupBy("_tile").agg(F.count("*"), F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).collect()
    asked = code(spread(left.where(known).select(c(key).alias("_key"), *at), "_key"))
    out = StructType([*asked.schema.fields, StructField("_tile", LongType()), StructField("_bound", DoubleType()), StructField("r_latitude", DoubleType()), StructField("r_longitude", DoubleType()), StructField("_take", rows.schema["_take"].dataType), StructField("_found", BooleanType())])
    boxes = Boxes(*(np.array(x) for x in (zip(*told) if told else [[]] * 6)))
    if told:
        asked = asked.mapInArrow(partial(_first, boxes, k, metres), StructType(out.fields[:6]))
        first = written(asked.groupBy("_tile").cogroup(rows.groupBy("_tile")).applyInArrow(partial(_found, boxes, k), out), "nearest")
        more = first.where("not _found").select(*out.names[:6])
        second = more.groupBy("_tile").cogroup(rows.groupBy("_tile")).applyInArrow(partial(_found, None, k), out)
        found = first.where("_found").unionByName(second)
    else:
        found = left.sparkSession.createDataFrame([], out)
    d = geo.flat_distance(c("latitude"), c("longitude"), c("r_latitude"), c("r_longitude"))
    order = Window.partitionBy("_key").orderBy("distance_m", "_take")
    near = found.select("_key", "_take", d.alias("distance_m")).where(c("distance_m") <= metres)
    return near.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select(c("_key").alias(key), "rank", "_take", "distance_m")
