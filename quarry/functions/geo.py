"""Distances, grids and shapes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Earth's radius in metres: in serving and in cleaning.
SERVING, CLEANING = 6_371_008.8, 6_371_000.0
METRES_A_DEGREE = 111_195.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SERVING) -> Column:
    """Great-circle distance in metres; null if a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    clamped = F.when(a > 1.0, 1.0).when(a < 0.0, 0.0).otherwise(a)
    return 2 * radius * F.asin(F.sqrt(clamped))


def decay(distance: Column, cap: float = 0.35, metres: float = 5000.0) -> Column:
    """cap * exp(-d / metres), the cap below one; null distance scores zero."""
    return F.when(distance.isNotNull(), min(0.99, cap) * F.exp(-F.greatest(F.lit(0.0), distance) / metres)).otherwise(0.0)


def bbox(lat: Column, lon: Column, radius: float) -> tuple[Column, Column]:
    """Half-heights in degrees of a box that holds the circle."""
    return F.lit(radius / METRES_A_DEGREE) + lat * 0, radius / (METRES_A_DEGREE * F.greatest(F.lit(0.2), F.abs(F.cos(F.radians(lat)))))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def finite(lat: Column, lon: Column) -> Column:
    ok = lambda x, most: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)
    return ok(lat, 90.0) & ok(lon, 180.0)


class Grid:
    """Cells of the globe in which every circle of `metres` lies within the cell of its centre and the eight around it.

    Rows are bands of latitude at least `metres` high. A band is divided into as many columns as leave each at least as
    wide as a circle reaches at the band's far edge: fewer towards the poles, one at them. Columns wrap around.
    """

    def __init__(self, metres: float, size: float = 0.0, radius: float = CLEANING):
        self.angle = metres / radius  # of the circle, seen from the centre of the earth
        self.size = max(size, math.degrees(self.angle) * 1.000001)

    def row(self, lat: Column) -> Column:
        return cell(lat, self.size)

    def columns(self, row: Column) -> Column:
        """How many columns a row has. A circle that touches the row reaches asin(sin(angle) / cos(latitude)) of longitude
        from its centre, which lies at most a row's height beyond the row's edges."""
        edge = F.greatest(F.abs(row), F.abs(row + 1)) * self.size + self.size
        shrink = math.sin(min(self.angle, math.pi / 2)) / F.cos(F.radians(edge))
        reach = F.when((edge >= 90) | (shrink >= 1), 360.0).otherwise(F.degrees(F.asin(shrink)) * 1.000001)
        return F.greatest(F.lit(1), F.floor(360.0 / reach)).cast("long")

    def column(self, lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)

    def home(self, rows: DataFrame, lat: str, lon: str) -> DataFrame:
        """The rows with the cell (r, c) of their point; rows without finite coordinates go."""
        return self._placed(rows.filter(finite(F.col(lat), F.col(lon))).withColumn("r", self.row(F.col(lat))), lon)

    def around(self, rows: DataFrame, lat: str, lon: str) -> DataFrame:
        """The rows once for each distinct cell (r, c) that a circle about their point may touch; rows without finite
        coordinates go. Fixed steps are exploded, so that each row of cells is divided once."""
        near = rows.filter(finite(F.col(lat), F.col(lon))).withColumn("_i", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        placed = self._placed(near.withColumn("r", self.row(F.col(lat)) + F.col("_i")), lon, keep=True).withColumn("_j", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        # of one column there is no other, of two the one after is the one before
        apart = F.when(F.col("_j") == 0, True).when(F.col("_j") == 1, F.col("_n") >= 2).otherwise(F.col("_n") >= 3)
        return placed.filter(apart).withColumn("c", F.pmod(F.col("c") + F.col("_j"), F.col("_n"))).drop("_i", "_j", "_n")

    def _placed(self, rows: DataFrame, lon: str, keep: bool = False) -> DataFrame:
        placed = rows.withColumn("_n", self.columns(F.col("r")))
        placed = placed.withColumn("c", self.column(F.col(lon), F.col("_n")))
        return placed if keep else placed.drop("_n")


def near_pairs(left: DataFrame, right: DataFrame, metres: float, size: float = 0.0, radius: float = CLEANING, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left (columns id, lat, lon) and right (id2, lat2, lon2) nearer than `metres`, with distance_m, at every
    latitude and across the date line, and with equal values in the columns `on`. Points without finite coordinates have no
    pairs.

    The distance join becomes an equi-join on grid cells: each left point is looked up in its cell and the eight around
    it; a crowded cell is split by the skew join of the adaptive planner. Neither side is ever broadcast: the planner takes
    rows that a few compressed columns yield for far fewer than they are. Bounds that need no trigonometry decide nearly all
    pairs; the distance is computed for those at the circle's edge and, once, for the pairs found.
    """
    grid = Grid(metres, size, radius)
    reach = grid.around(left.withColumn("_c", F.cos(F.radians("lat"))), "lat", "lon")
    homes = grid.home(right.withColumn("_c2", F.cos(F.radians("lat2"))), "lat2", "lon2")
    y, x, both = F.radians(F.col("lat2") - F.col("lat")) / 2, F.radians(F.col("lon2") - F.col("lon")) / 2, F.col("_c") * F.col("_c2")
    # haversine(), where no coordinate is null
    d = 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(F.sin(y), 2) + both * F.pow(F.sin(x), 2)))))
    # t**2 - t**4 / 3 <= sin(t)**2 <= t**2 for every t; the margin is far above rounding
    most, margin = math.sin(min(grid.angle, math.pi) / 2) ** 2, 1e-9
    inside = y * y + both * (x * x) < most * (1 - margin)
    outside = y * y * (1 - y * y / 3) + both * (x * x * (1 - x * x / 3)) > most * (1 + margin)
    near = reach.join(homes.hint("merge"), ["r", "c", *on]).filter(~outside & (inside | (d < metres)))
    return near.withColumn("distance_m", d).drop("r", "c", "_c", "_c2")


def hundredths(metres: Column) -> Column:
    """A distance rounded to centimetres as SQL's double round does it, without a decimal number for each."""
    return F.floor(metres * 100 + 0.5) / 100


def covers(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over a ring: array of structs (lat, lon), closed or not."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        between = (a["lat"] > lat) != (b["lat"] > lat)
        return between & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])

    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False))))
    return hits % 2 == 1


def decode_polyline(encoded: Column) -> Column:
    """Encoded polyline (varint deltas of 1e-5 degrees) to an array of structs (lon, lat).

    Characters fold into (numbers so far, number being read, its shift); the numbers alternate latitude and longitude
    deltas, whose running sums are the points.
    """
    start = F.struct(F.array().cast("array<long>").alias("done"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"))

    def read(acc, ch):
        v = F.ascii(ch) - 63
        value = (acc["value"] + v.bitwiseAND(31).cast("long") * F.pow(F.lit(2), acc["shift"]).cast("long")).cast("long")
        half = F.floor(value / 2).cast("long")
        signed = F.when(value % 2 == 1, -half - 1).otherwise(half)
        ended = F.struct(F.concat(acc["done"], F.array(signed)).alias("done"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"))
        more = F.struct(acc["done"].alias("done"), value.alias("value"), (acc["shift"] + 5).alias("shift"))
        return F.when(v < 32, ended).otherwise(more)

    deltas = F.aggregate(F.filter(F.split(encoded, ""), lambda c: c != ""), start, read, lambda acc: acc["done"])
    total = lambda k, i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda s, j: s + F.get(deltas, 2 * j + k))
    count = F.floor(F.size(deltas) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((total(1, i) / 1e5).alias("lon"), (total(0, i) / 1e5).alias("lat")))
    return F.when(count > 0, points).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))


def display_distance(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.round(metres).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_number(metres / 1000, 1), F.lit(" km")))
