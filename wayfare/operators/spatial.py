"""Spatial joins: points meet by hash cells in equi-joins, never as all pairs."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import haversine_km
from wayfare.session import broadcast_if_light, materialise

#: km that a degree of latitude is at least, and one of longitude at latitudes up to 60 degrees.
_LAT_KM, _LNG_KM = 110.5, 55.0


def binned(points: DataFrame, lat: str, lng: str, side: float) -> DataFrame:
    return points.withColumn("_r", F.floor(F.col(lat) / side)).withColumn("_c", F.floor(F.col(lng) / side))


def around(points: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every point once for each cell at most so many rows and columns away."""
    near = lambda n: F.explode(F.array(*map(F.lit, range(-n, n + 1))))
    return points.withColumn("_dr", near(rows)).withColumn("_dc", near(columns)).withColumn("_r", F.col("_r") + F.col("_dr")).withColumn("_c", F.col("_c") + F.col("_dc")).drop("_dr", "_dc")


def radius_join(left: DataFrame, right: DataFrame, km: float, left_at: tuple[str, str], right_at: tuple[str, str], side: float | None = None, strict: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within km of each other (less than km if strict), with their distance as `km`.

    The left side, best the smaller one, goes to each cell that its circle can touch; both meet by cell, and by the
    columns `on` if there are any.
    """
    side = side or km / _LAT_KM
    rows, columns = math.ceil(km / _LAT_KM / side), math.ceil(km / _LNG_KM / side)
    a = around(binned(left, *left_at, side), rows, columns)
    b = binned(right, *right_at, side)
    pairs = a.join(b, [*on, "_r", "_c"]).withColumn("km", haversine_km(*left_at, *right_at)).drop("_r", "_c")
    return pairs.filter(F.col("km") < km if strict else F.col("km") <= km)


def _side(metres: tuple[float, ...]) -> Column:
    """Degrees of latitude that the radius of a ring (place in metres) has at most: the side of its cells."""
    return F.element_at(F.array(*(F.lit(m * 1.001 / 1000 / _LAT_KM) for m in metres)), F.col("ring") + 1)


def _cell(points: DataFrame, lat: str, lng: str, metres: tuple[float, ...]) -> DataFrame:
    return points.withColumn("_r", F.floor(F.col(lat) / _side(metres))).withColumn("_c", F.floor(F.col(lng) / _side(metres)))


def ring_join(left: DataFrame, right: DataFrame, metres: tuple[float, ...], left_at: tuple[str, str], right_at: tuple[str, str], on: tuple[str, ...]) -> DataFrame:
    """All pairs as near as the ring (place in metres) of each left point says, with their distance as `km`; farther ones are among them.

    left goes to the cells that its circle can touch, which are written and broadcast if they are few.
    """
    (lat, lng), side = map(F.col, left_at), _side(metres)
    wide = F.least(side * (_LAT_KM / _LNG_KM), side * 1.001 / F.greatest(F.cos(F.radians(F.abs(lat) + side)), F.lit(0.001)))  # degrees of longitude
    spread = lambda x, by: F.explode(F.sequence(F.floor((x - by) / side), F.floor((x + by) / side)))
    a = materialise(left.filter(lat.isNotNull() & lng.isNotNull()).withColumn("_r", spread(lat, side)).withColumn("_c", spread(lng, wide)))
    used = sorted(r[0] for r in a.select("ring").distinct().collect())  # one for each ring at most
    b = _cell(right.withColumn("ring", F.explode(F.array(*map(F.lit, used or [0])))), *right_at, metres)
    return b.join(broadcast_if_light(a), [*on, "ring", "_r", "_c"]).withColumn("km", haversine_km(*left_at, *right_at)).drop("_r", "_c")


def first_rings(left: DataFrame, right: DataFrame, metres: tuple[float, ...], left_at: tuple[str, str], right_at: tuple[str, str], on: tuple[str, ...], *key: str) -> DataFrame:
    """left with `ring`, the same for all rows of a key: the first with a right point in the same cell, the widest where none has one."""
    every = F.explode(F.array(*map(F.lit, range(len(metres)))))
    cells = _cell(right.withColumn("ring", every), *right_at, metres).select(*on, "ring", "_r", "_c").distinct()
    found = _cell(left.withColumn("ring", every), *left_at, metres).join(cells, [*on, "ring", "_r", "_c"], "left_semi").groupBy(*key).agg(F.min("ring").alias("ring"))
    return left.join(found, list(key), "left").withColumn("ring", F.coalesce("ring", F.lit(len(metres) - 1)))


def zorder(lat: str, lng: str) -> Column:
    """A number of places that is near for most near places; 0.0007 degrees of latitude to a step."""
    y, x = F.floor((F.col(lat) + 90) / 180 * 2**18).cast("long"), F.floor((F.col(lng) + 180) / 360 * 2**18).cast("long")
    bits = [F.shiftleft(F.shiftright(of, k).bitwiseAND(1), 2 * k + odd) for k in range(18) for odd, of in enumerate((x, y))]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def cell_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], side: float) -> DataFrame:
    """All pairs whose cells touch: the three by three cells around, however far the radius would go."""
    a = around(binned(left, *left_at, side), 1, 1)
    return a.join(binned(right, *right_at, side), ["_r", "_c"])


def nearest_within(left: DataFrame, right: DataFrame, km: float, left_at: tuple[str, str], right_at: tuple[str, str]) -> DataFrame:
    """left with `km`, the way to the nearest point of right, for those that have one within km.

    Places stand for all points that share them, and are looked around in growing circles: one that finds a point within
    a circle is settled, as nothing nearer lies outside. So dense tables never meet in the widest circle.
    """
    spots = lambda df, at, names: df.select(*(F.col(c).alias(n) for c, n in zip(at, names, strict=True))).dropna().distinct()
    open_, there = materialise(spots(left, left_at, ("_a", "_b"))), materialise(spots(right, right_at, ("_lat", "_lng")))
    settled = None
    for share in (16, 4, 1):
        near = radius_join(open_, there, km / share, ("_a", "_b"), ("_lat", "_lng"))
        least = materialise(near.groupBy("_a", "_b").agg(F.min("km").alias("km")))
        settled = least if settled is None else settled.unionByName(least)
        if share > 1:
            open_ = materialise(open_.join(least, ["_a", "_b"], "left_anti"))
            if open_.isEmpty():
                break
    return left.join(settled, (F.col(left_at[0]) == F.col("_a")) & (F.col(left_at[1]) == F.col("_b"))).drop("_a", "_b")
