"""Geometry as column expressions: degrees in, km out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.constants import CELL, CIRCUITY, EARTH_KM, ORIGIN

Num = Column | str | float


def _col(x: Num) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else F.col(x) if isinstance(x, str) else x


def haversine_km(lat1: Num, lng1: Num, lat2: Num, lng2: Num) -> Column:
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2.0)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def origin_km(lat: Num, lng: Num) -> Column:
    return haversine_km(*ORIGIN, lat, lng)


def rounded(x: Num, digits: int) -> Column:
    """Rounded as SQL engines do it: the scaled double to a whole number, half away from zero.

    F.round goes by the decimal text, which differs where scaling makes a tie: 13.549999999999999 is 13.5 there, and 13.6 here.
    """
    scale = F.lit(10.0**digits)
    return F.round(_col(x) * scale) / scale


def cell(degrees: Num) -> Column:
    return F.floor(_col(degrees) / F.lit(CELL)).cast("long")


def bearing(lat: Num, lng: Num) -> Column:
    """Clockwise from north, from plain degree differences to the origin, 0 up to 360."""
    turn = F.degrees(F.atan2(_col(lat) - F.lit(ORIGIN[0]), _col(lng) - F.lit(ORIGIN[1])))
    return F.pmod(F.lit(90.0) - turn, F.lit(360.0))


def circuity(lat: Num, lng: Num) -> Column:
    """Road length over straight length, linear between the bearings of the rose."""
    place = bearing(lat, lng) / 45
    i = F.floor(place).cast("int") % 8
    rose = F.array(*map(F.lit, [*CIRCUITY, CIRCUITY[0]]))
    a, b = F.element_at(rose, i + 1), F.element_at(rose, i + 2)
    return a + (b - a) * (place - F.floor(place))


def band(value: Num, bands: list[int]) -> Column:
    """Index of the first band that reaches the value; 0 where none does."""
    out = F.lit(0)
    for i in range(len(bands) - 1, -1, -1):
        out = F.when(_col(value) <= bands[i], i).otherwise(out)
    return out.cast("int")


def segment_share(lat: Num, lng: Num, lat1: Num, lng1: Num, lat2: Num, lng2: Num) -> Column:
    """Where on a segment (0 to 1, in plain degrees) the nearest place to a point lies; 0 for a segment without length."""
    lat, lng, lat1, lng1, lat2, lng2 = map(_col, (lat, lng, lat1, lng1, lat2, lng2))
    dy, dx = lat2 - lat1, lng2 - lng1
    square = dy * dy + dx * dx
    t = ((lat - lat1) * dy + (lng - lng1) * dx) / F.nullif(square, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
