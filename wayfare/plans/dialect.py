"""Fragments of the oracle SQL, and the stand-ins that map the driver's tables to the domain's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.session import table


def place(key: Column) -> tuple[Column, Column]:
    """The stand-in latitude and longitude of a numeric key."""
    return (F.lit(K.LAT_LOW) + (key * 7919) % 6500 / F.lit(10000.0)).alias("lat"), (F.lit(K.LNG_LOW) + (key * 104729) % 6000 / F.lit(10000.0)).alias("lng")


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), *place(F.col(key)))


LAT = "(13.45e0 + (({0} * 7919) % 6500) / 10000.0e0)"
LNG = "(100.30e0 + (({0} * 104729) % 6000) / 10000.0e0)"


def sql_points(name: str, key: str) -> str:
    return f"(SELECT {key} AS id, {LAT.format(key)} AS lat, {LNG.format(key)} AS lng FROM {name})"


def sql_km(lat1, lng1, lat2, lng2) -> str:
    a = f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lng2}) - ({lng1})) / 2), 2))"
    return f"(12742.0e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def sql_origin_km(lat: str, lng: str) -> str:
    return sql_km("13.9133e0", "100.5957e0", lat, lng)


def sql_circuity(lat: str, lng: str) -> str:
    turn = f"((90.0e0 - degrees(atan2(({lat}) - 13.9133e0, ({lng}) - 100.5957e0))) % 360.0e0 + 360.0e0) % 360.0e0"
    rose = [*K.CIRCUITY, K.CIRCUITY[0]]
    arms = " ".join(f"WHEN {turn} < {45 * (i + 1)} THEN {rose[i]}e0 + ({rose[i + 1]}e0 - {rose[i]}e0) * (({turn}) / 45.0e0 - {i})" for i in range(8))
    return f"(CASE {arms} END)"


def sql_fare(km: str, mode: str = "mode") -> str:
    arms = []
    for m in K.MODES:
        tiers = m[7]
        if m[5] == "flat":
            out = f"{float(tiers[0][1])}e0"
        elif m[5] == "distance-based":
            out = "CASE " + " ".join(f"WHEN {km} <= {u} THEN {float(v)}e0" for u, v in tiers) + f" ELSE {float(tiers[-1][1])}e0 END"
        else:
            low, parts = 0, [f"{m[4]}e0"]
            for up, rate in tiers:
                parts.append(f"greatest(least({km}, {float(up)}e0) - {float(low)}e0, 0.0e0) * {float(rate)}e0")
                low = up
            out = f"floor({' + '.join(parts)} + 0.5e0)"
        arms.append(f"WHEN '{m[0]}' THEN {out}")
    return f"(CASE {mode} {' '.join(arms)} END)"


SQL_MODES = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m[0]}', '{m[2]}', {m[6]}e0)" for i, m in enumerate(K.MODES)) + ") AS m(pos, mode, type, speed))"
SQL_GRID = f"(SELECT i // 60 AS r, i % 60 AS c, 13.45e0 + (i // 60 + 0.5e0) * {(K.LAT_HIGH - K.LAT_LOW) / K.GRID!r}e0 AS lat, 100.30e0 + (i % 60 + 0.5e0) * {(K.LNG_HIGH - K.LNG_LOW) / K.GRID!r}e0 AS lng FROM range(3600) AS t(i))"


def sql_band(value: str, bands: list[int]) -> str:
    return "(CASE " + " ".join(f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(bands)) + " ELSE 0 END)"
