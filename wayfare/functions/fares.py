"""Fares and minutes of the travel modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.constants import MODES, WALK_SPEED

SCHEMA = (
    "pos int, mode string, name string, type string, color string, base double, formula string, speed double, "
    "tiers array<struct<up:double,value:double>>"
)


def modes(spark: SparkSession, kind: str = "all", mode: str | None = None) -> DataFrame:
    """The mode dimension in file order, of one type or one mode if asked for."""
    rows = [(i, *m[:7], [(float(u), float(v)) for u, v in m[7]]) for i, m in enumerate(MODES)]
    rows = [r for r in rows if kind in ("all", r[3]) and mode in (None, r[1])]
    return spark.createDataFrame(rows, SCHEMA)


def fare(km: Column, formula: Column, base: Column, tiers: Column) -> Column:
    """flat: the first tier's; distance-based: the first tier that reaches, else the last; metered and per-km: base
    and each tier's share of the way, rounded half up; what lies beyond the last tier is free. Else the base."""
    reach = F.filter(tiers, lambda t: km <= t["up"])
    stepped = F.coalesce(F.try_element_at(reach, F.lit(1))["value"], F.element_at(tiers, -1)["value"])
    state = F.struct(base.alias("sum"), F.lit(0.0).alias("low"))
    ride = lambda s, t: F.struct((s["sum"] + F.greatest(F.least(km, t["up"]) - s["low"], F.lit(0.0)) * t["value"]).alias("sum"), t["up"].alias("low"))
    metered = F.floor(F.aggregate(tiers, state, ride, lambda s: s["sum"]) + 0.5).cast("double")
    return (
        F.when(formula == "flat", F.element_at(tiers, 1)["value"])
        .when(formula == "distance-based", stepped)
        .when(formula.isin("metered", "per-km"), metered)
        .otherwise(base)
    )


def mode_fare(km: Column | str) -> Column:
    """The fare where the mode's columns are at hand."""
    return fare(F.col(km) if isinstance(km, str) else km, F.col("formula"), F.col("base"), F.col("tiers"))


def minutes(km: Column | str, speed: Column | float) -> Column:
    km = F.col(km) if isinstance(km, str) else km
    return km / (F.lit(speed) if isinstance(speed, int | float) else speed) * 60


def walk_minutes(km: Column | str) -> Column:
    return minutes(km, WALK_SPEED)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")
