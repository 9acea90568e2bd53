"""Rasters: the grid, mode surfaces, best of modes, bands and their outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.functions.fares import minutes, mode_fare, modes, walk_minutes
from wayfare.functions.geo import circuity, origin_km
from wayfare.operators.spatial import cell_join, radius_join
from wayfare.session import materialise


def grid(spark: SparkSession) -> DataFrame:
    """r, c, lat, lng of each cell's centre; row 0 is the southernmost."""
    at = lambda low, high, i: F.lit(low) + (i + 0.5) * F.lit((high - low) / K.GRID)
    cells = spark.range(K.GRID * K.GRID).select((F.col("id") / K.GRID).cast("int").alias("r"), (F.col("id") % K.GRID).cast("int").alias("c"))
    return cells.select("r", "c", at(K.LAT_LOW, K.LAT_HIGH, F.col("r")).alias("lat"), at(K.LNG_LOW, K.LNG_HIGH, F.col("c")).alias("lng"))


def density(cells: DataFrame, stands: DataFrame) -> DataFrame:
    """stands (stand_lat, stand_lng, drivers) to r, c, drivers, density: within 500 m, as a share of the greatest."""
    near = radius_join(cells, stands, K.TRANSFER_KM, ("lat", "lng"), ("stand_lat", "stand_lng"))
    sums = near.groupBy("r", "c").agg(F.sum("drivers").cast("long").alias("drivers"))
    full = cells.select("r", "c").join(sums, ["r", "c"], "left").fillna(0, ["drivers"])
    most = full.agg(F.max("drivers").alias("most"))  # one row
    share = F.when(F.col("most") > 0, F.round(F.col("drivers") / F.col("most"), 3)).otherwise(F.col("drivers").cast("double"))
    return full.crossJoin(F.broadcast(most)).select("r", "c", "drivers", share.alias("density"))


def rail_surface(cells: DataFrame, stations: DataFrame, of_modes: DataFrame) -> DataFrame:
    """stations (s_lat, s_lng, rail_km): the least fare and the least time over stations within 2 km, each for itself."""
    near = radius_join(cells, stations.filter("rail_km IS NOT NULL"), K.WALK_KM, ("lat", "lng"), ("s_lat", "s_lng"))
    costed = near.crossJoin(F.broadcast(of_modes))
    return costed.groupBy("r", "c", "mode").agg(F.min(mode_fare("rail_km")).alias("cost"), F.min(minutes("rail_km", F.col("speed")) + walk_minutes("km")).alias("time"))


def nearest_stops(cells: DataFrame, stops: DataFrame) -> DataFrame:
    """stops (stop, s_lat, s_lng, ride_km, ride_min): each cell's stop of least ride and walk, seen in its own and the touching hash cells and within 2 km."""
    from wayfare.functions.geo import haversine_km

    pairs = cell_join(cells, stops.filter("ride_km IS NOT NULL"), ("lat", "lng"), ("s_lat", "s_lng"), K.CELL)
    pairs = pairs.withColumn("walk", haversine_km("lat", "lng", "s_lat", "s_lng")).filter(F.col("walk") <= K.WALK_KM)
    first = F.min(F.struct((F.col("ride_km") + F.col("walk")).alias("total"), "_r", "_c", "stop", "ride_km", "ride_min", "walk"))
    return pairs.groupBy("r", "c").agg(first.alias("x")).select("r", "c", "x.stop", "x.ride_km", "x.ride_min", "x.walk", "x.total")


def stop_surface(nearest: DataFrame, of_modes: DataFrame) -> DataFrame:
    """Fare by the ride of the nearest stop, time by its minutes and the walk."""
    return nearest.crossJoin(F.broadcast(of_modes)).select("r", "c", "mode", mode_fare("ride_km").alias("cost"), (F.col("ride_min") + walk_minutes("walk")).alias("time"))


def road_km(cells: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """road_km of each cell: straight way, circuity, and the discount of supply density where there is some."""
    rows = cells if dense is None else cells.join(dense.select("r", "c", "density"), ["r", "c"], "left")
    straight = origin_km("lat", "lng") * circuity("lat", "lng")
    if dense is not None:
        straight = straight * F.when(F.col("density") > 0, 1 - F.lit(K.DENSITY_DISCOUNT) * F.col("density")).otherwise(1.0)
    return rows.select("r", "c", straight.alias("road_km"))


def road_surface(roads: DataFrame, of_modes: DataFrame) -> DataFrame:
    return roads.crossJoin(F.broadcast(of_modes)).select("r", "c", "mode", mode_fare("road_km").alias("cost"), minutes("road_km", F.col("speed")).alias("time"))


def all_modes(spark: SparkSession, stations: DataFrame, buses: DataFrame | None, boats: DataFrame | None, stands: DataFrame) -> DataFrame:
    """r, c, mode, cost, time over all modes. Bus or boat modes without reach data (None) are counted as roads."""
    cells = grid(spark)
    roads = road_km(cells, density(cells, stands))
    parts = [rail_surface(cells, stations, modes(spark, "rail")), road_surface(roads, modes(spark, "road"))]
    for kind, stops in (("bus", buses), ("boat", boats)):
        parts.append(road_surface(roads, modes(spark, kind)) if stops is None else stop_surface(nearest_stops(cells, stops), modes(spark, kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_of_modes(surfaces: DataFrame) -> DataFrame:
    """r, c, cost, time, cost_mode: the least over modes, each for itself."""
    first = F.min(F.struct("cost", "mode")).alias("x")
    return surfaces.groupBy("r", "c").agg(F.min("cost").alias("cost"), F.min("time").alias("time"), first).select("r", "c", "cost", "time", F.col("x.mode").alias("cost_mode"))


def masks(surface: DataFrame, value: str, bands: list[int]) -> DataFrame:
    """band, r, c of each cell that a band's threshold takes in; inner bands are in the outer ones."""
    limits = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(float(b)).alias("limit")) for i, b in enumerate(bands)))
    return surface.select("r", "c", F.col(value).alias("value"), F.explode(limits).alias("b")).filter("value <= b.limit").select("b.band", "r", "c")


# corner offsets (row, column) of each side, in walking order
SIDES = {"south": (-1, 0, (0, 0), (0, 1)), "east": (0, 1, (0, 1), (1, 1)), "north": (1, 0, (1, 1), (1, 0)), "west": (0, -1, (1, 0), (0, 0))}


def outline(mask: DataFrame) -> DataFrame:
    """band, side, r, c and the corners r1, c1, r2, c2 of each cell side that faces a cell outside of the mask."""
    sides = F.array(
        *(
            F.struct(F.lit(name).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(a[0]).alias("ar"), F.lit(a[1]).alias("ac"), F.lit(b[0]).alias("br"), F.lit(b[1]).alias("bc"))
            for name, (dr, dc, a, b) in SIDES.items()
        )
    )
    faces = mask.withColumn("s", F.explode(sides)).select("band", "r", "c", "s.*").withColumn("nr", F.col("r") + F.col("dr")).withColumn("nc", F.col("c") + F.col("dc"))
    held = mask.select("band", F.col("r").alias("nr"), F.col("c").alias("nc"))
    open_ = faces.join(held, ["band", "nr", "nc"], "left_anti")
    corner = lambda base, off: (F.col(base) + F.col(off)).cast("int")
    return open_.select("band", "side", "r", "c", corner("r", "ar").alias("r1"), corner("c", "ac").alias("c1"), corner("r", "br").alias("r2"), corner("c", "bc").alias("c2"))


def successors(sides: DataFrame) -> DataFrame:
    """band, id, next: which side of an outline begins where a side ends; where cells touch by a corner, the one of the same cell."""
    ends = sides.select("band", "id", "r", "c", F.col("r2").alias("r1"), F.col("c2").alias("c1"))
    begins = sides.select("band", "r1", "c1", F.col("id").alias("next"), F.col("r").alias("nr"), F.col("c").alias("nc"))
    other = (F.col("r") != F.col("nr")) | (F.col("c") != F.col("nc"))
    return ends.join(begins, ["band", "r1", "c1"]).groupBy("band", "id").agg(F.min(F.struct(other, "next"))["next"].alias("next"))


def rings(sides: DataFrame) -> DataFrame:
    """band, i, lat, lng: corners in walking order of the outline that holds a band's first side (by row, column, then in the order of SIDES).

    Other components and holes have no row, nor rings of one or two corners; the ring is not closed. A corner that is
    passed twice keeps its first place. The places come from pointer doubling over the links from each side to the one
    before it, cut at the first side: after k rounds a side knows its way back over 2^k others, so a ring takes as many
    rounds as its length has binary digits, and no task holds a whole ring.
    """
    named = sides.withColumn("id", (F.col("r").cast("long") * (1 << 24) + F.col("c")) * len(SIDES) + F.array_position(F.array(*map(F.lit, SIDES)), F.col("side")) - 1)
    named = materialise(named)
    first = named.groupBy("band").agg(F.min("id").alias("first"))  # a row for each band
    back = successors(named).select("band", F.col("next").alias("id"), F.col("id").alias("to")).join(F.broadcast(first), "band")
    at_first = F.col("id") == F.col("first")
    way = materialise(back.select("band", "id", F.when(~at_first, F.col("to")).alias("to"), F.when(at_first, 0).otherwise(1).cast("long").alias("i")))
    done = 0
    while True:
        on = way.select("band", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("i").alias("i2"))
        ahead = way.filter("to IS NOT NULL").join(on, ["band", "to"]).select("band", "id", F.col("to2").alias("to"), (F.col("i") + F.col("i2")).alias("i"))
        way = materialise(way.filter("to IS NULL").unionByName(ahead))
        known = way.filter("to IS NULL").count()
        if known == done:  # what is left runs in other rings
            break
        done = known
    corners = named.join(way.filter("to IS NULL").select("band", "id", "i"), ["band", "id"]).groupBy("band", F.col("r1").alias("r"), F.col("c1").alias("c")).agg(F.min("i").cast("int").alias("i"))
    drawn = corners.groupBy("band").agg(F.count("*").alias("n")).filter("n > 2").select("band")
    at = lambda low, high, n: F.round(F.lit(low) + F.col(n) * F.lit(high - low) / F.lit(K.GRID), 5)
    return corners.join(F.broadcast(drawn), "band").select("band", "i", at(K.LAT_LOW, K.LAT_HIGH, "r").alias("lat"), at(K.LNG_LOW, K.LNG_HIGH, "c").alias("lng"))
