"""Queries on fares, geometry, spatial joins and rasters, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.functions.fares import half_up, minutes, mode_fare, modes, walk_minutes
from wayfare.functions.geo import band, cell, circuity, haversine_km, origin_km
from wayfare.operators import graph, raster
from wayfare.plans.dialect import LAT, LNG, SQL_GRID, SQL_MODES, points, sql_band, sql_circuity, sql_fare, sql_km, sql_origin_km, sql_points
from wayfare.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_RIDES = "(SELECT CAST(l_quantity AS DOUBLE) AS km, count(*) AS rides FROM lineitem WHERE l_quantity <= 30 GROUP BY 1)"


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rides (line items) there are of each length up to 30 km."""
    km = F.col("l_quantity").cast("double").alias("km")
    return table(spark, sf_dir, "lineitem").filter("l_quantity <= 30").groupBy(km).agg(F.count("*").alias("rides"))


@query(f"SELECT mode, km, rides, {sql_fare('km')} AS fare, CAST(floor(km / speed * 60 + 0.5e0) AS BIGINT) AS minutes FROM {SQL_MODES}, {_RIDES}")
def fare_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fare and rounded minutes of each mode at each length that rides have."""
    km = _rides(spark, sf_dir).crossJoin(F.broadcast(modes(spark)))  # a fixed table of modes
    return km.select("mode", "km", "rides", mode_fare("km").alias("fare"), half_up(minutes("km", F.col("speed"))).alias("minutes"))


@query(f"""SELECT mode, count(*) AS n, round(sum({sql_fare('km')}), 4) AS total, round(avg({sql_fare('km')}), 6) AS mean
    FROM (SELECT (o_orderkey * 37 % 1200) / 10.0e0 AS km FROM orders), {SQL_MODES} GROUP BY mode""")
def fare_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and mean fare of each mode over the distances of the orders; equal distances are counted before they are costed."""
    km = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 37 % 1200 / F.lit(10.0)).alias("km")).groupBy("km").agg(F.count("*").alias("k"))
    costed = km.crossJoin(F.broadcast(modes(spark))).select("mode", "k", (mode_fare("km") * F.col("k")).alias("cost"))
    n = F.sum("k")
    return costed.groupBy("mode").agg(n.cast("long").alias("n"), F.round(F.sum("cost"), 4).alias("total"), F.round(F.sum("cost") / n, 6).alias("mean"))


@query(f"""SELECT km, mode, type, fare, CAST(row_number() OVER (PARTITION BY km ORDER BY fare, pos) AS INT) AS rank,
    CAST(row_number() OVER (PARTITION BY km, type ORDER BY fare, pos) AS INT) AS type_rank
    FROM (SELECT pos, mode, type, km, {sql_fare('km')} AS fare FROM {SQL_MODES}, {_RIDES})""")
def mode_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes by fare at each length of rides, of all and of their type; equal fares in file order."""
    rows = _rides(spark, sf_dir).crossJoin(F.broadcast(modes(spark))).withColumn("fare", mode_fare("km"))
    w, own = Window.partitionBy("km").orderBy("fare", "pos"), Window.partitionBy("km", "type").orderBy("fare", "pos")
    return rows.select("km", "mode", "type", "fare", F.row_number().over(w).alias("rank"), F.row_number().over(own).alias("type_rank"))


_ORIGIN_KM = sql_origin_km("lat", "lng")


@query(f"SELECT id, round({_ORIGIN_KM}, 6) AS km, round({_ORIGIN_KM} / 5.0e0 * 60, 6) AS walk FROM {sql_points('customer', 'c_custkey')} WHERE {_ORIGIN_KM} <= 10")
def haversine_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points up to 10 km from the origin with the walk."""
    return points(spark, sf_dir, "customer", "c_custkey").withColumn("d", origin_km("lat", "lng")).filter("d <= 10").select("id", F.round("d", 6).alias("km"), F.round(walk_minutes("d"), 6).alias("walk"))


_ROAD = f"({_ORIGIN_KM} * {sql_circuity('lat', 'lng')})"


@query(f"""SELECT id, round({sql_circuity('lat', 'lng')}, 6) AS factor, round({_ROAD}, 6) AS road_km, round({_ROAD} / 11.0e0 * 60, 5) AS minutes FROM {sql_points('customer', 'c_custkey')}""")
def circuity_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuity, road length and taxi minutes of each point."""
    km = origin_km("lat", "lng") * circuity("lat", "lng")
    return points(spark, sf_dir, "customer", "c_custkey").select("id", F.round(circuity("lat", "lng"), 6).alias("factor"), F.round(km, 6).alias("road_km"), F.round(minutes(km, 11.0), 5).alias("minutes"))


_NODES = " UNION ALL ".join(f"SELECT '{k}_' || id AS node, '{k}' AS kind, lat, lng FROM {sql_points(t, c)}" for k, t, c in (("rail", "supplier", "s_suppkey"), ("bus", "customer", "c_custkey"), ("boat", "part", "p_partkey")))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [points(spark, sf_dir, t, c).select(F.concat(F.lit(f"{k}_"), F.col("id").cast("string")).alias("node"), F.lit(k).alias("kind"), "lat", "lng") for k, t, c in (("rail", "supplier", "s_suppkey"), ("bus", "customer", "c_custkey"), ("boat", "part", "p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH n AS ({_NODES}) SELECT a.node AS src, b.node AS dst, round({sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 6) AS km FROM n a JOIN n b
    ON a.node < b.node AND (a.kind <> b.kind OR a.kind = 'bus') AND abs(a.lat - b.lat) < 0.006 AND {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 0.5""")
def walk_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of at most 500 m between stops of different kinds, or two bus stops."""
    return graph.transfers(_nodes(spark, sf_dir)).select("src", "dst", F.round("km", 6).alias("km"))


_STOPS = "(SELECT id AS stop, lat AS s_lat, lng AS s_lng, (id * 37 % 300) / 10.0e0 AS ride_km, (id * 37 % 300) / 10.0e0 / 12.0e0 * 60 AS ride_min FROM " + sql_points("customer", "c_custkey") + ")"
_NEAREST = f"""(SELECT r, c, stop, ride_km, ride_min, walk FROM (
    SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY ride_km + walk, floor(s_lat / 0.005e0), floor(s_lng / 0.005e0), stop) AS k FROM (
        SELECT g.r, g.c, s.*, {sql_km('g.lat', 'g.lng', 's_lat', 's_lng')} AS walk FROM {SQL_GRID} g JOIN {_STOPS} s
        ON abs(floor(g.lat / 0.005e0) - floor(s_lat / 0.005e0)) <= 1 AND abs(floor(g.lng / 0.005e0) - floor(s_lng / 0.005e0)) <= 1) WHERE walk <= 2) WHERE k = 1)"""


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ride = F.col("id") * 37 % 300 / F.lit(10.0)
    return points(spark, sf_dir, "customer", "c_custkey").select(F.col("id").alias("stop"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), ride.alias("ride_km"), minutes(ride, 12.0).alias("ride_min"))


@query(f"SELECT r, c, stop, round(ride_km, 6) AS ride_km, round(walk, 6) AS walk, round(ride_min + walk / 5.0e0 * 60, 5) AS minutes FROM {_NEAREST}")
def nearest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's stop of least ride and walk."""
    found = raster.nearest_stops(raster.grid(spark), _stops(spark, sf_dir))
    return found.select("r", "c", "stop", F.round("ride_km", 6).alias("ride_km"), F.round("walk", 6).alias("walk"), F.round(F.col("ride_min") + walk_minutes("walk"), 5).alias("minutes"))


_DENSITY = f"""(SELECT r, c, drivers, CASE WHEN max(drivers) OVER () > 0 THEN round(drivers / CAST(max(drivers) OVER () AS DOUBLE), 3) ELSE 0.0e0 END AS density FROM (
    SELECT g.r, g.c, CAST(coalesce(sum(1 + s.id % 50), 0) AS BIGINT) AS drivers FROM {SQL_GRID} g LEFT JOIN {sql_points('supplier', 's_suppkey')} s
    ON abs(g.lat - s.lat) < 0.006 AND {sql_km('g.lat', 'g.lng', 's.lat', 's.lng')} <= 0.5 GROUP BY g.r, g.c))"""


def _stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "supplier", "s_suppkey").select(F.col("lat").alias("stand_lat"), F.col("lng").alias("stand_lng"), (1 + F.col("id") % 50).alias("drivers"))


@query(f"SELECT r, c, drivers, density FROM {_DENSITY}")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers within 500 m of each cell."""
    return raster.density(raster.grid(spark), _stands(spark, sf_dir))


_STATIONS = "(SELECT lat AS s_lat, lng AS s_lng, (id * 13 % 400) / 10.0e0 AS rail_km FROM " + sql_points("supplier", "s_suppkey") + ")"
_RAIL = f"""(SELECT r, c, mode, min({sql_fare('rail_km')}) AS cost, min(rail_km / speed * 60 + walk / 5.0e0 * 60) AS time FROM (
    SELECT g.r, g.c, s.rail_km, {sql_km('g.lat', 'g.lng', 's_lat', 's_lng')} AS walk FROM {SQL_GRID} g JOIN {_STATIONS} s ON abs(g.lat - s_lat) < 0.02), {SQL_MODES}
    WHERE walk <= 2 AND type = 'rail' GROUP BY r, c, mode)"""


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "supplier", "s_suppkey").select(F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), (F.col("id") * 13 % 400 / F.lit(10.0)).alias("rail_km"))


@query(f"SELECT r, c, mode, cost, round(time, 5) AS time FROM {_RAIL}")
def rail_cell_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least fare and least time by rail of each cell."""
    found = raster.rail_surface(raster.grid(spark), _stations(spark, sf_dir), modes(spark, "rail"))
    return found.select("r", "c", "mode", "cost", F.round("time", 5).alias("time"))


_ROADS = f"""(SELECT g.r, g.c, {sql_origin_km('g.lat', 'g.lng')} * {sql_circuity('g.lat', 'g.lng')} * (CASE WHEN d.density > 0 THEN 1 - 0.15e0 * d.density ELSE 1.0e0 END) AS road_km
    FROM {SQL_GRID} g JOIN {_DENSITY} d ON g.r = d.r AND g.c = d.c)"""
_ALL = f"""(SELECT r, c, mode, cost, time FROM {_RAIL}
    UNION ALL SELECT r, c, mode, {sql_fare('road_km')}, road_km / speed * 60 FROM {_ROADS}, {SQL_MODES} WHERE type IN ('road', 'boat')
    UNION ALL SELECT r, c, mode, {sql_fare('ride_km')}, ride_min + walk / 5.0e0 * 60 FROM {_NEAREST}, {SQL_MODES} WHERE type = 'bus')"""


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.all_modes(spark, _stations(spark, sf_dir), _stops(spark, sf_dir), None, _stands(spark, sf_dir))


@query(f"SELECT r, c, mode, cost, round(time, 5) AS time FROM {_ALL}")
def mode_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes' surfaces; boats have no reach data here and are counted as roads."""
    return _surfaces(spark, sf_dir).select("r", "c", "mode", "cost", F.round("time", 5).alias("time"))


_BEST = f"(SELECT r, c, min(cost) AS cost, min(time) AS time, arg_min(mode, (cost, mode)) AS cost_mode FROM {_ALL} GROUP BY r, c)"


@query(f"SELECT r, c, cost, round(time, 5) AS time, cost_mode FROM {_BEST}")
def multimodal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all modes in each cell."""
    return raster.best_of_modes(_surfaces(spark, sf_dir)).select("r", "c", "cost", F.round("time", 5).alias("time"), "cost_mode")


@query(f"""SELECT view, band, count(*) AS n FROM (SELECT 'cost' AS view, {sql_band('cost', K.COST_BANDS)} AS band FROM {_BEST} WHERE cost <= 300
    UNION ALL SELECT 'time', {sql_band('round(time, 5)', K.TIME_BANDS)} FROM {_BEST} WHERE round(time, 5) <= 120) GROUP BY view, band""")
def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each band of each view has."""
    best = raster.best_of_modes(_surfaces(spark, sf_dir)).withColumn("time", F.round("time", 5))
    views = F.array(*(F.struct(F.lit(v).alias("view"), F.when(F.col(v) <= b[-1], band(v, b)).alias("band")) for v, b in (("cost", K.COST_BANDS), ("time", K.TIME_BANDS))))
    return best.select(F.explode(views).alias("x")).select("x.*").filter("band IS NOT NULL").groupBy("view", "band").agg(F.count("*").alias("n"))


_MASK = "(SELECT b.band, r, c FROM (SELECT r, c, road_km / 11.0e0 * 60 AS time FROM " + _ROADS + "), (VALUES " + ", ".join(f"({i}, {b})" for i, b in enumerate(K.TIME_BANDS)) + ") AS b(band, up) WHERE round(time, 5) <= up)"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = raster.road_km(raster.grid(spark), raster.density(raster.grid(spark), _stands(spark, sf_dir)))
    return raster.masks(roads.select("r", "c", F.round(minutes("road_km", 11.0), 5).alias("time")), "time", K.TIME_BANDS)


_SIDES = f"""(SELECT band, side, m.r, m.c, CAST(m.r + ar AS INT) AS r1, CAST(m.c + ac AS INT) AS c1, CAST(m.r + br AS INT) AS r2, CAST(m.c + bc AS INT) AS c2
    FROM m, (VALUES {", ".join(f"('{n}', {dr}, {dc}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, (dr, dc, a, b) in raster.SIDES.items())}) AS s(side, dr, dc, ar, ac, br, bc)
    WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.band = m.band AND o.r = m.r + dr AND o.c = m.c + dc))"""


@query(f"WITH m AS {_MASK} SELECT * FROM {_SIDES}")
def contour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of each time band's mask of the taxi surface."""
    return raster.outline(_mask(spark, sf_dir))


def _walk_sql(mask: str) -> str:
    return f"""WITH RECURSIVE m AS MATERIALIZED {mask}, s AS MATERIALIZED {_SIDES},
    nx AS MATERIALIZED (SELECT a.band, a.r, a.c, a.side, min({{'other': (a.r, a.c) <> (b.r, b.c), 'r': b.r, 'c': b.c, 'side': b.side}}) AS n FROM s a JOIN s b ON a.band = b.band AND a.r2 = b.r1 AND a.c2 = b.c1 GROUP BY a.band, a.r, a.c, a.side),
    f AS (SELECT band, min({{'r': r, 'c': c, 'k': list_position({list(raster.SIDES)}, side), 'side': side}}) AS f FROM s GROUP BY band),
    w AS (SELECT band, f.r AS r, f.c AS c, f.side AS side, 0 AS i, f FROM f
        UNION ALL SELECT w.band, n.r, n.c, n.side, i + 1, f FROM w JOIN nx ON nx.band = w.band AND nx.r = w.r AND nx.c = w.c AND nx.side = w.side WHERE (n.r, n.c, n.side) <> (f.r, f.c, f.side)),
    k AS (SELECT s.band, s.r1, s.c1, min(i) AS i FROM w JOIN s ON s.band = w.band AND s.r = w.r AND s.c = w.c AND s.side = w.side GROUP BY s.band, s.r1, s.c1)
    SELECT CAST(band AS INT) AS band, CAST(i AS INT) AS i, round({K.LAT_LOW}e0 + r1 * {K.LAT_HIGH - K.LAT_LOW!r}e0 / 60, 5) AS lat, round({K.LNG_LOW}e0 + c1 * {K.LNG_HIGH - K.LNG_LOW!r}e0 / 60, 5) AS lng
    FROM k WHERE band IN (SELECT band FROM k GROUP BY band HAVING count(*) > 2)"""


@query(_walk_sql(_MASK))
def contour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring of corners for each band."""
    return raster.rings(raster.outline(_mask(spark, sf_dir)))


@query(_walk_sql("(SELECT band, r, c FROM (SELECT r, c, count(*) AS n FROM (SELECT CAST(floor((lat - 13.45e0) / 0.02e0) AS INT) AS r, CAST(floor((lng - 100.30e0) / 0.02e0) AS INT) AS c FROM " + sql_points("customer", "c_custkey") + ") GROUP BY r, c), (VALUES (0, 3), (1, 2), (2, 1)) AS b(band, least) WHERE n >= least)"))
def customer_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of where customers are dense: ragged masks with holes, islands and cells that touch by corners."""
    at = lambda c, low: F.floor((F.col(c) - low) / F.lit(0.02)).cast("int")
    cells = points(spark, sf_dir, "customer", "c_custkey").groupBy(at("lat", K.LAT_LOW).alias("r"), at("lng", K.LNG_LOW).alias("c")).agg(F.count("*").alias("n"))
    levels = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(3 - i).alias("least")) for i in range(3)))
    mask = cells.withColumn("b", F.explode(levels)).filter("n >= b.least").select("b.band", "r", "c")
    return raster.rings(raster.outline(mask))


@query(f"""SELECT id, CAST(floor({LAT.format('c_custkey')} / 0.005e0) AS BIGINT) AS cell_r, CAST(floor({LNG.format('c_custkey')} / 0.005e0) AS BIGINT) AS cell_c
    FROM (SELECT c_custkey AS id, * FROM customer) WHERE {LAT.format('c_custkey')} BETWEEN 13.5e0 AND 14.0e0 AND {LNG.format('c_custkey')} BETWEEN 100.3e0 AND 100.9e0""")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the station box with their hash cells."""
    low, high, west, east = K.STATION_BOX
    inside = F.col("lat").between(low, high) & F.col("lng").between(west, east)
    return points(spark, sf_dir, "customer", "c_custkey").filter(inside).select("id", cell("lat").alias("cell_r"), cell("lng").alias("cell_c"))


@query(f"""SELECT s.id AS station, {sql_band('round(' + sql_origin_km('s.lat', 's.lng') + ', 6)', [5, 10, 20, 40])} AS band, min(round({sql_km('s.lat', 's.lng', 'c.lat', 'c.lng')}, 6)) AS nearest_km
    FROM {sql_points('supplier', 's_suppkey')} s JOIN {sql_points('customer', 'c_custkey')} c ON abs(s.lat - c.lat) < 0.02 AND {sql_km('s.lat', 's.lng', 'c.lat', 'c.lng')} <= 2 GROUP BY 1, 2""")
def station_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with their band from the origin and the nearest point within 2 km."""
    from wayfare.operators.spatial import nearest_within

    a = points(spark, sf_dir, "supplier", "s_suppkey").withColumnsRenamed({"id": "station", "lat": "a_lat", "lng": "a_lng"})
    near = nearest_within(a, points(spark, sf_dir, "customer", "c_custkey"), K.WALK_KM, ("a_lat", "a_lng"), ("lat", "lng"))
    from_origin = F.round(haversine_km(*K.ORIGIN, "a_lat", "a_lng"), 6)
    return near.groupBy("station", band(from_origin, [5, 10, 20, 40]).alias("band")).agg(F.min(F.round("km", 6)).alias("nearest_km"))
