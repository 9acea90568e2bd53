"""Queries that write the domain's files from the given tables and read them back, each with its oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.fares import modes
from wayfare.operators import raster
from wayfare.plans import surfaces as S
from wayfare.plans.dialect import LAT, LNG, SQL_MODES, place
from wayfare.session import shared_dir, table, task_count
from wayfare.sources import readers, writers

Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _new(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query(f"SELECT printf('%06d', s_suppkey) AS node, s_name AS name, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'ส ' || s_suppkey END, '-') AS th, {LAT.format('s_suppkey')} AS lat, {LNG.format('s_suppkey')} AS lng, 'n' || s_nationkey AS line, n_name AS line_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def station_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station document: written, read, written over itself with what was read, and read again with its lines."""
    key, path = F.col("s_suppkey"), _new(spark) + ".json"
    stations = table(spark, sf_dir, "supplier").select(F.format_string("%06d", key).alias("node"), F.col("s_name").alias("name"), F.when(key % 3 > 0, F.concat(F.lit("ส "), key.cast("string"))).alias("nameTh"), *place(key), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("line"))
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("line"), F.col("n_name").alias("name"), F.lit("#123").alias("color"))
    writers.write_stations(stations, lines, path)
    writers.write_stations(readers.read_stations(spark, path), readers.read_lines(spark, path), path)
    named = readers.read_lines(spark, path).select("line", F.col("name").alias("line_name"))
    return readers.read_stations(spark, path).join(named, "line").select("node", "name", F.coalesce("nameTh", F.lit("-")).alias("th"), "lat", "lng", "line", "line_name")


@query("""SELECT stop, arg_max(q, (o, n)) AS last, count(*) AS n FROM (SELECT l_partkey AS stop, l_quantity AS q, l_orderkey AS o, l_linenumber * 1000000 + l_suppkey AS n FROM lineitem) GROUP BY stop""")
def last_stop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop table of many files in which ids come again: the last row of each wins, in the order of the files."""
    folder = _new(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.format_string("%d", "l_partkey").alias("stop_id"), F.col("l_quantity").cast("string").alias("stop_lat"), F.lit("100.5").alias("stop_lon"))
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    rows.repartitionByRange(task_count(rows), *order).sortWithinPartitions(*order).select("stop_id", "stop_lat", "stop_lon").write.option("header", True).option("quoteAll", True).csv(f"{folder}/stops.txt")
    stops = readers.read_gtfs(spark, folder, "stops", ordered=True)
    stops = stops.repartition(task_count(stops), "stop_id")  # the last of each is sorted for where it is dealt, not in each block of a file
    counts = stops.groupBy("stop_id").agg(F.count("*").alias("n"))
    return readers.last_stops(stops).join(counts, "stop_id").select(F.col("stop_id").cast("long").alias("stop"), F.col("stop_lat").alias("last"), "n")


_ROUNDED = f"(SELECT stop, round(s_lat, 5) AS s_lat, round(s_lng, 5) AS s_lng, round(ride_km, 2) AS ride_km, round(ride_min, 1) AS ride_min FROM {S._STOPS})"


@query(f"""SELECT r, c, mode, cost, round(time, 5) AS time FROM {S._ALL.replace(S._STOPS, _ROUNDED)} WHERE mode IN (SELECT mode FROM {SQL_MODES} WHERE type <> 'rail')""")
def reach_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces from a reach file that was written from the tables; the boats' file is missing, so they count as roads."""
    cells, path = raster.grid(spark), _new(spark) + ".json"
    stops = S._stops(spark, sf_dir).select(F.lit("bus").alias("mode"), F.format_string("%012d", "stop").alias("node"), F.round("s_lat", 5).alias("lat"), F.round("s_lng", 5).alias("lng"), F.round("ride_km", 2).alias("km"), F.round("ride_min", 1).alias("time_min"))
    writers.write_reach(stops, raster.density(cells, S._stands(spark, sf_dir)), path)
    return reach_surfaces(spark, path, path + ".missing").select("r", "c", "mode", "cost", F.round("time", 5).alias("time"))


def reach_surfaces(spark: SparkSession, bus_path: str, boat_path: str) -> DataFrame:
    """r, c, mode, cost, time of all but the rail modes. The plan follows what files there are: a kind without one is counted as roads."""
    cells, found = raster.grid(spark), {kind: readers.read_reach(spark, path) for kind, path in (("bus", bus_path), ("boat", boat_path))}
    dense = next((f[1] for f in found.values() if f is not None), None)
    roads = raster.road_km(cells, dense)
    out = raster.road_surface(roads, modes(spark, "road"))
    for kind, file in found.items():
        of = modes(spark, kind)
        out = out.unionByName(raster.road_surface(roads, of) if file is None else raster.stop_surface(raster.nearest_stops(cells, file[0].filter(F.col("kind") == kind)), of))
    return out


@query("""WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'phantom' WHEN c_custkey % 4 = 1 THEN 'high' ELSE 'low' END AS status, CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE 'assignment' END END AS method, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 997 END AS delta FROM customer)
    SELECT status, method, count(*) AS n, CAST(sum(delta) AS BIGINT) AS metres FROM m GROUP BY status, method""")
def match_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match document written and read back: matches by status and method, with their metres."""
    key, path = F.col("c_custkey"), _new(spark) + ".json"
    method = F.when(key % 4 > 0, F.when(key % 3 == 0, "name").otherwise("assignment"))
    rows = table(spark, sf_dir, "customer").select(key.cast("string").alias("sid"), F.when(key % 4 == 0, "phantom").when(key % 4 == 1, "high").otherwise("low").alias("status"), method.alias("method"), F.when(key % 4 > 0, key % 997).cast("long").alias("delta_m"))
    writers.write_matches(rows, path)
    return readers.read_matches(spark, path).groupBy("status", "method").agg(F.count("*").alias("n"), F.sum("delta_m").alias("metres"))
