"""Writers of the domain's documents. Each is one JSON file, written in parts by many tasks and swapped into place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.sources.files import keyed, listed, write_document


def write_reach(reached: DataFrame, density: DataFrame, path: str) -> None:
    """reached (mode, node, lat, lng, km, time_min) and density (r, c, density) as nested arrays, stops in the order of node."""
    names = {"bus": "bus_stops", "boat": "boat_piers", "rail": "rail_stations"}
    section = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("mode"))
    order = F.struct(F.lit(0).cast("long").alias("n"), F.col("node").cast("string").alias("k"))
    stops = reached.select(section.alias("section"), order.alias("ord"), F.to_json(F.array("lat", "lng", "km", "time_min")).alias("fragment")).filter("section IS NOT NULL")
    row = F.transform(F.array_sort(F.collect_list(F.struct("c", "density"))), lambda s: s["density"])  # a row of the raster
    raster = density.groupBy("r").agg(F.to_json(row).alias("fragment"))
    rows = raster.select(F.lit("moto_density").alias("section"), F.struct(F.col("r").cast("long").alias("n"), F.lit("").alias("k")).alias("ord"), "fragment")
    write_document(stops.unionByName(rows), [(n, "list") for n in (*names.values(), "moto_density")], path)


def write_stations(stations: DataFrame, lines: DataFrame, path: str) -> None:
    """The station file of stations (node, ...) and lines (line, ...); also in place of the file that these were read from."""
    write_document(keyed(lines, "lines", "line").unionByName(keyed(stations, "stations", "node")), [("lines", "map"), ("stations", "map")], path)


def write_matches(matches: DataFrame, path: str) -> None:
    """{matches, stats}: by station, and counts by status and by method."""
    counts = matches.select(F.explode(F.array("status", "method")).alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    name = F.regexp_extract(F.to_json(F.struct("k")), r"^\{\"k\":(.*)\}$", 1)
    stats = counts.select(F.lit("stats").alias("section"), F.struct(F.lit(0).cast("long").alias("n"), "k").alias("ord"), F.concat(name, F.lit(":"), F.col("n").cast("string")).alias("fragment"))
    write_document(keyed(matches, "matches", "sid").unionByName(stats), [("matches", "map"), ("stats", "map")], path)


def write_list(rows: DataFrame, path: str, name: str = "stations", order: str | None = None) -> None:
    """{name: rows, count}, in the order of a column if one is given."""
    write_document(listed(rows, name, order), [(name, "list"), ("count", f"count:{name}")], path)
