"""Readers of the domain's files, all with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TIERS = "array<struct<maxKm double, {0} double>>"
MODES = f"modes array<struct<id string, name string, nameTh string, type string, color string, baseFare double, fareFormula string, fareTable {_TIERS.format('fare')}, perKmRate {_TIERS.format('rate')}, avgSpeedKmh double, operatingHours string, description string>>"
STATIONS = "lines map<string, struct<name string, color string>>, stations map<string, struct<name string, nameTh string, lat double, lng double, line string>>"
EDGES = "`from` string, `to` string, type string"
FEATURES = "features array<struct<geometry struct<type string, coordinates string>, properties map<string, string>>>"
OSM = "osm_id long, lat double, lon double, name string, name_en string, name_th string, ref string, network string, line string, operator string, railway string, public_transport string, station string"
MATCHES = "matches map<string, struct<status string, method string, line string, osm_lat double, osm_lng double, osm_name_en string, osm_name_th string, delta_m long>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows of a file scan with ord, by which they are in file order: file, the block of it that was read, place in the block.

    A block is read by one task from its start on, so counting up inside a task keeps its rows in order; no sort and no
    second pass is needed, however the files are split. Must be applied to the scan itself.
    """
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("ord"))


def _csv(spark: SparkSession, path: str, schema: str, ordered: bool = False) -> DataFrame:
    """Columns by the file's header, those of the schema kept and cast; what doesn't cast is null. With `ordered` also ord."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    raw = in_file_order(raw) if ordered else raw
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return raw.select(*(["ord"] if ordered else []), *((F.trim(F.col(n)) if n in raw.columns else F.lit(None).cast("string")).try_cast(t).alias(n) for n, t in fields))


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """pos, mode, name, type, color, base, formula, speed, tiers: the columns of functions.fares.modes."""
    rows = _json(spark, path, MODES).select(F.posexplode("modes").alias("pos", "m"))
    unify = lambda a, v: F.transform(a, lambda t: F.struct(t["maxKm"].alias("up"), t[v].alias("value")))
    tiers = F.coalesce(unify(F.col("m.fareTable"), "fare"), unify(F.col("m.perKmRate"), "rate"))
    names = {"id": "mode", "name": "name", "type": "type", "color": "color", "baseFare": "base", "fareFormula": "formula", "avgSpeedKmh": "speed"}
    return rows.select("pos", *(F.col(f"m.{a}").alias(b) for a, b in names.items()), tiers.alias("tiers"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, STATIONS).select(F.explode("stations").alias("node", "s")).select("node", "s.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, STATIONS).select(F.explode("lines").alias("line", "l")).select("line", "l.*")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, EDGES).select(F.col("from").alias("src"), F.col("to").alias("dst"), "type")


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "from string, to string, weight int, type string").withColumnsRenamed({"from": "src", "to": "dst"})


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """ord, kind, properties and points (array of lat, lng; the file has lng first) of Point and LineString features."""
    rows = _json(spark, path, FEATURES).select(F.posexplode("features").alias("ord", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    swap = lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng"))
    one = F.array(swap(F.from_json(raw, "array<double>")))
    many = F.transform(F.from_json(raw, "array<array<double>>"), swap)
    return rows.select("ord", kind.alias("kind"), F.col("f.properties").alias("properties"), F.when(kind == "Point", one).when(kind == "LineString", many).alias("points"))


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """Features of a file that may be missing."""
    try:
        return read_features(spark, path)
    except AnalysisException:
        return None


def read_gtfs(spark: SparkSession, folder: str, table: str, ordered: bool = False) -> DataFrame:
    """stops, stop_times, agency, calendar or frequencies; times of day are seconds, as 24:00:00 is none.

    A table is a file or a folder of files. With `ordered` also ord, the order of the files.
    """
    schemas = {
        "stops": "stop_id string, stop_lat double, stop_lon double",
        "stop_times": "trip_id string, stop_id string, stop_sequence int",
        "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string",
        "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
        "frequencies": "trip_id string, start_time string, end_time string, headway_secs int",
    }
    rows = _csv(spark, f"{folder}/{table}.txt", schemas[table], ordered)
    if table == "frequencies":
        part = lambda c, i: F.split_part(c, F.lit(":"), F.lit(i)).cast("int")
        rows = rows.withColumns({c: part(F.col(c), 1) * 3600 + part(F.col(c), 2) * 60 + part(F.col(c), 3) for c in ("start_time", "end_time")})
    return rows


def last_stops(stops: DataFrame, order: str = "ord") -> DataFrame:
    """Of repeated stop_id the last one, in the order of the files or of another column."""
    return stops.groupBy("stop_id").agg(F.max_by(F.struct("stop_lat", "stop_lon"), order).alias("x")).select("stop_id", "x.*")


def read_stands(spark: SparkSession, path: str) -> DataFrame:
    """stand_lat, stand_lng, drivers; rows that miss a number are left out."""
    rows = _csv(spark, path, "xcoord double, ycoord double, num_driver int")
    return rows.dropna().select(F.col("ycoord").alias("stand_lat"), F.col("xcoord").alias("stand_lng"), F.col("num_driver").alias("drivers"))


def read_osm_stations(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, f"stations array<struct<{OSM}>>").select(F.posexplode("stations").alias("ord", "s")).select("ord", "s.*")
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    return rows.fillna("", texts)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MATCHES).select(F.explode("matches").alias("sid", "m")).select("sid", "m.*")


def point_of(wkt):
    """lat and lng of a text like `Point(lng lat)`; null where it is none."""
    number = lambda i: F.nullif(F.regexp_extract(wkt, r"^Point\((-?[\d.]+) (-?[\d.]+)\)$", i), F.lit("")).cast("double")
    return F.when(number(2).isNotNull(), F.struct(number(2).alias("lat"), number(1).alias("lng")))


def entity_id(uri):
    return F.substring_index(uri, "/", -1)


def overpass_rows(texts: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """Nodes of raw map downloads, one JSON text a row, as station rows: 13 columns, texts empty where a tag is missing.

    ord is the place in the text, behind the column `order` if there are several texts; a node that several hold is there once.
    """
    element = "elements array<struct<type string, id long, lat double, lon double, tags map<string, string>>>"
    place = F.struct(order, "i") if order else F.col("i")
    rows = texts.select(*([order] if order else []), F.posexplode(F.from_json(F.col(column), element)["elements"]).alias("i", "e")).filter("e.type = 'node'").withColumn("ord", place)
    if order:
        rows = rows.groupBy("e.id").agg(F.min("ord").alias("ord"), F.min_by("e", "ord").alias("e"))
    tag = lambda k: F.coalesce(F.try_element_at(F.col("e.tags"), F.lit(k)), F.lit(""))
    keys = {"name": "name", "name_en": "name:en", "name_th": "name:th", **{k: k for k in ("ref", "network", "line", "operator", "railway", "public_transport", "station")}}
    return rows.select("ord", F.col("e.id").alias("osm_id"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"), *(tag(k).alias(c) for c, k in keys.items()))


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    return overpass_rows(spark.read.text(path, wholetext=True))


def sparql_rows(texts: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """Bindings of query results, one JSON text a row, as rows for merge_entities; those without a place are left out."""
    cell = "struct<value string>"
    schema = f"results struct<bindings array<struct<station {cell}, stationLabel {cell}, coord {cell}, stationCode {cell}, lineLabel {cell}>>>"
    rows = texts.select(*([order] if order else []), F.posexplode(F.from_json(F.col(column), schema)["results"]["bindings"]).alias("i", "b"))
    rows = rows.withColumn("ord", F.struct(order, "i") if order else F.col("i"))
    at = point_of(F.col("b.coord.value"))
    picked = {"name": "b.stationLabel.value", "code": "b.stationCode.value", "line": "b.lineLabel.value"}
    return rows.select("ord", entity_id(F.col("b.station.value")).alias("qid"), at.alias("p"), *(F.col(c).alias(n) for n, c in picked.items())).filter("p IS NOT NULL").select("ord", "qid", "name", "p.lat", "p.lng", "code", "line")


def read_sparql(spark: SparkSession, path: str) -> DataFrame:
    return sparql_rows(spark.read.text(path, wholetext=True))


def read_reach(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Stops (kind, stop, s_lat, s_lng, ride_km, ride_min) and density (r, c, density) of a reach file, None where there is none.

    The file has positions in place of names: stop is the place in its list, which is the order that ties are broken by.
    """
    lists = {"bus_stops": "bus", "boat_piers": "boat", "rail_stations": "rail"}
    schema = ", ".join(f"{c} array<array<double>>" for c in (*lists, "moto_density"))
    try:
        rows = _json(spark, path, schema)
    except AnalysisException:
        return None
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("at")) for c, kind in lists.items()))
    stops = rows.select(F.explode(kinds).alias("k")).select("k.kind", F.posexplode("k.at").alias("stop", "p"))
    named = stops.select("kind", "stop", *(F.col("p")[i].alias(c) for i, c in enumerate(("s_lat", "s_lng", "ride_km", "ride_min"))))
    cells = rows.select(F.posexplode("moto_density").alias("r", "row")).select("r", F.posexplode("row").alias("c", "density"))
    return named, cells


def map_elements(texts: DataFrame, column: str = "value") -> DataFrame:
    """type, id, lat, lon, tags, nodes, members of every element of raw map downloads, one JSON text a row; an element that several texts hold is there once."""
    element = "elements array<struct<type string, id long, lat double, lon double, tags map<string, string>, nodes array<long>, members array<struct<type string, ref long, role string>>>>"
    rows = texts.select(F.explode(F.from_json(F.col(column), element)["elements"]).alias("e")).select("e.*")
    # tags are given where an element was asked for, and left out where it is only a part of another
    whole = F.struct(F.col("tags").isNull().alias("bare"), "lat", "lon", F.to_json("tags").alias("tags"), "nodes", "members")
    first = rows.groupBy("type", "id").agg(F.min(whole).alias("x")).select("type", "id", "x.*").drop("bare")
    members = F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref")))
    return first.withColumns({"tags": F.from_json("tags", "map<string, string>"), "members": members})


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return map_elements(spark.read.text(path, wholetext=True))
