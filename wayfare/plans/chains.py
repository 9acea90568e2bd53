"""Queries that run whole chains of the domain: reach, repair, ingest and reports, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.functions.fares import minutes, mode_fare, modes, walk_minutes
from wayfare.functions.geo import haversine_km, origin_km
from wayfare.functions.text import label_lines
from wayfare.operators import graph, lines, resolve, tags
from wayfare.operators.ranking import global_rank
from wayfare.plans import networks as N
from wayfare.plans import surfaces as S
from wayfare.plans.dialect import LAT, LNG, SQL_MODES, place, points, sql_band, sql_fare, sql_km, sql_origin_km, sql_points
from wayfare.session import materialise, table

Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_STOPS = f"(SELECT DISTINCT p FROM (SELECT src AS p FROM {N._TRIPS} UNION ALL SELECT dst FROM {N._TRIPS}) WHERE p IN (SELECT p_partkey FROM part))"
_NODES = f"""(SELECT 'rail_' || s_suppkey AS node, 'rail' AS kind, {LAT.format('s_suppkey')} AS lat, {LNG.format('s_suppkey')} AS lng FROM supplier
    UNION ALL SELECT 'bus_' || p, 'bus', {LAT.format('p')}, {LNG.format('p')} FROM {_STOPS}
    UNION ALL SELECT 'boat_' || route || '_' || pier, 'boat', {LAT.format('pier')}, {LNG.format('pier')} FROM {N._BOATS})"""
_PIER_KM = sql_km(LAT.format("pier"), LNG.format("pier"), LAT.format("next"), LNG.format("next"))
_RIDES = f"""(SELECT 'rail_' || src AS src, 'rail_' || dst AS dst, km FROM {N._RAIL}
    UNION ALL SELECT 'bus_' || src, 'bus_' || dst, round({N._KM}, 6) FROM {N._TRIPS} WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'boat_' || route || '_' || pier, 'boat_' || route || '_' || next, round({_PIER_KM}, 6) FROM (SELECT route, pier, lead(pier) OVER (PARTITION BY route ORDER BY pos, pier) AS next FROM {N._BOATS}) WHERE next IS NOT NULL)"""


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_NODES}),
    w AS (SELECT a.node AS src, b.node AS dst, {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km FROM n a JOIN n b ON a.node < b.node AND abs(a.lat - b.lat) < 0.006 AND (a.kind <> b.kind OR a.kind = 'bus')),
    o AS (SELECT src, dst, km FROM {_RIDES} UNION ALL SELECT src, dst, round(km, 6) FROM w WHERE km <= 0.5),
    e AS MATERIALIZED (SELECT src, dst, km, round(km / CASE WHEN a.kind <> b.kind THEN 5.0e0 WHEN b.kind = 'rail' THEN 35.0e0 WHEN b.kind = 'bus' THEN 12.0e0 ELSE 15.0e0 END * 60, 6) AS minutes
        FROM (SELECT src, dst, km FROM o UNION ALL SELECT dst, src, km FROM o) JOIN n a ON a.node = src JOIN n b ON b.node = dst),
    s AS (SELECT 'rail_0' AS node, 0.0e0 AS km, 0.0e0 AS minutes UNION ALL SELECT node, km, km / 5.0e0 * 60 FROM (SELECT node, kind, {sql_origin_km('lat', 'lng')} AS km FROM n) WHERE node = 'rail_1' OR (kind <> 'rail' AND km <= 2)),
    d(node, km, minutes) USING KEY (node) AS (SELECT node, km, minutes FROM s UNION
        SELECT m.node, m.x.km, m.x.minutes FROM (SELECT e.dst AS node, min({{'km': d.km + e.km, 'minutes': d.minutes + e.minutes}}) AS x FROM d JOIN e ON d.node = e.src GROUP BY e.dst) m
        LEFT JOIN recurring.d AS p ON p.node = m.node WHERE p.node IS NULL OR m.x.km < p.km - 1e-7)
    SELECT node, kind, round(lat, 5) AS lat, round(lng, 5) AS lng, round(km, 2) AS km, round(minutes, 1) AS minutes FROM d JOIN n USING (node)""")
def reach_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rail (suppliers), bus (trips of lineitem at stops of part) and boat (customers on supplier routes) in one graph, from the airport."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.col(c).cast("string"))
    rail = points(spark, sf_dir, "supplier", "s_suppkey").select(named("rail", "id").alias("node"), F.lit("rail").alias("kind"), "lat", "lng")
    links = N.rail_links(spark, sf_dir)
    tracks = graph.rail_edges(links, points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("id", "node")).select(named("rail", "src").alias("src"), named("rail", "dst").alias("dst"), F.round("km", 6).alias("km"))
    visits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_partkey").alias("stop"), "l_linenumber", "l_shipdate", F.col("l_partkey"), "l_suppkey")
    stops = points(spark, sf_dir, "part", "p_partkey")
    pairs = materialise(graph.trip_edges(visits, N._ORDER.split(", ")))  # twice below
    trips = pairs.select(named("bus", "src").alias("src"), named("bus", "dst").alias("dst"))
    used = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    bus = stops.join(used, "id", "left_semi").select(named("bus", "id").alias("node"), F.lit("bus").alias("kind"), "lat", "lng")
    routes = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("route"), F.col("s_suppkey").alias("i"), *place(F.col("s_suppkey")))
    piers = points(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("id", "pier")
    moored = materialise(graph.boat_nodes(piers, routes).join(piers, "pier"))
    boat = moored.select("node", F.lit("boat").alias("kind"), "lat", "lng")
    boats = graph.boat_edges(moored)
    nodes = materialise(rail.unionByName(bus).unionByName(boat))
    airport = rail.filter("node = 'rail_1'").withColumn("km", origin_km("lat", "lng")).select("node", "km", walk_minutes("km").alias("minutes"))
    entries = airport.unionByName(spark.createDataFrame([("rail_0", 0.0, 0.0)], "node string, km double, minutes double"))
    return graph.multimodal_reach(nodes, [tracks, trips, boats], entries)


_NINE = "CAST(round(CAST(round(CASE WHEN x.km <= 10 THEN x.s_{0} ELSE {0} END, 9) AS DECIMAL(18, 9)), 5) AS DOUBLE)"
_ROUTE = f"(SELECT p_brand AS line, p_partkey AS i, {LAT.format('p_partkey')} AS lat, {LNG.format('p_partkey')} AS lng FROM part WHERE p_size % 5 = 0 AND p_brand NOT LIKE '%3')"


@query(f"""WITH RECURSIVE {N.sql_walk(f'(SELECT line, i AS node, i AS k FROM {N._ITEMS} WHERE i % 11 <> 0)')},
    it AS (SELECT w.line, w.i, w.node, anchor, fixable, lat, lng FROM w JOIN {N._ITEMS} x ON x.line = w.line AND x.i = w.node),
    p AS (SELECT *, {{'i': i, 'lat': lat, 'lng': lng, 'b_lat': coalesce(lat - lag(lat) OVER w, 0.0e0), 'b_lng': coalesce(lng - lag(lng) OVER w, 0.0e0),
        'a_lat': coalesce(lat - lead(lat) OVER w, 0.0e0), 'a_lng': coalesce(lng - lead(lng) OVER w, 0.0e0)}} AS s FROM it WINDOW w AS (PARTITION BY line ORDER BY i)),
    q AS (SELECT *, last_value(CASE WHEN anchor THEN s END IGNORE NULLS) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
        first_value(CASE WHEN anchor THEN s END IGNORE NULLS) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM p),
    g AS (SELECT *, row_number() OVER (PARTITION BY line, prev.i, next.i ORDER BY i) AS k, count(*) OVER (PARTITION BY line, prev.i, next.i) AS n FROM q WHERE NOT anchor AND fixable),
    v AS (SELECT * FROM (SELECT node AS point, line, {N._guess('lat')} AS lat, {N._guess('lng')} AS lng FROM g
        UNION ALL SELECT i, line, lat, lng FROM {N._ITEMS} WHERE NOT anchor AND fixable AND (line, i) NOT IN (SELECT (line, node) FROM it)) WHERE line IN (SELECT line FROM {_ROUTE})),
    s AS (SELECT * FROM (SELECT line, i, lat AS lat1, lng AS lng1, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM {_ROUTE} WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE lat2 IS NOT NULL),
    m AS (SELECT point, p.lat, p.lng, i, lat1 + {N._T} * (lat2 - lat1) AS s_lat, lng1 + {N._T} * (lng2 - lng1) AS s_lng FROM v p JOIN s ON p.line = s.line
        AND p.lat BETWEEN least(lat1, lat2) - 0.05e0 AND greatest(lat1, lat2) + 0.05e0 AND p.lng BETWEEN least(lng1, lng2) - 0.05e0 AND greatest(lng1, lng2) + 0.05e0),
    b AS (SELECT point, min({{'km': round({sql_km('lat', 'lng', 's_lat', 's_lng')}, 9), 'i': i, 's_lat': s_lat, 's_lng': s_lng}}) AS x FROM m GROUP BY point)
    SELECT v.line, v.point AS node, {_NINE.format('lat')} AS lat, {_NINE.format('lng')} AS lng FROM v LEFT JOIN b USING (point)""")
def line_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are walked; unknown stations of those with a route are estimated between anchors, or taken as branches where the walk misses them, then snapped."""
    every = N._items(spark, sf_dir).withColumnRenamed("i", "node")
    order = N.walked(every.filter("node % 11 <> 0").select("line", "node", F.col("node").alias("k")))
    route = table(spark, sf_dir, "part").filter("p_size % 5 = 0 AND p_brand NOT LIKE '%3'").select(F.col("p_brand").alias("line"), F.col("p_partkey").alias("i"), *place(F.col("p_partkey")))
    return lines.repair(order.join(every, ["line", "node"]), every, route)


@query("""SELECT ord, name FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(name, ''), name_en), round(lat, 3), round(lon, 3) ORDER BY ord) AS k FROM (
    SELECT p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS name_en, 13.7e0 + p_size % 3 / 1000.0e0 AS lat, 100.5e0 AS lon FROM part
    WHERE contains(upper(p_type), 'SRT') OR contains(upper(p_type), 'BTS') OR contains(upper(p_type), 'MRT') OR contains(upper(p_type), 'ARL') OR contains(upper(p_type), 'AIRPORT RAIL') OR p_size % 10 = 0)
    WHERE name <> '' OR name_en <> '') WHERE k = 1""")
def station_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw gazetteer rows (parts) to named transit stations, the first of each name and rounded place."""
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = table(spark, sf_dir, "part").select(
        key.alias("ord"),
        F.when(key % 4 == 0, "").otherwise(F.col("p_name")).alias("name"),
        F.when(key % 9 == 0, "").otherwise(F.col("p_name")).alias("name_en"),
        (13.7 + size % 3 / F.lit(1000.0)).alias("lat"),
        F.lit(100.5).alias("lon"),
        F.col("p_type").alias("network"),
        F.lit("").alias("operator"),
        F.lit("").alias("station"),
        F.when(size % 10 == 0, "halt").otherwise("").alias("railway"),
    )
    return resolve.transit_stations(raw).select("ord", "name")


@query(f"""SELECT qid, name, round(lat, 6) AS lat, round(lng, 6) AS lng, codes FROM (SELECT l_partkey AS qid, min({{'o': l_orderkey * 10 + l_linenumber, 'n': l_shipdate, 's': l_suppkey}}) AS f, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS codes FROM lineitem GROUP BY 1),
    LATERAL (SELECT 'station ' || qid AS name, {LAT.format('qid')} AS lat, {LNG.format('qid')} AS lng) WHERE lat BETWEEN 13.5e0 AND 14.0e0 AND lng BETWEEN 100.3e0 AND 100.9e0""")
def entity_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query bindings (line items) to one row for each entity inside the station box."""
    from wayfare.sources.readers import entity_id, point_of

    uri = F.concat(F.lit("http://example.org/entity/"), F.col("l_partkey").cast("string"))
    lat, lng = place(F.col("l_partkey"))
    at = point_of(F.concat(F.lit("Point("), F.format_string("%.4f", lng), F.lit(" "), F.format_string("%.4f", lat), F.lit(")")))
    rows = table(spark, sf_dir, "lineitem").select(
        entity_id(uri).cast("long").alias("qid"), F.concat(F.lit("station "), entity_id(uri)).alias("name"), at["lat"].alias("lat"), at["lng"].alias("lng"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    )
    south, north, west, east = K.STATION_BOX
    merged = resolve.merge_entities(rows).filter(tags.in_box(F.col("lat"), F.col("lng"), south, west, north, east))
    return merged.select("qid", "name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.array_join("codes", ";").alias("codes"))


@query("""WITH c AS (SELECT c_custkey AS k, 'Q' || c_custkey AS s, 'T' || c_custkey % 7 AS kind FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 <> 0)
    SELECT s AS subject, coalesce(CASE WHEN k % 4 = 0 THEN 'name ' || k END, CASE WHEN k % 5 = 0 THEN 'local ' || k END, s) AS label, CASE WHEN k % 6 = 0 THEN 'code ' || k END AS code
    FROM c JOIN (VALUES ('T1'), ('T2'), ('T3'), ('T3')) AS t(kind) USING (kind)""")
def triple_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a country with a place, of two classes or what is below them, with optional codes and labels by language."""
    key, name = F.col("c_custkey").cast("string"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string"))
    facts = [
        ("country", F.when(F.col("c_nationkey") % 2 == 0, "here")),
        ("place", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Point("), key, F.lit(")")))),
        ("is_a", F.concat(F.lit("T"), (F.col("c_custkey") % 7).cast("string"))),
        ("label_en", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("name "), key))),
        ("label_local", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("local "), key))),
        ("code", F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("code "), key))),
    ]
    rows = table(spark, sf_dir, "customer").select(name.alias("subject"), F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), o.alias("object")) for p, o in facts))).alias("x"))
    known = spark.createDataFrame([("T2", "below", "T1"), ("T3", "below", "T2")], "subject string, predicate string, object string")
    triples = rows.select("subject", "x.predicate", "x.object").filter("object IS NOT NULL").unionByName(known)
    found = tags.pattern(triples, {"place": "place"}, {"label_en": "en", "label_local": "local", "code": "code"}, {"country": "here"})
    bag = tags.members_of(triples, ["T1", "T3"], "is_a", "below")
    return found.join(bag, "subject").select("subject", tags.label([F.col("en"), F.col("local")], F.col("subject")).alias("label"), "code")


_MATCHED = "(SELECT c_custkey AS sid, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS line, CASE WHEN c_custkey % 4 = 0 THEN 'phantom' WHEN c_custkey % 4 = 1 THEN 'high' ELSE 'low' END AS status FROM customer)"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("sid"), F.when(key % 13 != 0, F.col("c_mktsegment")).alias("line"), F.when(key % 4 == 0, "phantom").when(key % 4 == 1, "high").otherwise("low").alias("status"))


@query(f"SELECT coalesce(line, '?') AS line, status, count(*) AS n FROM {_MATCHED} GROUP BY 1, 2 ORDER BY 1, 2")
def line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by line and status, in the order of both."""
    return resolve.line_report(_matched(spark, sf_dir)).orderBy("line", "status")


@query(f"SELECT sid, line FROM {_MATCHED} WHERE status = 'phantom' ORDER BY sid LIMIT 20")
def first_phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty stations without a match."""
    return _matched(spark, sf_dir).filter("status = 'phantom'").select("sid", "line").orderBy("sid").limit(20)


@query(f"""WITH m AS (SELECT c.c_custkey AS sid, s.s_suppkey % 5 <> 0 AS used, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS name, s.* FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey),
    r AS (SELECT coalesce(used, false) AS used, CASE WHEN used AND s_suppkey % 3 <> 0 THEN s_name ELSE name END AS new_name, name, sid,
        used AND (round({LAT.format('sid')} + 0.001e0 * (sid % 2), 5) <> {LAT.format('sid')} OR round({LNG.format('sid')}, 5) <> {LNG.format('sid')}) AS moved FROM m)
    SELECT 'updated' AS name, count(*) FILTER (used AND moved) AS n FROM r UNION ALL SELECT 'kept', count(*) FILTER (NOT used) FROM r
    UNION ALL SELECT 'renamed', count(*) FILTER (used AND new_name <> name) FROM r UNION ALL SELECT 'lacking', count(*) FILTER (new_name = '') FROM r""")
def correction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stations were updated, kept and renamed, and how many lack a required field."""
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(key.alias("sid"), F.when(key % 17 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("").alias("name_th"), *place(key))
    s = F.col("s_suppkey")
    lat, lng = place(s)
    found = table(spark, sf_dir, "supplier").select(s.alias("sid"), F.when(s % 5 == 0, "phantom").otherwise("high").alias("status"), (lat + 0.001 * (s % 2)).alias("osm_lat"), lng.alias("osm_lng"), F.when(s % 3 == 0, "").otherwise(F.col("s_name")).alias("osm_name_en"), F.lit("").alias("osm_name_th"))
    return resolve.correction_report(resolve.apply_corrections(own, found), found)


# two stations of entry, each with its own way from the airport, and rail km from there
_ENTRIES = f"SELECT id AS node, round({sql_origin_km('lat', 'lng')}, 6) AS km, 0.0e0 AS minutes FROM {sql_points('supplier', 's_suppkey')} WHERE id <= 2"
_RAIL_MODES = f"(SELECT * FROM {SQL_MODES} WHERE type = 'rail')"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, km FROM {N._RAIL} UNION ALL SELECT dst, src, km FROM {N._RAIL}),
    d(node, km) USING KEY (node) AS (SELECT node, km FROM ({_ENTRIES}) UNION SELECT n.node, n.km FROM (SELECT e.dst AS node, min(d.km + e.km) AS km FROM d JOIN e ON d.node = e.src GROUP BY e.dst) n
        LEFT JOIN recurring.d AS o ON o.node = n.node WHERE o.node IS NULL OR n.km < o.km - 1e-7),
    v AS (SELECT node, mode, 'cost' AS view, {sql_fare('k')} AS value FROM (SELECT node, round(km, 6) AS k FROM d), {_RAIL_MODES} UNION ALL SELECT node, mode, 'time', round(k / speed * 60, 6) FROM (SELECT node, round(km, 6) AS k FROM d), {_RAIL_MODES}),
    a AS (SELECT node, mode, view, value FROM v UNION ALL SELECT node, 'multimodal', view, min(value) FROM v GROUP BY node, view)
    SELECT mode, view, band, count(*) AS n, min(node) AS first FROM (SELECT node, mode, view, CASE view WHEN 'cost' THEN {sql_band('value', K.COST_BANDS)} ELSE {sql_band('value', K.TIME_BANDS)} END AS band FROM a
        WHERE value <= CASE view WHEN 'cost' THEN {K.COST_BANDS[-1]} ELSE {K.TIME_BANDS[-1]} END) GROUP BY mode, view, band""")
def reachable_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations within the outermost band by fare or time of their rail km, by mode and band; the best of modes is the least of the rail modes."""
    at = points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("id", "node")
    tracks = graph.both_ways(graph.rail_edges(N.rail_links(spark, sf_dir), at).withColumn("km", F.round("km", 6))).withColumn("minutes", F.lit(0.0))
    entries = at.filter("node <= 2").select("node", F.round(origin_km("lat", "lng"), 6).alias("km"), F.lit(0.0).alias("minutes"))
    km = graph.shortest_paths(tracks, entries).select("node", F.round("km", 6).alias("km"))
    return graph.station_bands(km, modes(spark, "rail")).groupBy("mode", "view", "band").agg(F.count("*").alias("n"), F.min("node").alias("first"))


_LABELED = f"(SELECT id, round({sql_origin_km('lat', 'lng')}, 6) AS km FROM {sql_points('supplier', 's_suppkey')})"


@query(f"""SELECT id, view, list_extract([{', '.join(repr(c) for c in K.COLORS)}], band + 1) AS color, concat_ws(chr(10), CASE WHEN id % 7 = 0 THEN 'rd' || id ELSE s_name END, CASE WHEN id % 3 = 0 THEN 'ส' || id ELSE '' END, 'RD' || id,
        printf('%.1f', km) || ' km | ' || CAST(floor(value + 0.5e0) AS BIGINT) || CASE view WHEN 'cost' THEN ' THB' ELSE ' min' END) AS text
    FROM (SELECT id, km, view, value, CASE view WHEN 'cost' THEN {sql_band('value', K.COST_BANDS)} ELSE {sql_band('value', K.TIME_BANDS)} END AS band FROM (
        SELECT id, km, 'cost' AS view, min({sql_fare('km')}) AS value FROM {_LABELED}, {_RAIL_MODES} GROUP BY id, km UNION ALL SELECT id, km, 'time', min(round(km / speed * 60, 6)) FROM {_LABELED}, {_RAIL_MODES} GROUP BY id, km)
        WHERE value <= CASE view WHEN 'cost' THEN {K.COST_BANDS[-1]} ELSE {K.TIME_BANDS[-1]} END) JOIN supplier ON s_suppkey = id""")
def station_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a map shows at each station under the best of the rail modes: colour, and the lines of its label."""
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(key.alias("node"), F.when(key % 7 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(key % 3 == 0, F.concat(F.lit("ส"), key.cast("string"))).alias("name_th"), F.concat(F.lit("rd"), key.cast("string")).alias("code"), F.round(origin_km(*place(key)), 6).alias("km"))
    shown = graph.station_bands(s.select("node", "km"), modes(spark, "rail")).filter("mode = 'multimodal'")
    text = label_lines(F.col("name"), F.col("name_th"), F.col("code"), F.col("km"), F.col("value"), F.col("view"))
    return shown.join(s, "node").select(F.col("node").alias("id"), "view", F.element_at(F.array(*map(F.lit, K.COLORS)), F.col("band") + 1).alias("color"), F.array_join(text, "\n").alias("text"))


@query(f"SELECT route, pier, row_number() OVER (ORDER BY route, round(pos, 6), pier) - 1 AS number FROM {N._BOATS}")
def boat_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piers on routes numbered through all routes, along each and by pier: a rank without one task for all."""
    routes = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("route"), F.col("s_suppkey").alias("i"), *place(F.col("s_suppkey")))
    nodes = graph.boat_nodes(points(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("id", "pier"), routes)
    ranked = global_rank(nodes.select("route", F.round("pos", 6).alias("pos"), "pier"), ["route", "pos", "pier"], "number")
    return ranked.select("route", "pier", (F.col("number") - 1).alias("number"))


_SWATCHES = ", ".join(f"('{view}', {i}, '{K.COLORS[i]}', '{value} {unit}')" for view, unit, bands in (("cost", "THB", K.COST_BANDS), ("time", "min", K.TIME_BANDS)) for i, value in enumerate(bands))
_REACHED = "(SELECT 3 * km AS cost, round(km / 12.0e0 * 60, 6) AS time FROM (SELECT (c_custkey * 37 % 300) / 10.0e0 AS km FROM customer))"


@query(f"""SELECT view, CAST(i AS INT) AS i, color, label, coalesce(n, 0) AS n FROM (VALUES {_SWATCHES}) AS t(view, i, color, label) LEFT JOIN (
    SELECT view, i, count(*) AS n FROM (SELECT 'cost' AS view, {sql_band('cost', K.COST_BANDS)} AS i FROM {_REACHED} WHERE cost <= {K.COST_BANDS[-1]}
        UNION ALL SELECT 'time', {sql_band('time', K.TIME_BANDS)} FROM {_REACHED} WHERE time <= {K.TIME_BANDS[-1]}) GROUP BY view, i) USING (view, i)""")
def legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swatches of the bands (view, place, colour, label) with how many stops each has."""
    from wayfare.functions.tables import register

    register({"modes": modes(spark)})
    swatches = spark.sql("SELECT 'cost' AS view, * FROM legend(view => 'cost') UNION ALL SELECT 'time', * FROM legend(view => 'time')").withColumnRenamed("band", "i")
    counts = N.transit_stop_layer(spark, sf_dir).select("view", F.col("band").alias("i"), "n")
    return swatches.join(F.broadcast(counts), ["view", "i"], "left").fillna(0, ["n"])  # at most a row for each band


@query(f"""SELECT mode, string_agg(CAST(CAST(fare AS BIGINT) AS VARCHAR), ',' ORDER BY km) AS fares, string_agg(CAST(CAST(floor(km / speed * 60 + 0.5e0) AS BIGINT) AS VARCHAR), ',' ORDER BY km) AS minutes, max(CASE WHEN km = 10 THEN CAST(fare AS BIGINT) END) AS chosen
    FROM (SELECT mode, speed, km, {sql_fare('km')} AS fare FROM {SQL_MODES} m, {S._RIDES}) GROUP BY mode""")
def mode_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mode its fares and rounded minutes at the lengths of rides, in order, and the fare at the chosen distance (10 km)."""
    km = S._rides(spark, sf_dir).crossJoin(F.broadcast(modes(spark)))
    rows = km.select("mode", "km", F.floor(mode_fare("km")).alias("fare"), F.floor(minutes("km", F.col("speed")) + 0.5).alias("took"), (F.col("km") == 10).alias("chosen"))
    listed = F.array_sort(F.collect_list(F.struct("km", "fare", "took")))  # 30 lengths at most
    out = rows.groupBy("mode").agg(listed.alias("x"), F.max(F.when(F.col("chosen"), F.col("fare"))).alias("chosen"))
    return out.select("mode", F.array_join("x.fare", ",").alias("fares"), F.array_join("x.took", ",").alias("minutes"), "chosen")


_CODED = "(SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'N' || c_custkey % 30 || '; BL' || c_custkey % 40 WHEN c_custkey % 5 = 2 THEN 'CEN' WHEN c_custkey % 5 = 3 THEN 'A' || c_custkey % 9 ELSE 'XN1' END AS ref, CASE WHEN c_custkey % 2 = 0 THEN 'Don Mueang' ELSE 'ICONSIAM' END AS name FROM customer)"
_LINE_ARMS = " UNION ALL ".join(
    f"SELECT k, '{line}' AS line FROM {_CODED} WHERE len(list_filter(string_split(ref, ';'), lambda x: regexp_matches(trim(x), '{'|'.join(patterns)}'))) > 0 OR (ref = '' AND name IN ({', '.join(repr(h) for h in [*K.LINE_HINTS.get(line, []), '-'])}))" for line, patterns in K.LINE_PATTERNS.items()
)


@query(f"SELECT line, count(*) AS n, min(k) AS first FROM ({_LINE_ARMS}) GROUP BY line")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer stations on each line by the table of code patterns and, where there is no code, of names."""
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    two = F.concat(F.lit("N"), text(key % 30), F.lit("; BL"), text(key % 40))
    ref = F.when(key % 5 == 0, "").when(key % 5 == 1, two).when(key % 5 == 2, "CEN").when(key % 5 == 3, F.concat(F.lit("A"), text(key % 9))).otherwise("XN1")
    rows = table(spark, sf_dir, "customer").select(key.alias("k"), ref.alias("ref"), F.when(key % 2 == 0, "Don Mueang").otherwise("ICONSIAM").alias("name_en"))
    rules = spark.createDataFrame([(line, patterns, K.LINE_HINTS.get(line, [])) for line, patterns in K.LINE_PATTERNS.items()], "line string, patterns array<string>, hints array<string>")
    return resolve.line_members(rows, rules).groupBy("line").agg(F.count("*").alias("n"), F.min("k").alias("first"))
