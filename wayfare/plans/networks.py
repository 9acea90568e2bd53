"""Queries on graphs, sequences and gazetteers, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.geo import haversine_km, rounded
from wayfare.functions.text import confidence, is_transit, normal, number_in
from wayfare.operators import graph, lines, resolve
from wayfare.plans.dialect import LAT, LNG, place, points, sql_km, sql_origin_km, sql_points
from wayfare.session import table, task_count

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ORDER = "l_linenumber, l_shipdate, l_partkey, l_suppkey"
_TRIPS = f"(SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
_KM = sql_km(LAT.format("src"), LNG.format("src"), LAT.format("dst"), LNG.format("dst"))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_partkey").alias("stop"), "l_linenumber", "l_shipdate", F.col("l_partkey"), "l_suppkey")
    edges = graph.trip_edges(visits, _ORDER.split(", "))
    (a, b), (c, d) = place(F.col("src")), place(F.col("dst"))
    return edges.withColumn("km", F.round(haversine_km(a, b, c, d), 6))


@query(f"SELECT src, dst, round({_KM}, 6) AS km FROM {_TRIPS}")
def trip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of stops that follow each other on a trip."""
    return _trips(spark, sf_dir)


@query("SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM (SELECT src, dst FROM " + _TRIPS + " UNION SELECT dst, src FROM " + _TRIPS + ") GROUP BY src) GROUP BY degree")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stops have how many neighbours."""
    n = task_count(table(spark, sf_dir, "lineitem"))
    both = graph.both_ways(_trips(spark, sf_dir).select("src", "dst")).repartition(n, "src").distinct()
    return both.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


# a sparse stand-in network: consecutive suppliers, and a link from every second to the one at a third of its key
_RING = f"""(SELECT src, dst, round({_KM}, 6) AS km FROM (SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey > 0)
    WHERE dst IN (SELECT s_suppkey FROM supplier))"""
_LINKS = f"(SELECT src, dst, km FROM {_RING} UNION ALL SELECT dst, src, km FROM {_RING})"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    pairs = keys.select("src", (F.col("src") + 1).alias("dst")).unionByName(keys.filter("src % 2 = 0 AND src > 0").select("src", F.expr("src DIV 3").alias("dst")))
    (a, b), (c, d) = place(F.col("src")), place(F.col("dst"))
    known = pairs.join(keys.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return known.select("src", "dst", F.round(haversine_km(a, b, c, d), 6).alias("km"))


def _walk_sql(seeds: str, minutes: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT src, dst, km, {minutes} AS minutes FROM {_LINKS}),
    d(node, km, minutes) USING KEY (node) AS (SELECT node, km, minutes FROM ({seeds}) UNION
        SELECT n.node, n.x.km, n.x.minutes FROM (SELECT e.dst AS node, min({{'km': d.km + e.km, 'minutes': d.minutes + e.minutes}}) AS x FROM d JOIN e ON d.node = e.src GROUP BY e.dst) n
        LEFT JOIN recurring.d AS o ON o.node = n.node WHERE o.node IS NULL OR n.x.km < o.km - 1e-7)
    SELECT node, round(km, 6) AS km, round(minutes, 6) AS minutes FROM d"""


@query(_walk_sql("SELECT min(s_suppkey) AS node, 0.0e0 AS km, 0.0e0 AS minutes FROM supplier", "0.0e0"))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest km from the first node."""
    edges = graph.both_ways(_ring(spark, sf_dir)).withColumn("minutes", F.lit(0.0))
    start = edges.agg(F.min("src").alias("node")).select("node", F.lit(0.0).alias("km"), F.lit(0.0).alias("minutes"))
    return graph.shortest_paths(edges, start).select("node", F.round("km", 6).alias("km"), F.round("minutes", 6).alias("minutes"))


_KIND = "CASE WHEN {0} % 3 = 0 THEN 'rail' WHEN {0} % 3 = 1 THEN 'bus' ELSE 'boat' END"
_SAME = f"({_KIND.format('src')}) = ({_KIND.format('dst')})"
_SPEED = "CASE WHEN dst % 3 = 0 THEN 35.0e0 WHEN dst % 3 = 1 THEN 12.0e0 ELSE 15.0e0 END"


@query(_walk_sql("SELECT s_suppkey AS node, 0.25e0 * (s_suppkey % 4) AS km, 3.0e0 * (s_suppkey % 4) AS minutes FROM supplier WHERE s_suppkey % 23 = 0", f"round(km / (CASE WHEN {_SAME} THEN {_SPEED} ELSE 5.0e0 END) * 60, 6)"))
def reach_multimodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest km from several seeds, with the minutes of that way."""
    kind = lambda c: F.element_at(F.array(F.lit("rail"), F.lit("bus"), F.lit("boat")), (F.col(c) % 3 + 1).cast("int"))
    edges = graph.both_ways(_ring(spark, sf_dir)).withColumn("minutes", F.round(graph.ride_minutes(F.col("km"), kind("src"), kind("dst")), 6))
    key = F.col("s_suppkey")
    seeds = table(spark, sf_dir, "supplier").filter(key % 23 == 0).select(key.alias("node"), (0.25 * (key % 4)).alias("km"), (3.0 * (key % 4)).alias("minutes"))
    return graph.shortest_paths(edges, seeds).select("node", F.round("km", 6).alias("km"), F.round("minutes", 6).alias("minutes"))


_ROUTES = f"""(SELECT route, i, {LAT.format('p')} AS lat, {LNG.format('p')} AS lng FROM (
    SELECT l_orderkey AS route, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i FROM lineitem))"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), i.alias("i"), *place(F.col("l_partkey")))


@query(f"""SELECT route, i, round(coalesce(sum(step) OVER (PARTITION BY route ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0), 5) AS pos FROM (
    SELECT route, i, {sql_km('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM {_ROUTES} WINDOW w AS (PARTITION BY route ORDER BY i))""")
def route_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vertex lies along its route, one segment behind."""
    return graph.positions(_routes(spark, sf_dir), "route", "i").select("route", "i", F.round("pos", 5).alias("pos"))


_ITEMS = f"(SELECT p_brand AS line, p_partkey AS i, p_size % 5 = 0 AS anchor, p_size % 7 <> 3 AS fixable, {LAT.format('p_partkey')} AS lat, {LNG.format('p_partkey')} AS lng FROM part)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("line"), F.col("p_partkey").alias("i"), (F.col("p_size") % 5 == 0).alias("anchor"), (F.col("p_size") % 7 != 3).alias("fixable"), *place(F.col("p_partkey")))


def _guess(c: str) -> str:
    return f"""CASE WHEN prev IS NOT NULL AND next IS NOT NULL THEN prev.{c} + k / CAST(n + 1 AS DOUBLE) * (next.{c} - prev.{c})
        WHEN prev IS NOT NULL THEN prev.{c} + prev.b_{c} * k WHEN next IS NOT NULL THEN next.{c} + next.a_{c} * (n - k + 1) ELSE {c} END"""


@query(f"""WITH p AS (SELECT *, {{'i': i, 'lat': lat, 'lng': lng, 'b_lat': coalesce(lat - lag(lat) OVER w, 0.0e0), 'b_lng': coalesce(lng - lag(lng) OVER w, 0.0e0),
        'a_lat': coalesce(lat - lead(lat) OVER w, 0.0e0), 'a_lng': coalesce(lng - lead(lng) OVER w, 0.0e0)}} AS s FROM {_ITEMS} WINDOW w AS (PARTITION BY line ORDER BY i)),
    q AS (SELECT *, last_value(CASE WHEN anchor THEN s END IGNORE NULLS) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
        first_value(CASE WHEN anchor THEN s END IGNORE NULLS) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM p),
    g AS (SELECT *, row_number() OVER (PARTITION BY line, prev.i, next.i ORDER BY i) AS k, count(*) OVER (PARTITION BY line, prev.i, next.i) AS n FROM q WHERE NOT anchor AND fixable)
    SELECT line, i, round({_guess('lat')}, 9) AS est_lat, round({_guess('lng')}, 9) AS est_lng FROM g""")
def anchor_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated places of the stations between anchors."""
    return lines.between_anchors(_items(spark, sf_dir)).select("line", "i", F.round("est_lat", 9).alias("est_lat"), F.round("est_lng", 9).alias("est_lng"))


_T = "least(greatest(coalesce(((p.lat - lat1) * (lat2 - lat1) + (p.lng - lng1) * (lng2 - lng1)) / nullif((lat2 - lat1) * (lat2 - lat1) + (lng2 - lng1) * (lng2 - lng1), 0.0e0), 0.0e0), 0.0e0), 1.0e0)"


@query(f"""WITH s AS (SELECT * FROM (SELECT p_brand AS line, p_partkey AS i, {LAT.format('p_partkey')} AS lat1, {LNG.format('p_partkey')} AS lng1,
        lead({LAT.format('p_partkey')}) OVER w AS lat2, lead({LNG.format('p_partkey')}) OVER w AS lng2 FROM part WHERE p_size % 5 = 0 WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) WHERE lat2 IS NOT NULL),
    p AS (SELECT p_partkey AS point, p_brand AS line, {LAT.format('p_partkey')} AS lat, {LNG.format('p_partkey')} AS lng FROM part WHERE p_size % 5 <> 0),
    n AS (SELECT point, p.lat, p.lng, i, lat1 + {_T} * (lat2 - lat1) AS s_lat, lng1 + {_T} * (lng2 - lng1) AS s_lng FROM p JOIN s ON p.line = s.line
        AND p.lat BETWEEN least(lat1, lat2) - 0.05e0 AND greatest(lat1, lat2) + 0.05e0 AND p.lng BETWEEN least(lng1, lng2) - 0.05e0 AND greatest(lng1, lng2) + 0.05e0),
    b AS (SELECT point, min({{'km': round({sql_km('lat', 'lng', 's_lat', 's_lng')}, 9), 'i': i, 's_lat': s_lat, 's_lng': s_lng}}) AS x FROM n GROUP BY point)
    SELECT p.point, round(CASE WHEN x.km <= 10 THEN x.s_lat ELSE lat END, 5) AS snap_lat, round(CASE WHEN x.km <= 10 THEN x.s_lng ELSE lng END, 5) AS snap_lng, CASE WHEN x.km <= 10 THEN round(x.km, 5) END AS snap_km
    FROM p LEFT JOIN b ON p.point = b.point""")
def snap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations snapped to the polyline of their line's anchors."""
    part = table(spark, sf_dir, "part")
    route = part.filter("p_size % 5 = 0").select(F.col("p_brand").alias("line"), F.col("p_partkey").alias("i"), *place(F.col("p_partkey")))
    spots = part.filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("point"), F.col("p_brand").alias("line"), *place(F.col("p_partkey")))
    return lines.snap(spots, route).select("point", *(F.round(c, 5).alias(c) for c in ("snap_lat", "snap_lng", "snap_km")))


@query("SELECT s_name, CAST(coalesce(try_cast(regexp_replace(s_name, '[^0-9]', '', 'g') AS BIGINT), 0) AS BIGINT) AS number, row_number() OVER (ORDER BY coalesce(try_cast(regexp_replace(s_name, '[^0-9]', '', 'g') AS BIGINT), 0), s_name) AS place FROM supplier")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of their digits; the rank comes from a range-sorted scan and per-partition counts."""
    rows = table(spark, sf_dir, "supplier").select("s_name", number_in(F.col("s_name")).alias("number"))
    from wayfare.operators.ranking import global_rank

    return global_rank(rows, ["number", "s_name"], "place")


@query(f"""SELECT id FROM (SELECT c.c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment, round({LAT.format('c_custkey')}, 1), round({LNG.format('c_custkey')}, 1) ORDER BY c_custkey) AS k FROM customer c) WHERE k = 1""")
def dedupe_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each segment and rounded place."""
    lat, lng = place(F.col("c_custkey"))
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment", rounded(lat, 1).alias("a"), rounded(lng, 1).alias("b"))
    return rows.agg(F.min("c_custkey").alias("id")).select("id")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(upper(p_type), 'SRT') OR contains(upper(p_type), 'BTS') OR contains(upper(p_type), 'MRT') OR contains(upper(p_type), 'ARL') OR contains(upper(p_type), 'AIRPORT RAIL')
    OR contains(upper(p_name), 'BEM') OR contains(upper(p_name), 'BMCL') OR contains(upper(p_name), 'MRTA') OR contains(upper(p_name), 'BTSC') OR contains(upper(p_name), 'SRT') OR contains(upper(p_name), 'ARL')
    OR p_brand IN ('subway', 'light_rail', 'monorail') OR (CASE WHEN p_size % 10 = 0 THEN 'halt' END) IN ('station', 'halt', 'stop')""")
def transit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that look like transit stations."""
    kind = F.when(F.col("p_size") % 10 == 0, "halt")
    return table(spark, sf_dir, "part").filter(is_transit(F.col("p_type"), F.col("p_name"), F.col("p_brand"), kind)).select("p_partkey", "p_name")


@query("SELECT l_partkey AS qid, min(l_linenumber) AS first, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS codes, string_agg(DISTINCT l_linestatus, ';' ORDER BY l_linestatus) AS lines FROM lineitem GROUP BY l_partkey")
def codes_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the sorted union of their codes and lines."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("qid"), F.lit("").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("line"), F.col("l_linenumber").alias("ord"))
    firsts = item.groupBy("qid").agg(F.min("ord").alias("first"))
    merged = resolve.merge_entities(item).join(firsts, "qid")
    return merged.select("qid", "first", F.array_join("codes", ";").alias("codes"), F.array_join("lines", ";").alias("lines"))


_RULES = [("high", ["^[12]$"], []), ("middle", ["^3$", "^MED.*$"], []), ("low", ["^5$"], ["4-NOT SPECIFIED"])]


@query("""SELECT o_orderkey, line FROM (SELECT o_orderkey, replace(o_orderpriority, '-', ';') AS ref FROM orders), (VALUES ('high', '^[12]$'), ('middle', '^3$|^MED.*$'), ('low', '^5$')) AS t(line, pattern)
    WHERE len(list_filter(string_split(ref, ';'), lambda x: regexp_matches(trim(x), pattern))) > 0""")
def line_regex_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with each line whose patterns a part of their reference fits."""
    rules = spark.createDataFrame(_RULES, "line string, patterns array<string>, hints array<string>")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.translate("o_orderpriority", "-", ";").alias("ref"), F.lit("").alias("name_en"))
    return resolve.line_members(rows, rules).select("o_orderkey", "line")


@query("SELECT name, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') AS name FROM part) GROUP BY name")
def norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names with how many share them."""
    return table(spark, sf_dir, "part").groupBy(normal(F.col("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT c_custkey AS sid, 'phantom' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def phantom_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of status P."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), F.lit("x").alias("line"))
    met = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sid")).distinct().withColumn("line", F.lit("x")).withColumn("status", F.lit("met"))
    return resolve.with_phantoms(own, met).filter("status = 'phantom'").select("sid", "status")


@query(f"""SELECT c_custkey AS sid, round(CASE WHEN s.s_suppkey IS NULL THEN {LAT.format('c_custkey')} ELSE round({LAT.format('s.s_suppkey')}, 5) END, 5) AS new_lat,
    CASE WHEN s.s_suppkey IS NULL OR s.s_suppkey % 3 = 0 THEN c_name ELSE s.s_name END AS new_name, s.s_suppkey IS NOT NULL AND round({LAT.format('s.s_suppkey')}, 5) <> {LAT.format('c_custkey')} OR s.s_suppkey IS NOT NULL AND round({LNG.format('s.s_suppkey')}, 5) <> {LNG.format('c_custkey')} AS moved
    FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) s ON s.s_suppkey = c_custkey""")
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers moved and renamed by the supplier of the same key; every fifth match is a phantom."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_name").alias("name"), F.lit("").alias("name_th"), *place(F.col("c_custkey")))
    lat, lng = place(F.col("s_suppkey"))
    key = F.col("s_suppkey")
    found = table(spark, sf_dir, "supplier").select(
        key.alias("sid"),
        F.when(key % 5 == 0, "phantom").otherwise("high").alias("status"),
        lat.alias("osm_lat"),
        lng.alias("osm_lng"),
        F.when(key % 3 == 0, "").otherwise(F.col("s_name")).alias("osm_name_en"),
        F.lit("").alias("osm_name_th"),
    )
    return resolve.apply_corrections(own, found).select("sid", F.round("new_lat", 5).alias("new_lat"), "new_name", "moved")


_DELTA = f"(SELECT id, round({sql_origin_km('lat', 'lng')} * 1000 / 40, 3) AS d FROM {sql_points('customer', 'c_custkey')})"
_STATUS = "CASE WHEN d <= 300 THEN 'high' WHEN d <= 800 THEN 'medium' ELSE 'low' END"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.functions.geo import origin_km

    return points(spark, sf_dir, "customer", "c_custkey").select("id", F.round(origin_km("lat", "lng") * 1000 / 40, 3).alias("d"))


@query(f"SELECT status, method, count(*) AS n FROM (SELECT {_STATUS} AS status, CASE WHEN id % 2 = 0 THEN 'name' ELSE 'assignment' END AS method FROM {_DELTA}) GROUP BY GROUPING SETS ((status), (method), (status, method))")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by confidence, by method and by both."""
    rows = _deltas(spark, sf_dir).select(confidence(F.col("d")).alias("status"), F.when(F.col("id") % 2 == 0, "name").otherwise("assignment").alias("method"))
    sets = [[F.col("status"), F.col("method")], [F.col("status")], [F.col("method")]]
    return rows.groupingSets(sets, "status", "method").agg(F.count("*").alias("n"))


@query(f"SELECT id, CAST(round_even(d, 0) AS BIGINT) AS delta_m FROM {_DELTA} ORDER BY round_even(d, 0) DESC, id LIMIT 20")
def top_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest distances."""
    return _deltas(spark, sf_dir).select("id", F.bround("d").cast("long").alias("delta_m")).orderBy(F.desc("delta_m"), "id").limit(20)


@query("SELECT coalesce(nullif(event_type, ''), '(no network)') AS network, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, network LIMIT 20")
def network_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent networks."""
    network = F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit("(no network)"))
    return table(spark, sf_dir, "events").groupBy(network.alias("network")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "network").limit(20)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values inside JSON texts."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def sql_walk(nodes: str) -> str:
    """CTEs that walk the links of nodes (line, node, k): w has line, i, node."""
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line ORDER BY node) AS j FROM {nodes}),
    l AS (SELECT a.line, a.node AS src, b.node AS dst, CASE WHEN b.j = a.j + 1 AND a.k % 4 > 0 OR b.j = a.j + 3 THEN 0 ELSE 1 END AS other FROM o a JOIN o b
        ON a.line = b.line AND (b.j = a.j + 1 OR (a.k % 7 = 0 AND b.j = a.j + 3) OR (a.k % 11 = 0 AND b.j = a.j + 5))),
    e AS MATERIALIZED (SELECT line, u, v, min(other) AS other FROM (SELECT line, src AS u, dst AS v, other FROM l UNION ALL SELECT line, dst, src, other FROM l) GROUP BY ALL),
    w AS (SELECT line, 0 AS i, min(node) AS node, [min(node)] AS seen FROM o GROUP BY line
        UNION ALL SELECT line, i + 1, x.v, list_append(seen, x.v) FROM (SELECT w.line, w.i, any_value(w.seen) AS seen, min({{'other': e.other, 'v': e.v}}) AS x
            FROM w JOIN e ON e.line = w.line AND e.u = w.node AND NOT list_contains(w.seen, e.v) GROUP BY w.line, w.i))"""


def walked(nodes: DataFrame) -> DataFrame:
    """nodes (line, node, k) linked with the next one, and some with the third or fifth after them, and walked from the least."""
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("node")
    after = lambda n, type_, able: F.when(able, F.struct(F.lead("node", n).over(w).alias("dst"), type_.alias("type")))
    k = F.col("k")
    hops = F.array(after(1, F.when(k % 4 > 0, "link").otherwise("connection"), F.lit(True)), after(3, F.lit("link"), k % 7 == 0), after(5, F.lit("connection"), k % 11 == 0))
    links = nodes.select("line", F.col("node").alias("src"), hops.alias("x")).select("line", "src", F.explode("x").alias("x")).select("line", "src", "x.*").filter("dst IS NOT NULL")
    return lines.walk_lines(links, nodes.groupBy("line").agg(F.min("node").alias("start")))


@query(f"WITH RECURSIVE {sql_walk("(SELECT CAST(s_nationkey % 5 AS VARCHAR) AS line, printf('%06d', s_suppkey) AS node, s_suppkey AS k FROM supplier)")} SELECT line, i, node FROM w")
def line_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers walked from the smallest along their links: branches, loops and both kinds of links."""
    return walked(table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("string").alias("line"), F.format_string("%06d", "s_suppkey").alias("node"), F.col("s_suppkey").alias("k")))


@query("""WITH RECURSIVE b(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT s_suppkey, depth + 1 FROM b JOIN supplier ON s_suppkey // 3 = node AND s_suppkey <> node) SELECT node, depth FROM b""")
def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys below 1 in the tree of thirds."""
    from wayfare.operators.tags import below

    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey DIV 3").alias("parent"))
    return below(links, spark.range(1, 2).withColumnRenamed("id", "node"))


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR regexp_matches(c_mktsegment, '(?i)mach|auto')) AND " + LAT.format("c_custkey") + " BETWEEN 13.6e0 AND 13.9e0")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by equal or similar tags in a box."""
    from wayfare.operators.tags import in_box, tag_is, tag_like

    lat, lng = place(F.col("c_custkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("tags"), lat, lng)
    chosen = tag_is(F.col("tags"), "segment", "BUILDING") | tag_like(F.col("tags"), "segment", "mach|auto", True)
    return rows.filter(chosen & in_box(F.col("lat"), F.col("lng"), 13.6, 100.0, 13.9, 101.0)).select("c_custkey")


_RAIL_LINKS = "(SELECT s_suppkey AS src, s_suppkey + 1 AS dst, 'link' AS type FROM supplier UNION ALL SELECT s_suppkey, s_suppkey // 3, 'connection' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey > 0)"
_RAIL = f"(SELECT src, dst, round({_KM} + CASE WHEN type = 'connection' THEN 0.3e0 ELSE 0.0e0 END, 6) AS km FROM {_RAIL_LINKS} WHERE dst IN (SELECT s_suppkey FROM supplier))"


def rail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    pairs = keys.select("src", (F.col("src") + 1).alias("dst"), F.lit("link").alias("type"))
    return pairs.unionByName(keys.filter("src % 2 = 0 AND src > 0").select("src", F.expr("src DIV 3").alias("dst"), F.lit("connection").alias("type")))


@query(f"SELECT src, dst, km FROM {_RAIL} UNION ALL SELECT dst, src, km FROM {_RAIL}")
def rail_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of known stations, both ways, a change of line at extra cost."""
    pairs = rail_links(spark, sf_dir)
    edges = graph.rail_edges(pairs, points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("id", "node"))
    return graph.both_ways(edges.withColumn("km", F.round("km", 6)))


_BOATS = f"""(SELECT route, pier, arg_min(pos, (km, i)) AS pos FROM (
    SELECT v.route, v.i, v.pos, p.id AS pier, {sql_km('p.lat', 'p.lng', 'v.lat', 'v.lng')} AS km FROM {sql_points('customer', 'c_custkey')} p JOIN (
        SELECT route, i, lat, lng, coalesce(sum(step) OVER (PARTITION BY route ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS pos FROM (
            SELECT route, i, lat, lng, {sql_km('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step
            FROM (SELECT s_nationkey % 5 AS route, s_suppkey AS i, {LAT.format('s_suppkey')} AS lat, {LNG.format('s_suppkey')} AS lng FROM supplier) WINDOW w AS (PARTITION BY route ORDER BY i))) v
    ON abs(p.lat - v.lat) < 0.004) WHERE km < 0.3 GROUP BY route, pier)"""


@query(f"SELECT route, pier, round(pos, 5) AS pos, lead(pier) OVER (PARTITION BY route ORDER BY pos, pier) AS next_pier FROM {_BOATS}")
def boat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piers on routes with their places and the pier that follows."""
    from pyspark.sql import Window

    routes = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("route"), F.col("s_suppkey").alias("i"), *place(F.col("s_suppkey")))
    nodes = graph.boat_nodes(points(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("id", "pier"), routes)
    return nodes.select("route", "pier", F.round("pos", 5).alias("pos"), F.lead("pier").over(Window.partitionBy("route").orderBy("pos", "pier")).alias("next_pier"))


@query("""SELECT view, band, count(*) AS n, round(sum(value), 4) AS total FROM (
    SELECT 'cost' AS view, 3 * km AS value, """ + "CASE " + " ".join(f"WHEN 3 * km <= {b} THEN {i}" for i, b in enumerate([15, 25, 35, 50, 75, 100, 150, 200, 300])) + """ END AS band FROM (SELECT (c_custkey * 37 % 300) / 10.0e0 AS km FROM customer)
    UNION ALL SELECT 'time', round(km * 5, 6), """ + "CASE " + " ".join(f"WHEN round(km * 5, 6) <= {b} THEN {i}" for i, b in enumerate([5, 10, 15, 20, 30, 45, 60, 90, 120])) + """ END FROM (SELECT (c_custkey * 37 % 300) / 10.0e0 AS km FROM customer))
    WHERE band IS NOT NULL GROUP BY view, band""")
def transit_stop_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops by band under the best of all modes: three times the km stand for the cost, stored minutes for the time."""
    from wayfare.functions.constants import COST_BANDS, TIME_BANDS
    from wayfare.functions.geo import band

    km = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 37 % 300 / F.lit(10.0)).alias("km"))
    values = F.array(F.struct(F.lit("cost").alias("view"), (3 * F.col("km")).alias("value")), F.struct(F.lit("time").alias("view"), F.round(F.col("km") / 12.0 * 60, 6).alias("value")))
    rows = km.select(F.explode(values).alias("x")).select("x.*")
    at = F.when(F.col("view") == "cost", F.when(F.col("value") <= COST_BANDS[-1], band("value", COST_BANDS))).otherwise(F.when(F.col("value") <= TIME_BANDS[-1], band("value", TIME_BANDS)))
    return rows.withColumn("band", at).filter("band IS NOT NULL").groupBy("view", "band").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH f AS (SELECT line, arg_min(size, ord) AS size FROM (SELECT n_nationkey % 10 AS line, n_nationkey AS ord, n_nationkey % 3 AS size FROM nation WHERE n_nationkey < 18) GROUP BY line),
    s AS (SELECT s_nationkey % 10 AS line, count(*) AS n, round(arg_min({LAT.format('s_suppkey')}, s_suppkey), 6) AS first FROM supplier GROUP BY 1)
    SELECT line, CASE WHEN size > 0 THEN 'feature' ELSE 'stations' END AS source, CASE WHEN size > 0 THEN size ELSE n END AS n_points, CASE WHEN size > 0 THEN 13.5e0 ELSE first END AS first_lat
    FROM f FULL JOIN s USING (line) WHERE size > 0 OR n > 1""")
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's first feature, or the polyline of its stations."""
    spot = F.struct(F.lit(13.5).alias("lat"), F.lit(100.5).alias("lng"))
    key = F.col("n_nationkey")
    features = table(spark, sf_dir, "nation").filter(key < 18).select((key % 10).alias("line"), key.alias("ord"), F.array_repeat(spot, (key % 3).cast("int")).alias("points"))
    stations = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 10).alias("line"), F.col("s_suppkey").cast("string").alias("node"), *place(F.col("s_suppkey")))
    drawn = lines.line_geometry(stations, features)
    return drawn.select("line", "source", F.size("points").cast("long").alias("n_points"), F.round(F.col("points")[0]["lat"], 6).alias("first_lat"))


@query(f"""SELECT route, kind, count(*) AS n FROM (SELECT CASE WHEN {LNG.format('c_custkey')} < 100.52e0 THEN 'river' ELSE 'canal' END AS route,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'pier' WHEN c_nationkey % 2 = 0 THEN 'route' ELSE 'other' END AS kind FROM customer) GROUP BY route, kind""")
def pier_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features sorted into piers and routes (the type wins), each on its waterway by longitude."""
    _, lng = place(F.col("c_custkey"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "pier").when(F.col("c_nationkey") % 2 == 0, "route").otherwise("other")
    return table(spark, sf_dir, "customer").groupBy(F.when(lng < 100.52, "river").otherwise("canal").alias("route"), kind.alias("kind")).agg(F.count("*").alias("n"))
