"""Map elements to lines: what relations are made of, and way pieces stitched to LineStrings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.graph import components
from wayfare.operators.lines import stretches
from wayfare.operators.tags import recurse_down
from wayfare.session import materialise


def route_ways(elements: DataFrame, routes: DataFrame) -> DataFrame:
    """line, way, i, node: the ways of each route relation or single way, with their nodes in order.

    elements: type, id, nodes array<long>, members array<struct<type, ref>>, as downloaded; routes: those of them that
    were asked for. Relations may hold relations: the route of a way is the one that was asked for. A way of several
    routes is there once for each.
    """
    keyed = elements.select("type", "id", "members")
    made_of = recurse_down(keyed, routes.select("type", "id", "members")).filter("type <> 'node'")
    parts = made_of.select("type", "id", F.explode("members").alias("m")).select(F.struct("type", "id").alias("of"), F.struct(F.col("m.type").alias("type"), F.col("m.ref").alias("id")).alias("part")).filter("part.type <> 'node'").distinct()
    parts = materialise(parts)
    level = found = materialise(routes.select(F.struct("type", "id").alias("line"), F.struct("type", "id").alias("part")).distinct())
    while True:
        level = level.select("line", F.col("part").alias("of")).join(parts, "of").select("line", "part").distinct()
        level = materialise(level.join(found, ["line", "part"], "left_anti"))
        if level.isEmpty():
            break
        found = materialise(found.unionByName(level))
    ways = found.filter("part.type = 'way'").select(F.concat_ws("/", "line.type", "line.id").alias("line"), F.col("part.id").alias("id"))
    nodes = elements.filter("type = 'way'").select("id", "nodes")
    return ways.join(nodes, "id").select("line", F.col("id").alias("way"), F.posexplode("nodes").alias("i", "node"))


def stitch(pieces: DataFrame, circles: bool = True) -> DataFrame:
    """pieces (line, way, i, node) to line, string, place, node: way pieces of a line joined where exactly two of their ends meet.

    Ends of one, three or more pieces end a string; a closed piece is a string of its own; pieces that close a circle
    without such an end are cut at the circle's least end. A string starts at the lesser of its two ends and is named
    by it and its first way. Pieces know where they lie from pointer doubling along the chain, so a string of n pieces
    takes as many rounds as n has binary digits, and nothing but a point list is ever gathered. Pieces of one node are none.
    Without `circles`, closed pieces and circles without an end are left out: only what lies between two ends is a string.
    """
    pieces = materialise(pieces.select("line", "way", "i", "node"))
    ends = pieces.groupBy("line", "way").agg(F.min_by("node", "i").alias("first"), F.max_by("node", "i").alias("last"), F.max("i").alias("top"))
    ends = materialise(ends.filter("top > 0"))
    name = lambda kind, c: F.concat(F.lit(kind), F.format_string("%020d", F.col(c)))
    open_ = ends.filter("first <> last")
    links = open_.select("line", name("w", "way").alias("u"), F.explode(F.array("first", "last")).alias("end")).select("line", "u", name("n", "end").alias("v"))
    both = materialise(links.unionByName(links.select("line", F.col("v").alias("u"), F.col("u").alias("v"))))
    joints = both.filter("u LIKE 'n%'").groupBy("line", F.col("u").alias("node")).agg(F.count("*").alias("n")).filter("n <> 2").select("line", "node")
    runs = materialise(stretches(both, joints))
    circling = materialise(both.filter("u LIKE 'w%'").join(runs, ["line", "u"], "left_anti")) if circles else None
    if circling is not None and not circling.isEmpty():
        key = lambda c: F.concat_ws("/", "line", c)
        of = components(circling.select(key("u").alias("a"), key("v").alias("b")))
        cut = circling.withColumn("node", key("v")).join(of, "node").groupBy("line", "component").agg(F.min("v").alias("node")).select("line", "node")
        again = both.join(circling.select("line", "u").unionByName(circling.select("line", F.col("v").alias("u"))).distinct(), ["line", "u"], "left_semi")
        runs = materialise(runs.unionByName(stretches(again, cut)))
    # of the two ways out of a piece, the one to the lesser (end, piece before it) leads back to the start
    out = runs.filter("u LIKE 'w%'").groupBy("line", "u").agg(F.min(F.struct("end", "back", "steps", "v")).alias("x"))
    chained = out.select("line", F.substring("u", 2, 20).cast("long").alias("way"), F.concat("x.end", "x.back").alias("string"), F.expr("x.steps DIV 2").alias("rank"), F.substring("x.v", 2, 20).cast("long").alias("from"))
    whole = ends.filter("first = last").select("line", "way", F.concat(name("n", "first"), name("w", "way")).alias("string"), F.lit(0).alias("rank"), F.col("first").alias("from"))
    placed = (chained.unionByName(whole) if circles else chained).join(ends, ["line", "way"])
    turned = (F.col("from") != F.col("first")).alias("turned")
    at = F.when(F.col("turned"), F.col("top") - F.col("i")).otherwise(F.col("i"))
    points = pieces.join(placed.select("line", "way", "string", "rank", "top", turned), ["line", "way"]).withColumn("at", at)
    # where two pieces meet the node is taken once, as the end of the first
    return points.filter("rank = 0 OR at > 0").select("line", "string", F.struct("rank", "at").alias("place"), "node")


def line_strings(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points of `stitch` and nodes (node, lat, lng) to line, string, points array<struct<lat, lng>> in order; unknown nodes are left out.

    The shape of read_features: a string is one feature, and its own point list the most that a task gathers.
    """
    spots = F.transform(F.array_sort(F.collect_list(F.struct("place", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
    return points.join(nodes, "node").groupBy("line", "string").agg(spots.alias("points")).filter(F.size("points") > 1)
