"""Stations along lines: walks, anchors, interpolation and snapping to polylines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.geo import haversine_km, segment_share
from wayfare.session import materialise

#: Degrees around a segment's box in which points can snap to it, and km beyond which a point stays where it is.
BOX, SNAP_KM = 0.05, 10.0
#: Degrees of a hash cell in which points and segments meet.
CELL = 2 * BOX


def stretches(ways: DataFrame, joints: DataFrame) -> DataFrame:
    """ways (line, u, v), both directions of each link, with where each leads: end, back (the node before it) and steps.

    A way runs on through nodes that are no joints (line, node) and have two neighbours. Pointer doubling: each round
    doubles the stretch that a way knows, so a line without branches takes as many rounds as its length has binary
    digits. Ways that run in a circle without a joint have no row.
    """
    inner = ways.join(joints.withColumnRenamed("node", "u"), ["line", "u"], "left_anti").select("line", F.col("u").alias("v"), F.col("v").alias("w"))
    on = ways.join(inner, ["line", "v"]).filter("w <> u").select("line", "u", "v", F.col("v").alias("nu"), F.col("w").alias("nv"))
    known = ways.join(on, ["line", "u", "v"], "left").select("line", "u", "v", F.col("v").alias("end"), F.col("u").alias("back"), F.lit(1).alias("steps"), "nu", "nv")
    known, done = materialise(known), -1
    while True:
        count = known.filter("nu IS NULL").count()
        if count == done:
            return known.filter("nu IS NULL").drop("nu", "nv")
        done = count
        ahead = known.select("line", F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("end").alias("e"), F.col("back").alias("b"), F.col("steps").alias("s"), F.col("nu").alias("mu"), F.col("nv").alias("mv"))
        longer = known.filter("nu IS NOT NULL").join(ahead, ["line", "nu", "nv"]).select("line", "u", "v", F.col("e").alias("end"), F.col("b").alias("back"), (F.col("steps") + F.col("s")).alias("steps"), F.col("mu").alias("nu"), F.col("mv").alias("nv"))
        known = materialise(known.filter("nu IS NULL").unionByName(longer))


def _walk(start: str, part: pd.DataFrame) -> list[tuple[str | None, str, int]]:
    """From joint to joint: (None, node, place) of each that is reached, (joint, first node, place) of each stretch between."""
    near: dict[str, list[tuple]] = {}
    for row in part[["u", "other", "v", "end", "back", "steps"]].itertuples(index=False, name=None):
        near.setdefault(row[0], []).append(row[1:])
    at, place, seen, used, out = start, 0, {start}, set(), [(None, start, 0)]
    while True:
        able = [x for x in near.get(at, ()) if ((at, x[1]) not in used if x[4] > 1 else x[2] not in seen)]
        if not able:
            return out
        _, first, end, back, steps = min(able)
        out.append((at, first, place))
        used |= {(at, first), (end, back)}
        if end in seen:  # the last node before it is where the walk ends
            return out
        place += steps
        seen.add(end)
        out.append((None, end, place))
        at = end


def walk_lines(links: DataFrame, starts: DataFrame) -> DataFrame:
    """links (line, src, dst, type), starts (line, start) to line, i, node.

    From the start, to the smallest unvisited neighbour on the line each time, real links before connections. Where
    nodes have two neighbours there is nothing to choose: such stretches are contracted by pointer doubling, and only
    the start and the nodes with one, three or more neighbours are walked, a line in a task. The nodes between get their
    places from the stretches. Links with a null or two equal ends are none; a line without links is its start alone.
    """
    both = links.select("line", F.col("src").alias("u"), F.col("dst").alias("v"), "type").unionByName(links.select("line", F.col("dst").alias("u"), F.col("src").alias("v"), "type"))
    other = F.min((F.coalesce("type", F.lit("")) != "link").cast("int")).alias("other")
    ways = materialise(both.filter("line IS NOT NULL AND u <> v").groupBy("line", "u", "v").agg(other))
    begin = starts.select("line", F.col("start").alias("node"))
    joints = ways.groupBy("line", F.col("u").alias("node")).agg(F.count("*").alias("n")).filter("n <> 2").select("line", "node").unionByName(begin).distinct()
    joints = materialise(joints)
    runs = materialise(stretches(ways.select("line", "u", "v"), joints))
    walked = runs.join(joints.withColumnRenamed("node", "u"), ["line", "u"]).join(ways, ["line", "u", "v"])
    kind = {f.name: f.dataType.simpleString() for f in starts.schema.fields}

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = _walk(part.start.iloc[0], part.dropna(subset=["u"]))
        return pd.DataFrame([(key[0], *x) for x in found], columns=["line", "joint", "node", "i"])

    steps = starts.join(walked, "line", "left").groupBy("line").applyInPandas(run, f"line {kind['line']}, joint {kind['start']}, node {kind['start']}, i int")
    steps = materialise(steps)
    through = steps.filter("joint IS NOT NULL").select("line", F.col("joint").alias("end"), F.col("node").alias("back"), F.col("i").alias("before"))
    inner = runs.join(joints.withColumnRenamed("node", "u"), ["line", "u"], "left_anti").join(through, ["line", "end", "back"])
    between = inner.select("line", (F.col("before") + F.col("steps")).alias("i"), F.col("u").alias("node"))
    return steps.filter("joint IS NULL").select("line", "i", "node").unionByName(between)


def between_anchors(items: DataFrame) -> DataFrame:
    """items (line, i, anchor, fixable, lat, lng) to the fixable non-anchors with est_lat, est_lng.

    Between two anchors in equal steps; before the first or behind the last one, on by the step from the anchor's
    neighbour; without any anchor where they are. Only fixable stations count as steps.
    """
    line = Window.partitionBy("line").orderBy("i")
    before, after = (Window.partitionBy("line").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("i", F.desc("i")))  # frames that end here are linear
    place = F.struct("i", "lat", "lng", *(F.coalesce(F.col(c) - f(c).over(line), F.lit(0.0)).alias(f"{n}_{c}") for n, f in (("b", F.lag), ("a", F.lead)) for c in ("lat", "lng")))
    marked = items.withColumn("_p", place)
    marked = marked.withColumn("prev", F.last(F.when(F.col("anchor"), F.col("_p")), True).over(before)).withColumn("next", F.last(F.when(F.col("anchor"), F.col("_p")), True).over(after))
    gaps = marked.filter(~F.col("anchor") & F.col("fixable"))
    gap = Window.partitionBy("line", "prev.i", "next.i")
    steps = gaps.withColumn("k", F.row_number().over(gap.orderBy("i"))).withColumn("n", F.count("*").over(gap))

    def guess(c: str):
        p, q = F.col(f"prev.{c}"), F.col(f"next.{c}")
        return (
            F.when(p.isNotNull() & q.isNotNull(), p + F.col("k") / (F.col("n") + 1) * (q - p))
            .when(p.isNotNull(), p + F.col(f"prev.b_{c}") * F.col("k"))
            .when(q.isNotNull(), q + F.col(f"next.a_{c}") * (F.col("n") - F.col("k") + 1))
            .otherwise(F.col(c))
        )

    return steps.select(*items.columns, guess("lat").alias("est_lat"), guess("lng").alias("est_lng"))


def segments(routes: DataFrame) -> DataFrame:
    """routes (line, i, lat, lng) to line, i, lat1, lng1, lat2, lng2."""
    w = Window.partitionBy("line").orderBy("i")
    return routes.select("line", "i", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2")).filter("lat2 IS NOT NULL")


def _once(rows: DataFrame, name: str, value) -> DataFrame:
    """rows with a column that is worked out once, however often later columns name it: the planner inlines plain ones."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _met(points: DataFrame, parts: DataFrame, side: float) -> DataFrame:
    """points and parts that share line and cell. Cells hold few bytes but many pairs, so the number of tasks is not left to sizes."""
    n, at = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["line", "_r", "_c"]
    binned = points.withColumn("_r", F.floor(F.col("lat") / side)).withColumn("_c", F.floor(F.col("lng") / side))
    return binned.repartition(n, *at).join(parts.repartition(n, *at), at)


def _near(points: DataFrame, parts: DataFrame, km: float, side: float) -> DataFrame:
    """points with each segment of their line that may have a place within km of them; both meet by line and cell.

    A point is in one cell. A segment goes to the cells that lie along it: column by column, the rows that its part
    there can be near to. So there are as many rows as its length has cells, not as many as its box.
    """
    reach = km / 110.5  # degrees of latitude, a little more than km
    wide = F.lit(reach) / F.cos(F.radians(F.least(F.greatest(F.abs("lat1"), F.abs("lat2")) + reach, F.lit(89.0))))
    west, east, dx = F.least("lng1", "lng2"), F.greatest("lng1", "lng2"), F.col("lng2") - F.col("lng1")
    columns = F.explode(F.sequence(F.floor((west - F.col("_w")) / side), F.floor((east + F.col("_w")) / side)))
    at = lambda x: F.col("lat1") + (F.least(F.greatest(x, west), east) - F.col("lng1")) / dx * (F.col("lat2") - F.col("lat1"))
    steep = F.abs(dx) < 1e-6
    ends = [F.when(steep, F.col(e)).otherwise(at(x)) for e, x in (("lat1", F.col("_c") * side - F.col("_w")), ("lat2", (F.col("_c") + 1) * side + F.col("_w")))]
    rows = F.explode(F.sequence(F.floor((F.col("_e.low") - reach) / side), F.floor((F.col("_e.high") + reach) / side)))
    s = _once(_once(parts, "_w", wide).withColumn("_c", columns), "_e", F.struct(F.least(*ends).alias("low"), F.greatest(*ends).alias("high")))
    return _met(points, s.withColumn("_r", rows).drop("_w", "_e"), side)


def _boxed(points: DataFrame, parts: DataFrame) -> DataFrame:
    """points with each segment of their line in whose widened box they may be; both meet by line and cell, in each cell that the box touches."""
    cells = lambda c: F.explode(F.sequence(F.floor(_low(c) / CELL), F.floor(_high(c) / CELL)))
    s = parts.withColumn("_r", cells("lat")).withColumn("_c", cells("lng"))
    return _met(points, s, CELL)


def _low(c: str):
    return F.least(f"{c}1", f"{c}2") - BOX


def _high(c: str):
    return F.greatest(f"{c}1", f"{c}2") + BOX


def _on_segments(near: DataFrame) -> DataFrame:
    """near, where the point is in the widened box of the segment, with the place on it (s_lat, s_lng) and the km there."""
    inside = near.filter(F.col("lat").between(_low("lat"), _high("lat")) & F.col("lng").between(_low("lng"), _high("lng")))
    on = _once(inside, "t", segment_share("lat", "lng", "lat1", "lng1", "lat2", "lng2"))
    place = F.struct((F.col("lat1") + F.col("t") * (F.col("lat2") - F.col("lat1"))).alias("s_lat"), (F.col("lng1") + F.col("t") * (F.col("lng2") - F.col("lng1"))).alias("s_lng"))
    on = _once(on, "_s", place).select("*", "_s.*")
    return _once(on, "km", haversine_km("lat", "lng", "s_lat", "s_lng"))


#: km up to which the nearest segment is looked for first, and degrees of a cell there.
REACHES = ((0.5, 0.02), (5.0, 0.1))


def snap(points: DataFrame, routes: DataFrame) -> DataFrame:
    """points (point, line, lat, lng) with snap_lat, snap_lng, snap_km: the nearest place on the line's polyline.

    A segment is looked at if the point is in its box, widened. The first of equally near segments wins; farther than
    10 km, or without a segment, the point stays and snap_km is null. Points that find a segment within the first of
    REACHES are settled, as all segments that near were looked at; only the others look farther, and the last of them
    at every widened box. Each time the least distance comes first, from a hash aggregate of one number, and then the
    segments that have it: an aggregate of records would sort all pairs.
    """
    parts = materialise(segments(routes))
    left, settled = materialise(points.select("point", "line", "lat", "lng").dropna()), None
    for km, side in (*REACHES, (None, None)):
        pairs = lambda some: _on_segments(_boxed(some, parts) if km is None else _near(some, parts, km, side))  # noqa: B023, E731
        least = materialise(pairs(left).groupBy("point").agg(F.min("km").alias("least")).filter(F.lit(True) if km is None else F.col("least") <= km - 1e-9))
        equal = pairs(left.join(least, "point")).filter(F.col("km") <= F.col("least") + 2e-9).filter(F.round("km", 9) == F.round("least", 9))
        best = equal.groupBy("point").agg(F.min(F.struct(F.round("km", 9).alias("km"), "i", "s_lat", "s_lng")).alias("x"))
        settled = best if settled is None else settled.unionByName(best)
        left = materialise(left.join(least, "point", "left_anti"))
        if km is not None and left.isEmpty():
            break
    good = F.col("x.km") <= SNAP_KM
    return points.join(settled, "point", "left").select(
        *points.columns,
        F.when(good, F.col("x.s_lat")).otherwise(F.col("lat")).alias("snap_lat"),
        F.when(good, F.col("x.s_lng")).otherwise(F.col("lng")).alias("snap_lng"),
        F.when(good, F.col("x.km")).alias("snap_km"),
    )


def repair(items: DataFrame, stations: DataFrame, routes: DataFrame) -> DataFrame:
    """line, node, lat, lng of repaired stations: estimates between anchors and branches, snapped to the line's route.

    items: the stations of the walk (line, i, node, anchor, fixable, lat, lng); stations: all of them, without i. Those
    that the walk misses are branches, which are snapped from where they are. Lines without a route are left alone.
    """
    routed = routes.select("line").distinct()
    guessed = between_anchors(items).select(F.col("node").alias("point"), "line", F.col("est_lat").alias("lat"), F.col("est_lng").alias("lng"))
    missed = stations.join(items.select("line", "node"), ["line", "node"], "left_anti").filter("NOT anchor AND fixable")
    every = guessed.unionByName(missed.select(F.col("node").alias("point"), "line", "lat", "lng")).join(routed, "line", "left_semi")
    return snap(every, routes).select("line", F.col("point").alias("node"), *(F.round(F.round(f"snap_{c}", 9), 5).alias(c) for c in ("lat", "lng")))


def line_geometry(stations: DataFrame, features: DataFrame) -> DataFrame:
    """line, source, points of each line with stations (line, node, lat, lng) or features (line, ord, points).

    The first feature of a line, if it has points; else its stations in the order of their digits, if there are two or more.
    """
    from wayfare.functions.text import number_in

    first = features.groupBy("line").agg(F.min_by("points", "ord").alias("shape"))
    stop = F.struct(number_in(F.col("node")).alias("k"), "node", "lat", "lng")
    listed = stations.groupBy("line").agg(F.array_sort(F.collect_list(stop)).alias("stops"))  # a line's stations are few
    own = F.transform("stops", lambda s: F.struct(s["lat"].alias("lat"), s["lng"].alias("lng")))
    drawn = F.when(F.size("shape") > 0, F.struct(F.lit("feature").alias("source"), F.col("shape").alias("points"))).when(F.size("stops") > 1, F.struct(F.lit("stations").alias("source"), own.alias("points")))
    return listed.join(first, "line", "full").select("line", drawn.alias("x")).filter("x IS NOT NULL").select("line", "x.source", "x.points")
