"""Graphs as edge tables: builders and shortest paths by rounds of relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.functions.fares import minutes, mode_fare, walk_minutes
from wayfare.functions.geo import band, haversine_km, origin_km
from wayfare.operators.spatial import radius_join
from wayfare.session import TASK_ROWS, broadcast_if_light, bucketed, materialise, task_count


def rail_edges(links: DataFrame, stations: DataFrame) -> DataFrame:
    """links (src, dst, type) of known stations (node, lat, lng) to src, dst, km; a change of line costs extra."""
    at = lambda end: stations.select(F.col("node").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lng").alias(f"{end}_lng"))
    km = haversine_km("src_lat", "src_lng", "dst_lat", "dst_lng") + F.when(F.col("type") == "connection", K.CONNECTION_KM).otherwise(0.0)
    return links.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", km.alias("km"))


def trip_edges(visits: DataFrame, order: list[str]) -> DataFrame:
    """visits (trip, stop, ...) to the distinct directed pairs of stops that follow each other on a trip."""
    after = F.lead("stop").over(Window.partitionBy("trip").orderBy(*order))
    n = task_count(visits)
    steps = visits.repartition(n, "trip").select(F.col("stop").alias("src"), after.alias("dst")).filter("dst IS NOT NULL")
    return steps.repartition(n, "src", "dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


#: Nodes of one place in a list at most; a place with more has several lists.
PLACE_NODES = 256


def transfers(nodes: DataFrame, km: float = K.TRANSFER_KM) -> DataFrame:
    """Walks between nodes (node, kind, lat, lng) of different kinds or both of buses: src < dst, km.

    Distances are worked out between places, each pair of them once; lists of the nodes there are laid side by side, and
    rows for pairs of nodes come up only where they are written, after the last shuffle. Two kinds of one place, and two
    nodes of one list, count too.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = Window.partitionBy("lat", "lng").orderBy("node")
    listed = nodes.dropna(subset=["lat", "lng"]).withColumn("part", F.floor((F.row_number().over(place) - 1) / PLACE_NODES))
    listed = materialise(listed.groupBy("lat", "lng", "part").agg(F.collect_list(F.struct("node", "kind")).alias("nodes")))
    a = listed.select(F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.col("part").alias("a_part"), F.col("nodes").alias("a"))
    b = listed.select(F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), F.col("part").alias("b_part"), F.col("nodes").alias("b"))
    spots = materialise(listed.select("lat", "lng").distinct())
    other = spots.select(F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    first = F.struct("a_lat", "a_lng") <= F.struct("b_lat", "b_lng")
    near = radius_join(spots.withColumnsRenamed({"lat": "a_lat", "lng": "a_lng"}), other, km, ("a_lat", "a_lng"), ("b_lat", "b_lng"), K.CELL).filter(first)
    meet = near.join(a, ["a_lat", "a_lng"]).repartition(n, "b_lat", "b_lng").join(b.repartition(n, "b_lat", "b_lng"), ["b_lat", "b_lng"])
    # lists of one place are paired once, in either order of its nodes; a list with itself has every pair twice
    same = (F.col("a_lat") == F.col("b_lat")) & (F.col("a_lng") == F.col("b_lng"))
    rows = meet.filter(~same | (F.col("a_part") <= F.col("b_part"))).select("km", (same & (F.col("a_part") == F.col("b_part"))).alias("own"), "b", F.explode("a").alias("x")).select("km", "own", "x", F.explode("b").alias("y"))
    able = (F.col("x.kind") != F.col("y.kind")) | (F.col("x.kind") == "bus")
    return rows.filter(able & (F.col("x.node") != F.col("y.node")) & (~F.col("own") | (F.col("x.node") < F.col("y.node")))).select(F.least("x.node", "y.node").alias("src"), F.greatest("x.node", "y.node").alias("dst"), "km")


def ride_minutes(km: Column, src_kind: Column, dst_kind: Column) -> Column:
    """At walking speed between kinds, else at the speed of the kind, walks between bus stops included."""
    speed = F.coalesce(F.element_at(F.create_map(*(x for k, v in K.MODE_SPEED.items() for x in (F.lit(k), F.lit(v)))), dst_kind), F.lit(K.WALK_SPEED))
    return km / F.when(src_kind != dst_kind, K.WALK_SPEED).otherwise(speed) * 60


#: Rounds of shortest_paths over all edges before those that cannot matter are left out, rounds in one job after that, and rounds before trees are gone down.
FIRST_ROUNDS, JOB_ROUNDS, PLAIN_ROUNDS = 2, 4, 12
#: Steps of a tree that one job goes up.
TREE_STEPS = 8
#: Parts of a km or a minute in which shortest_paths adds up, as whole numbers: sums are exact, and equal ways equal.
PARTS = 1e12


def relax(costs: DataFrame, frontier: DataFrame, known: DataFrame) -> DataFrame:
    """node, km, minutes of the steps from `frontier` over `costs` (src, dst, km, minutes) that beat all that is known (node, km, minutes).

    With costs in buckets of src and the other two in buckets of node, only the steps are shuffled.
    """
    start = frontier.select(F.col("node").alias("src"), F.col("km").alias("km0"), F.col("minutes").alias("min0"))
    steps = costs.join(start, "src").select(F.col("dst").alias("node"), (F.col("km0") + F.col("km")).alias("km"), (F.col("min0") + F.col("minutes")).alias("minutes"))
    new = steps.groupBy("node").agg(F.min(F.struct("km", "minutes")).alias("d")).select("node", "d.km", "d.minutes").alias("new")
    as_good = F.struct("old.km", "old.minutes") <= F.struct("new.km", "new.minutes")
    return new.join(known.alias("old"), (F.col("new.node") == F.col("old.node")) & as_good, "left_anti")


def useful(costs: DataFrame, best: DataFrame) -> DataFrame:
    """The edges (src, dst, km, minutes, low) that can still be part of a best way: from `low`, which no way to src is shorter than, they lead to dst within the km known (node, km)."""
    known = broadcast_if_light(best.select(F.col("node").alias("dst"), F.col("km").alias("most")))
    return costs.join(known, "dst", "left").filter(F.col("most").isNull() | (F.col("low") + F.col("km") <= F.col("most"))).select(*costs.columns)


def hop(costs: DataFrame, state: DataFrame, high: int | None = None, loops: bool = True) -> DataFrame:
    """One edge farther from all open nodes (below `high`): state (node, km, minutes, open) to the same. A node is open if it has a better way than when it was last gone from.

    Every node has a loop among the costs that carries its state on, so with costs in buckets of src a round has one
    shuffle, that of its steps, and several fit one job; without loops the state is read once more.
    """
    start = state.select(F.col("node").alias("src"), F.col("km").alias("km0"), F.col("minutes").alias("min0"), "open", (F.col("open") & (F.col("km") < high if high is not None else F.lit(True))).alias("ready"))
    own = F.col("src") == F.col("dst")
    d = F.struct((F.col("km0") + F.col("km")).alias("km"), (F.col("min0") + F.col("minutes")).alias("minutes"))
    waits = (F.col("open") & ~F.col("ready")).alias("waits")
    steps = costs.join(start.hint("shuffle_hash"), "src").filter(F.col("ready") | own).select("dst", d.alias("d"), F.when(own, d).alias("old"), (own & waits).alias("waits"))
    if not loops:
        d = F.struct(F.col("km0").alias("km"), F.col("min0").alias("minutes"))
        steps = steps.unionByName(start.select(F.col("src").alias("dst"), d.alias("d"), d.alias("old"), waits))
    least = steps.groupBy("dst").agg(F.min("d").alias("d"), F.min("old").alias("old"), F.max("waits").alias("waits"))
    return least.select(F.col("dst").alias("node"), "d.km", "d.minutes", (F.col("old").isNull() | (F.col("d") < F.col("old")) | F.col("waits")).alias("open"))


def along_tree(costs: DataFrame, state: DataFrame) -> DataFrame:
    """State of `hop` after a round from all nodes, with each node's km and minutes added up anew along the best last edges.

    What makes a node better so reaches all that are behind it at once, however many edges away: a job goes eight times
    as far up as the one before it. Edges of 0 km and 0 minutes are no last edges, so these lead to no circle.
    """
    at = broadcast_if_light(state.select(F.col("node").alias("src"), F.col("km").alias("km0"), F.col("minutes").alias("min0")))
    last = F.struct((F.col("km0") + F.col("km")).alias("km"), (F.col("min0") + F.col("minutes")).alias("minutes"), F.col("src"), F.col("km").alias("step_km"), F.col("minutes").alias("step_minutes"))
    best = costs.filter("km > 0 OR minutes > 0").join(at, "src").groupBy(F.col("dst").alias("node")).agg(F.min(last).alias("x"))
    known = [F.coalesce(c, f"x.{c}").alias(c) for c in ("km", "minutes")]
    joined = state.join(best, "node", "full").select("node", *known, F.coalesce("open", F.lit(True)).alias("open"), "x")
    has = F.col("x").isNotNull() & (F.struct("x.km", "x.minutes") <= F.struct("km", "minutes"))
    part = lambda c: F.when(has, F.col(f"x.step_{c}")).otherwise(F.col(c)).alias(f"up_{c}")
    rows = materialise(joined.select(*state.columns, F.when(has, F.col("x.src")).alias("up"), part("km"), part("minutes")))
    more = lambda c: (F.col(f"up_{c}") + F.coalesce(f"more_{c}", F.lit(0))).alias(f"up_{c}")
    while not rows.filter("up IS NOT NULL").isEmpty():
        lead = broadcast_if_light(rows.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("up_km").alias("more_km"), F.col("up_minutes").alias("more_minutes")))
        for _ in range(TREE_STEPS - 1):
            rows = rows.join(lead, "up", "left").select(*state.columns, F.col("next").alias("up"), more("km"), more("minutes"))
        rows = materialise(rows)
    now, before = F.struct("up_km", "up_minutes"), F.struct("km", "minutes")
    return rows.select("node", F.col("up_km").alias("km"), F.col("up_minutes").alias("minutes"), (F.col("open") | (now < before)).alias("open"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, width: float | None = None) -> DataFrame:
    """edges (src, dst, km, minutes), taken as directed, and seeds (node, km, minutes) to node, km, minutes.

    Minutes are those of the way of fewest km (of equal ones the fewest minutes). Edges are written once, in buckets of
    src, the best of parallel ones only. After two rounds over all of them the edges that no best way can take are left
    out. A round goes one edge farther from the nodes that came to be better; where that takes many rounds, each job goes
    down the tree of the best ways too, so rounds are far fewer than a way has edges. With a `width` nodes wait that lie farther than so many km behind the
    nearest of those (delta-stepping).

    Edges may have `ahead` and `straight` as well: km that src is away from the seeds, and dst from src, in straight
    lines. If every edge has at least a share of its straight line, no way to src is shorter than that share of
    `ahead`, so an edge that strays from the ways known is left out.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = lambda c: F.rint(F.col(c) * PARTS).cast("long")
    lines = ["ahead", "straight"] if {"ahead", "straight"} <= set(edges.columns) else []
    one = edges.filter("src <> dst").repartition(n, "src").groupBy("src", "dst").agg(F.min(F.struct(whole("km").alias("km"), whole("minutes").alias("minutes"))).alias("d"), *(F.min(c).alias(c) for c in lines))
    costs = spark.table(bucketed(one.select("src", "dst", "d.km", "d.minutes", *lines), "src"))
    low = F.lit(0)
    if lines:
        share = costs.agg(F.min(F.when(F.col("straight") == 0, 1.0).otherwise(F.coalesce(F.col("km") / PARTS / F.col("straight"), F.lit(0.0))))).first()[0]
        low = F.floor(F.coalesce(F.col("ahead"), F.lit(0.0)) * (min(share or 0.0, 1.0) * (1 - 1e-9)) * PARTS)
    least = seeds.groupBy("node").agg(F.min(F.struct(whole("km").alias("km"), whole("minutes").alias("minutes"))).alias("d"))
    state = materialise(least.select("node", "d.km", "d.minutes", F.lit(True).alias("open")))
    costs, number, many = costs.select("src", "dst", "km", "minutes", low.cast("long").alias("low")), 0, True
    ways = costs
    while True:
        nearest = state.filter("open").agg(F.min("km")).first()[0]
        if nearest is None:
            return state.select("node", (F.col("km") / PARTS).alias("km"), (F.col("minutes") / PARTS).alias("minutes"))
        if many and number >= FIRST_ROUNDS:
            kept = bucketed(useful(costs, state).repartition(n, "src"), "src")
            ends = spark.table(kept).select(F.explode(F.array("src", "dst")).alias("node")).unionByName(state.select("node")).distinct()
            zero = (F.lit(0).cast("long").alias(x) for x in ("km", "minutes", "low"))
            ways = spark.table(bucketed(ends.select(F.col("node").alias("src"), F.col("node").alias("dst"), *zero), "src", kept))
            before, costs = costs.count(), ways.filter("src <> dst")
            left = costs.count()
            many = left > TASK_ROWS and 4 * left < 3 * before
        rounds = 1 if number < FIRST_ROUNDS else JOB_ROUNDS
        for _ in range(rounds):
            state = hop(ways, state, None if width is None else nearest + int(width * PARTS), number >= FIRST_ROUNDS)
        state, number = materialise(state), number + rounds
        if number > PLAIN_ROUNDS and not state.filter("open").isEmpty():
            state = along_tree(costs, state)


def origin_seeds(nodes: DataFrame, km: float = K.WALK_KM) -> DataFrame:
    """Nodes within reach of the origin on foot, with the walk."""
    return nodes.withColumn("km", origin_km("lat", "lng")).filter(F.col("km") <= km).select("node", "km", walk_minutes("km").alias("minutes"))


def boat_nodes(piers: DataFrame, routes: DataFrame) -> DataFrame:
    """piers (pier, lat, lng), routes (route, i, lat, lng) to node, route, pier, pos: piers less than 300 m off a route.

    A pier near two routes is a node on each. pos is the place along the route of the nearest vertex, one segment behind.
    """
    at = positions(routes, "route", "i")
    near = radius_join(piers.withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"}), at, K.PIER_KM, ("p_lat", "p_lng"), ("lat", "lng"), strict=True)
    first = near.groupBy("route", "pier").agg(F.min(F.struct("km", "i", "pos")).alias("x")).select("route", "pier", "x.pos")
    return first.withColumn("node", F.concat_ws("_", F.lit("boat"), "route", "pier"))


def positions(routes: DataFrame, route: str, order: str) -> DataFrame:
    """routes with pos: km from the start, recorded before the segment that leads to the vertex is added."""
    w = Window.partitionBy(route).orderBy(order)
    step = haversine_km(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return routes.withColumn("_step", step).withColumn("pos", F.coalesce(F.sum("_step").over(before), F.lit(0.0))).drop("_step")


def boat_edges(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("route").orderBy("pos", "pier")
    return nodes.select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).filter("dst IS NOT NULL")


def stands(nodes: DataFrame) -> DataFrame:
    """node, kind, lat, lng, stand, outward, inward: what a node is one with, and where walks from it and to it begin and end.

    Nodes of one place are one if walks of 0 km join them, that is if there is a bus stop or more than one kind among
    them. Others of one kind at a place are apart, but share the walks: those lead through two points of their own.
    """
    at = nodes.dropna(subset=["lat", "lng"]).groupBy("lat", "lng").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))
    known = nodes.join(at, ["lat", "lng"], "left")
    apart = (F.col("n") > 1) & (F.size("kinds") == 1) & ~F.array_contains("kinds", "bus")
    door = lambda way: F.when(apart, F.concat(F.lit(f"{way} "), F.col("first"))).otherwise(F.coalesce("first", "node"))
    return known.select("node", "kind", "lat", "lng", F.when(apart, F.col("node")).otherwise(F.coalesce("first", "node")).alias("stand"), door("from").alias("outward"), door("to").alias("inward"))


def stand_walks(stood: DataFrame, km: float = K.TRANSFER_KM) -> DataFrame:
    """The walks of `transfers` between stands (src, dst, km, minutes, ahead, straight), both ways: one for two places, of the kinds that take the fewest minutes."""
    of = stood.dropna(subset=["lat", "lng"])
    places = materialise(of.groupBy("lat", "lng", "outward", "inward", "ahead").agg(F.sort_array(F.collect_set("kind")).alias("kinds")))
    side = lambda x: places.select(*(F.col(c).alias(f"{x}_{c}") for c in places.columns))
    near = radius_join(side("a"), side("b"), km, ("a_lat", "a_lng"), ("b_lat", "b_lng"), K.CELL).filter(F.struct("a_lat", "a_lng") < F.struct("b_lat", "b_lng")).withColumn("km", F.round("km", 6))
    buses = F.array_contains("a_kinds", "bus") & F.array_contains("b_kinds", "bus")
    unlike = (F.size("a_kinds") > 1) | (F.col("a_kinds") != F.col("b_kinds"))
    took = F.when(buses, ride_minutes(F.col("km"), F.lit("bus"), F.lit("bus"))).when(unlike, ride_minutes(F.col("km"), F.lit(""), F.lit("bus")))
    near = materialise(near.withColumn("minutes", F.round(took, 6)).filter("minutes IS NOT NULL"))
    one = lambda a, b: near.select(F.col(f"{a}_outward").alias("src"), F.col(f"{b}_inward").alias("dst"), "km", "minutes", F.col(f"{a}_ahead").alias("ahead"), F.col("km").alias("straight"))
    steps = of.filter("stand <> outward")
    step = lambda a, b: steps.select(F.col(a).alias("src"), F.col(b).alias("dst"), *(F.lit(0.0).alias(c) for c in ("km", "minutes")), "ahead", F.lit(0.0).alias("straight"))
    return one("a", "b").unionByName(one("b", "a")).unionByName(step("stand", "outward")).unionByName(step("inward", "stand"))


def timed(edges: DataFrame, stood: DataFrame) -> DataFrame:
    """edges (src, dst, km) between known nodes, both ways and with minutes, as edges of their stands; without km, those of the straight line."""
    stood = broadcast_if_light(stood.select("node", "kind", "stand", "lat", "lng", "ahead"))
    end = lambda e: stood.select(F.col("node").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in ("kind", "stand", "lat", "lng", "ahead")))
    known = edges.join(end("src"), "src").join(end("dst"), "dst").withColumn("straight", haversine_km("src_lat", "src_lng", "dst_lat", "dst_lng"))
    known = known.withColumn("km", F.coalesce("km", F.round("straight", 6))).filter("km IS NOT NULL")
    ways = [(a, b, F.round(ride_minutes(F.col("km"), F.col(f"{a}_kind"), F.col(f"{b}_kind")), 6)) for a, b in (("src", "dst"), ("dst", "src"))]
    way = lambda a, b, took: F.struct(F.col(f"{a}_stand").alias("src"), F.col(f"{b}_stand").alias("dst"), took.alias("minutes"), F.col(f"{a}_ahead").alias("ahead"))
    return known.select("km", "straight", F.explode(F.array(*(way(*w) for w in ways))).alias("x")).select("x.src", "x.dst", "km", "x.minutes", "x.ahead", "straight")


def multimodal_reach(nodes: DataFrame, rides: list[DataFrame], entries: DataFrame) -> DataFrame:
    """What can be reached in the graph of all kinds: node, kind, lat, lng, km, minutes, rounded as in the reach file.

    nodes (node, kind, lat, lng); rides: edge lists (src, dst, and km unless it is the straight line's), to which walks
    between near nodes are added; entries (node, km, minutes), a few, beside the bus stops and piers within a walk of the
    origin. Nodes that walks of 0 km join are one in the graph, so it grows with places and not with pairs of nodes.
    """
    # straight lines from the origin and from each entry; a list of entries, which are few
    first = nodes.join(entries.select("node", "km"), "node").dropna(subset=["lat", "lng"]).agg(F.collect_list(F.struct("lat", "lng", "km")).alias("x")).first()["x"]
    lines = [origin_km("lat", "lng"), *(F.lit(e.km) + haversine_km(e.lat, e.lng, "lat", "lng") for e in first)]
    stood = materialise(stands(nodes).withColumn("ahead", F.coalesce(F.least(*lines, lines[0]), F.lit(0.0))))
    edges = stand_walks(stood)
    for more in rides:
        edges = edges.unionByName(timed(more if "km" in more.columns else more.withColumn("km", F.lit(None).cast("double")), stood))
    walks = origin_seeds(stood.filter(F.col("kind").isin("bus", "boat")).withColumn("node", F.col("stand")))
    seeds = entries.join(stood, "node", "left").select(F.coalesce("stand", "node").alias("node"), "km", "minutes").unionByName(walks)
    found = shortest_paths(edges, seeds).withColumnRenamed("node", "stand")
    places = [F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.round("km", 2).alias("km"), F.round("minutes", 1).alias("minutes")]
    return stood.join(found, "stand").select("node", "kind", *places)


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to node, component: the least node that a node is linked with, itself included. Only linked nodes have a row.

    Rounds of stars: a node's larger neighbours move to the least of its neighbours, then it and its smaller ones do.
    The number of rounds grows with the logarithm of the largest component; each is written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, mark = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    while True:
        near = both(edges)
        up = near.filter("b > a").join(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialise(down.filter("a <> b").distinct())
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        mark = tuple(found)


def station_bands(km: DataFrame, of_modes: DataFrame) -> DataFrame:
    """km (node, km), modes (a fixed table) to node, mode, view, value, band within the outermost band; mode `multimodal` has the least of the modes' values."""
    values = F.array(F.struct(F.lit("cost").alias("view"), mode_fare("km").alias("value")), F.struct(F.lit("time").alias("view"), F.round(minutes("km", F.col("speed")), 6).alias("value")))
    rows = km.crossJoin(F.broadcast(of_modes)).select("node", "mode", F.explode(values).alias("x")).select("node", "mode", "x.*")
    best = rows.groupBy("node", "view").agg(F.min("value").alias("value")).withColumn("mode", F.lit("multimodal"))
    within = lambda bands: F.when(F.col("value") <= bands[-1], band("value", bands))
    return rows.unionByName(best).withColumn("band", F.when(F.col("view") == "cost", within(K.COST_BANDS)).otherwise(within(K.TIME_BANDS))).filter("band IS NOT NULL")
