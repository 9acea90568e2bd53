"""What reviewers found on odd inputs and larger tables."""

import duckdb
from pyspark.sql import functions as F

from wayfare.operators import lines, ways


def test_km_text_rounds_what_is_stored(spark):
    from wayfare.functions.text import km_text

    values = [0.0, 0.04, 0.05, 0.25, 0.35, 0.75, 0.95, 9.95, 37.65, 37.65 + 1e-6, 12.25, 99.949999, 1234567.85]
    got = spark.createDataFrame([(v,) for v in values], "km double").select(km_text(F.col("km"))).collect()
    assert [r[0] for r in got] == [f"{v:.1f} km" for v in values]


def test_rounded_places_are_those_of_sql(spark):
    from wayfare.functions.geo import rounded
    from wayfare.plans.dialect import LAT, LNG, place

    keys = spark.range(0, 78000, 500)  # all ties of the stand-in places are among them
    got = keys.select("id", *place(F.col("id"))).select("id", rounded("lat", 1), rounded("lng", 1)).collect()
    want = duckdb.connect().sql(f"SELECT id, round({LAT.format('id')}, 1), round({LNG.format('id')}, 1) FROM range(0, 78000, 500) t(id)").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_route_lines_leave_circles_out_if_asked(spark):
    shapes = {1: [1, 2], 2: [2, 3], 3: [3, 1], 4: [10, 11], 5: [11, 12]}
    pieces = spark.createDataFrame([("a", w, i, n) for w, nodes in shapes.items() for i, n in enumerate(nodes)], "line string, way long, i int, node long")
    strings = lambda **of: sorted(r.n for r in ways.stitch(pieces, **of).groupBy("string").agg(F.count("*").alias("n")).collect())
    assert strings() == [3, 4]
    assert strings(circles=False) == [3]


def test_snap_finds_what_all_segments_say(spark):
    import random

    r = random.Random(5)
    at = lambda: (round(13 + r.random(), 4), round(100 + r.random(), 4))
    routes = [(f"l{j}", i, *at()) for j, n in enumerate((2, 3, 12, 60)) for i in range(n)] + [("up", 0, 13.1, 100.5), ("up", 1, 13.9, 100.5), ("along", 0, 13.5, 100.1), ("along", 1, 13.5, 100.9)]
    spots = [(k, r.choice(["l0", "l1", "l2", "l3", "up", "along", "none"]), *at()) for k in range(400)]
    found = lines.snap(spark.createDataFrame(spots, "point long, line string, lat double, lng double"), spark.createDataFrame(routes, "line string, i int, lat double, lng double"))
    con = duckdb.connect()
    con.execute("CREATE TABLE p(point BIGINT, line VARCHAR, lat DOUBLE, lng DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", spots)
    con.execute("CREATE TABLE r(line VARCHAR, i INT, lat DOUBLE, lng DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", routes)
    from wayfare.plans.dialect import sql_km
    from wayfare.plans.networks import _T

    want = con.sql(f"""WITH s AS (SELECT * FROM (SELECT line, i, lat AS lat1, lng AS lng1, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM r WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE lat2 IS NOT NULL),
        n AS (SELECT point, p.lat, p.lng, lat1 + {_T} * (lat2 - lat1) AS s_lat, lng1 + {_T} * (lng2 - lng1) AS s_lng FROM p JOIN s ON p.line = s.line AND p.lat BETWEEN least(lat1, lat2) - 0.05e0 AND greatest(lat1, lat2) + 0.05e0
            AND p.lng BETWEEN least(lng1, lng2) - 0.05e0 AND greatest(lng1, lng2) + 0.05e0)
        SELECT point, min(round({sql_km('lat', 'lng', 's_lat', 's_lng')}, 6)) AS km FROM n GROUP BY point HAVING km <= 10""").fetchall()
    got = {x.point: round(x.snap_km, 6) for x in found.collect() if x.snap_km is not None}
    assert got == dict(want) and 50 < len(got) < 400


def test_segments_go_to_cells_along_them_only(spark):
    ends = spark.createDataFrame([("a", 0, 13.0, 100.0, 14.0, 101.0)], "line string, i int, lat1 double, lng1 double, lat2 double, lng2 double")
    spots = spark.range(10000).selectExpr("id AS point", "'a' AS line", "13.005 + (id DIV 100) / 100 AS lat", "100.005 + (id % 100) / 100 AS lng")
    assert 100 <= lines._near(spots, ends, 0.5, 0.01).count() <= 500  # the box has 10,000 cells


def test_nearest_within_settles_places_in_growing_circles(spark):
    from wayfare.operators.spatial import nearest_within, radius_join

    key = lambda of: (f"13.5 + (id * 7919 % 500) / 5000 AS {of}lat", f"100.5 + (id * 104729 % 700) / 7000 AS {of}lng")
    a, b = spark.range(150).selectExpr("id AS a", *key("a_")), spark.range(1000, 1080).selectExpr("id AS b", *key(""))
    at = ("a_lat", "a_lng"), ("lat", "lng")
    want = radius_join(a, b, 2.0, *at).groupBy("a").agg(F.min("km").alias("km")).collect()
    got = nearest_within(a, b, 2.0, *at).select("a", "km").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_transfers_of_crowded_places(spark):
    from wayfare.operators.graph import PLACE_NODES, transfers

    n = PLACE_NODES + 40  # more than one list at a place
    rows = [(f"bus_{i}", "bus", 13.5, 100.5) for i in range(n)] + [(f"boat_{i}", "boat", 13.501, 100.5) for i in range(3)] + [("rail_0", "rail", 13.5, 100.5), ("rail_1", "rail", 13.6, 100.5)]
    got = transfers(spark.createDataFrame(rows, "node string, kind string, lat double, lng double")).select("src", "dst").collect()
    kind = {r[0]: r[1:] for r in rows if r[0] != "rail_1"}
    want = {(a, b) for a in kind for b in kind if a < b and (kind[a][0] != kind[b][0] or kind[a][0] == "bus")}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tasks_grow_with_rows(spark, monkeypatch):
    from wayfare import session
    from wayfare.operators.graph import trip_edges

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    visits = spark.range(2050).selectExpr("id DIV 5 AS trip", "id % 90 AS stop", "id AS i")
    assert session.task_count(visits) == 21
    assert trip_edges(visits, ["i"]).rdd.getNumPartitions() == 21  # sizes in bytes would put them into one


def test_last_stops_are_dealt_by_rows(spark):
    from wayfare.plans import files

    plan = files.Q["last_stop_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # nothing is dealt again by size


def test_stations_in_turn_look_farther_only_when_refused(spark, monkeypatch):
    from wayfare.operators import resolve

    monkeypatch.setattr(resolve, "RINGS", (250.0, 500.0, 1000.0, 2000.0, 4000.0))
    own = [("a", f"s{i}", i, "x" if i % 2 else "", "y" if i % 3 else "", 13.7 + i % 5 / 1000, 100.5 + i % 3 / 1000) for i in range(30)]
    other = [("a", j, "x" if j % 3 else "", "y" if j % 2 else "", 13.7 + j * 0.0009, 100.5) for j in range(40)]
    found = resolve.match_names(spark.createDataFrame(own, "line string, sid string, ord long, name string, name_th string, lat double, lng double"), spark.createDataFrame(other, "line string, ord long, name_en string, name_th string, lat double, lng double"))
    from math import asin, cos, radians, sin, sqrt

    def metres(a, b):
        h = sin(radians(b[4] - a[5]) / 2) ** 2 + cos(radians(a[5])) * cos(radians(b[4])) * sin(radians(b[5] - a[6]) / 2) ** 2
        return round(12742000 * asin(sqrt(h)), 4)

    taken, want = set(), {}
    for a in own:
        able = [(metres(a, b), b[1]) for b in other if b[1] not in taken and ((a[3] and a[3] == b[2]) or (a[4] and a[4] == b[3]))]
        able = [x for x in able if x[0] <= 4000]
        if able:
            want[a[1]] = min(able)[1]
            taken.add(want[a[1]])
    assert {r.sid: r.o_ord for r in found.collect()} == want and max(r.metres for r in found.collect()) > resolve.RINGS[1]


def test_long_ways_take_few_rounds(spark, monkeypatch):
    from wayfare.operators import graph

    rounds, hop = [], graph.hop
    monkeypatch.setattr(graph, "hop", lambda *a, **k: rounds.append(1) or hop(*a, **k))
    # node 100 is reached by one long edge, and by twenty short ones that are better; thirty more lie behind it
    edges = [(i, i + 1, 1.0, 2.0) for i in range(19)] + [(19, 100, 1.0, 2.0), (0, 100, 99.0, 1.0)] + [(i, i + 1, 1.0, 3.0) for i in range(100, 130)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, km double, minutes double"), spark.createDataFrame([(0, 0.0, 0.0)], "node long, km double, minutes double"))
    want = {i: (float(i), 2.0 * i) for i in range(20)} | {100 + i: (20.0 + i, 40.0 + 3.0 * i) for i in range(31)}
    assert {r.node: (r.km, r.minutes) for r in got.collect()} == want
    assert len(rounds) < 50  # the longest way has 50 edges


def test_reach_of_places_is_that_of_their_nodes(spark):
    import heapq
    import random

    from wayfare.operators import graph

    r = random.Random(3)
    kinds = [["bus"], ["rail"], ["boat"], ["rail", "boat"], ["bus", "rail", "boat"]]
    nodes = [(f"n{p}_{i}", r.choice(kinds[p % 5]), 13.9133 + 0.002 * (p % 6), 100.5957 + 0.002 * (p // 6)) for p in range(30) for i in range(3)]
    rides = [(*r.sample([n[0] for n in nodes], 2), round(r.uniform(1, 3), 6)) for _ in range(25)]
    df = spark.createDataFrame(nodes, "node string, kind string, lat double, lng double")
    kind, near = {n[0]: n[1] for n in nodes}, {}
    walks = [tuple(x) for x in graph.transfers(df).select("src", "dst", F.round("km", 6)).collect()]
    for a, b, k in walks + rides:
        for x, y in ((a, b), (b, a)):
            speed = 5.0 if kind[x] != kind[y] else {"rail": 35.0, "bus": 12.0, "boat": 15.0}[kind[y]]
            near.setdefault(x, []).append((y, round(k * 1e12), round(round(k / speed * 60, 6) * 1e12)))
    seeds = [(round(x.km * 1e12), round(x.minutes * 1e12), x.node) for x in graph.origin_seeds(df.filter("kind <> 'rail'")).collect()] + [(0, 0, "n1_0")]
    heapq.heapify(seeds)
    best = {}
    while seeds:
        k, m, n = heapq.heappop(seeds)
        if n not in best:
            best[n] = (k, m)
            for b, x, y in near.get(n, []):
                heapq.heappush(seeds, (k + x, m + y, b))
    entries = spark.createDataFrame([("n1_0", 0.0, 0.0)], "node string, km double, minutes double")
    got = graph.multimodal_reach(df, [spark.createDataFrame(rides, "src string, dst string, km double")], entries)
    assert {x.node: (x.km, x.minutes) for x in got.collect()} == {n: (half_up(k, 2), half_up(m, 1)) for n, (k, m) in best.items()}


def half_up(parts, digits):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(parts / 1e12)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


STATION, ENTRY = "line string, sid string, ord long, name string, name_th string, lat double, lng double", "line string, ord long, name_en string, name_th string, lat double, lng double"


def _crowd(n, m, seed):
    """n stations and m gazetteer entries of two lines on a grid, so that many distances are equal."""
    import random

    r = random.Random(seed)
    spot = lambda: (13.7 + r.randrange(40) / 1000, 100.5 + r.randrange(40) / 1000)
    own = [(f"l{i % 2}", f"s{i}", r.randrange(n), r.choice(["", "x", "y"]), r.choice(["", "t"]), *spot()) for i in range(n)]
    other = [(f"l{j % 2}", j, r.choice(["", "x", "z"]), r.choice(["", "", "t"]), *spot()) for j in range(m)]
    return own, other


def test_turns_do_not_depend_on_tiles(spark, monkeypatch):
    """Many tiles, each with a few stations, come to what one station after the other takes."""
    from wayfare.operators import resolve

    monkeypatch.setattr(resolve, "TURN_ROWS", 9)
    own, other = _crowd(90, 70, 4)
    metres = {(r.sid, r.o): r.m for r in spark.createDataFrame(own, STATION).alias("a").crossJoin(spark.createDataFrame(other, ENTRY).selectExpr("line AS l", "ord AS o", "lat AS b_lat", "lng AS b_lng")).filter("line = l").select("sid", "o", F.round(_km() * 1000, 6).alias("m")).collect()}
    taken, want = set(), {}
    for line, sid, _, name, th, *_ in sorted(own, key=lambda x: (x[2], x[1])):
        able = [(metres[sid, o], o) for at, o, en, o_th, *_ in other if at == line and o not in taken and ((name and name == en) or (th and th == o_th)) and metres[sid, o] <= 4000]
        if able:
            want[sid] = min(able)[1]
            taken.add(want[sid])
    found = resolve.match_names(spark.createDataFrame(own, STATION), spark.createDataFrame(other, ENTRY)).collect()
    assert {r.sid: r.o_ord for r in found} == want and len(want) > 30


def _km():
    from wayfare.functions.geo import haversine_km

    return haversine_km("lat", "lng", "b_lat", "b_lng")


def test_stations_without_a_line_end(spark):
    """Rows that can never match do not go on looking."""
    from wayfare.operators import resolve

    own = [(None, "n", 1, "x", "", 13.5, 100.5), ("l", None, None, "x", "", 13.5, 100.5), ("l", "b", 2, "x", "", None, 100.5), ("l", "a", 3, "x", "", 13.5, 100.5), ("l", "c", None, "", "", 13.5, 100.5)]
    other = [(None, 1, "x", "", 13.5, 100.5), ("l", None, "x", "", 13.5, 100.5), ("l", 7, "x", "", 13.5, 100.51), ("l", 8, "x", "", 13.5, 100.502), ("l", 9, "", "", 13.5, 100.503)]
    found = resolve.match_stations(spark.createDataFrame(own, STATION), spark.createDataFrame(other, ENTRY)).collect()
    assert {(r.sid, r.other_ord, r.method) for r in found} == {(None, 8, "name"), ("a", 7, "name"), ("c", 9, "assignment")}


def test_assignment_is_least_in_crowds(spark, monkeypatch):
    """Stations that begin with the nearest come to the least total way over all pairs, also where many are too many."""
    from wayfare.operators import resolve

    metres = F.round(_km() * 1000, 6)
    for n, m, rows in ((60, 90, 1), (90, 60, 200_000)):
        monkeypatch.setattr(resolve, "SOLVE_ROWS", rows)
        own, other = (spark.createDataFrame(x, kind) for x, kind in zip(_crowd(n, m, n), (STATION, ENTRY), strict=True))
        pairs = own.join(other.selectExpr("line", "ord AS o", "lat AS b_lat", "lng AS b_lng"), "line").select("line", "sid", "o", metres.alias("m")).filter("m <= 2000").collect()
        number = lambda of: {x: k for k, x in enumerate(dict.fromkeys(of))}
        left, right = number(p.sid for p in pairs), number(p.o for p in pairs)
        best = resolve.least_pairs([left[p.sid] for p in pairs], [right[p.o] for p in pairs], [round(p.m * 1e6) for p in pairs])
        got = resolve.match_rest(own, other).collect()
        assert len({r.sid for r in got}) == len({r.o_ord for r in got}) == len(got) == len(best) > 40
        assert sum(round(r.metres * 1e6) for r in got) == sum(round(pairs[p].m * 1e6) for p in best)


def test_pairs_far_beyond_the_competition_are_not_made(spark, monkeypatch):
    """600 stations beside 600 entries each at the same place: 360,000 pairs lie within the limit."""
    from wayfare.operators import resolve

    made, solve = [], resolve._solve
    monkeypatch.setattr(resolve, "_solve", lambda pairs: made.append(pairs.count()) or solve(pairs))
    at = "13.7 + id % 25 / 3000 AS lat", "100.5 + id DIV 25 / 3000 AS lng"
    own, other = spark.range(600).selectExpr("'l' AS line", "string(id) AS sid", *at), spark.range(600).selectExpr("'l' AS line", "id AS ord", *at)
    assert resolve.match_rest(own, other).filter("sid = o_ord AND metres = 0").count() == 600
    assert sum(made) == 600


def test_namesakes_far_beyond_the_nearest_are_not_met(spark, monkeypatch):
    """600 namesakes each beside a station: nearly all pairs of them lie within a kilometre."""
    from wayfare.operators import resolve

    made, rivals = [], resolve._rivals
    monkeypatch.setattr(resolve, "_rivals", lambda *a: made.append((found := rivals(*a)).count()) or found)
    monkeypatch.setattr(resolve, "PRUNED", (1, 2), raising=False)
    at = "13.7 + id % 25 / 3000 AS lat", "100.5 + id DIV 25 / 3000 AS lng"
    own = spark.range(600).selectExpr("'l' AS line", "string(id) AS sid", "id AS ord", "'x' AS name", "'' AS name_th", *at)
    other = spark.range(600).selectExpr("'l' AS line", "id AS ord", "'x' AS name_en", "'' AS name_th", *at)
    assert resolve.match_names(own, other).filter("sid = o_ord AND metres = 0").count() == 600
    assert sum(made) == 600
