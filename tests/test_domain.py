"""Goldens, invariants and small brute-force checks of the domain operators."""

import heapq
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.functions.fares import half_up, minutes, mode_fare, modes
from wayfare.functions.geo import circuity, haversine_km
from wayfare.functions.text import either, normal, number_in, on_line
from wayfare.operators import graph, lines, raster, resolve, tags
from wayfare.sources import readers, writers

# Hand-computed fares at 1, 2, 2.1, 10, 11, 20, 30 and 120 km, and minutes at 10 km.
GOLDEN = {
    "bts": ([17, 17, 20, 32, 37, 48, 62, 65], 17),
    "mrt_blue": ([17, 17, 19, 28, 31, 38, 45, 45], 17),
    "mrt_purple": ([14, 14, 17, 26, 30, 38, 42, 42], 17),
    "arl": ([15, 15, 15, 25, 25, 35, 45, 45], 15),
    "bus_nonac": ([8, 8, 8, 8, 8, 8, 8, 8], 50),
    "bus_ac": ([13, 13, 13, 17, 17, 21, 26, 26], 50),
    "chao_phraya": ([15, 15, 15, 21, 21, 27, 30, 30], 40),
    "khlong": ([8, 8, 8, 14, 14, 22, 22, 22], 40),
    "taxi": ([35, 35, 36, 87, 93, 142, 197, 577], 55),
    "motorcycle": ([25, 25, 26, 81, 88, 151, 221, 704], 30),
    "tuktuk": ([60, 60, 62, 204, 222, 384, 564, 1806], 40),
    "grab_car": ([45, 45, 46, 117, 126, 207, 297, 918], 55),
    "grab_bike": ([25, 25, 26, 81, 88, 151, 221, 704], 30),
}


def test_fares(spark):
    km = spark.createDataFrame([(float(x),) for x in (1, 2, 2.1, 10, 11, 20, 30, 120)], "km double")
    rows = km.crossJoin(modes(spark)).select("mode", "km", mode_fare("km").alias("fare"), half_up(minutes("km", F.col("speed"))).alias("minutes")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.km):
        got.setdefault(r["mode"], []).append(r.fare)
    assert got == {m: f for m, (f, _) in GOLDEN.items()}
    assert {r["mode"]: r.minutes for r in rows if r.km == 10} == {m: t for m, (_, t) in GOLDEN.items()}


def test_ranking_at_ten_km(spark):
    from wayfare.plans.surfaces import mode_ranking

    rows = mode_ranking(spark, "/root/testdata/sf0.001").filter("km = 10").orderBy("rank").collect()
    assert [r["mode"] for r in rows] == "bus_nonac khlong bus_ac chao_phraya arl mrt_purple mrt_blue bts motorcycle grab_bike taxi grab_car tuktuk".split()


def test_circuity_and_distance(spark):
    lat, lng = K.ORIGIN
    s = 0.1 / 2**0.5
    around = [(lat + 0.1, lng, 1.25), (lat, lng + 0.1, 1.15), (lat - 0.1, lng, 1.10), (lat, lng - 0.1, 1.50), (lat + s, lng + s, 1.35)]
    for r in spark.createDataFrame(around, "lat double, lng double, want double").select("want", circuity("lat", "lng").alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-6)
    both = spark.range(1).select(haversine_km(13.5, 100.4, 13.9, 100.8).alias("a"), haversine_km(13.9, 100.8, 13.5, 100.4).alias("b"), haversine_km(13.5, 100.4, 13.5, 100.4).alias("zero")).first()
    assert both.a == pytest.approx(both.b) and both.zero == 0


def test_texts(spark):
    df = spark.createDataFrame([(" Foo \t bar ", "", "BL07x12", "A1; N9 ;x", ["^N\\d+$"]), (None, None, "none", "", ["^N$"])], "a string, b string, c string, ref string, p array<string>")
    out = df.select(normal(F.col("a")).alias("n"), either(F.col("b"), F.lit("y")).alias("e"), number_in(F.col("c")).alias("d"), on_line(F.col("ref"), F.lit("Gold"), F.col("p"), F.array(F.lit("Gold"))).alias("o")).collect()
    assert [tuple(r) for r in out] == [("foo bar", "y", 712, True), ("", "y", 0, True)]


@pytest.mark.parametrize("width", [None, 0.7, 2.5, 1e9])
def test_shortest_paths(spark, width):
    """Dijkstra's km and minutes, whatever the width of the distance buckets."""
    random.seed(4)
    edges = [(a, b, round(random.uniform(0.1, 3), 3), round(random.uniform(1, 9), 3)) for a, b in {tuple(random.sample(range(40), 2)) for _ in range(90)}]
    seeds = [(0, 0.5, 2.0), (7, 0.0, 0.0)]
    near = {}
    for a, b, k, m in edges:
        near.setdefault(a, []).append((b, k, m))
    best, heap = {}, [(k, m, n) for n, k, m in seeds]
    heapq.heapify(heap)
    while heap:
        k, m, n = heapq.heappop(heap)
        if n not in best:
            best[n] = (k, m)
            for b, x, y in near.get(n, []):
                heapq.heappush(heap, (k + x, m + y, b))
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, km double, minutes double"), spark.createDataFrame(seeds, "node long, km double, minutes double"), width)
    assert {r.node: (round(r.km, 6), round(r.minutes, 6)) for r in got.collect()} == {n: (round(k, 6), round(m, 6)) for n, (k, m) in best.items()}


def test_rail_edges_and_positions(spark):
    st = spark.createDataFrame([("a", 13.5, 100.5), ("b", 13.6, 100.5)], "node string, lat double, lng double")
    e = graph.rail_edges(spark.createDataFrame([("a", "b", "link"), ("b", "a", "connection"), ("a", "x", "link")], "src string, dst string, type string"), st)
    km = {(r.src, r.dst): r.km for r in e.collect()}
    assert km["b", "a"] == pytest.approx(km["a", "b"] + 0.3) and len(km) == 2
    route = spark.createDataFrame([(1, i, 13.5 + i * 0.01, 100.5) for i in range(4)], "route int, i int, lat double, lng double")
    pos = [r.pos for r in graph.positions(route, "route", "i").orderBy("i").collect()]
    assert pos[0] == pos[1] == 0 and pos[2] == pytest.approx(1.11, abs=0.01) and pos[3] == pytest.approx(2.22, abs=0.01)


def test_boats(spark):
    piers = spark.createDataFrame([(1, 13.5, 100.5), (2, 13.52, 100.5), (3, 13.9, 100.9)], "pier int, lat double, lng double")
    routes = spark.createDataFrame([("r", i, 13.5 + i * 0.01, 100.5) for i in range(4)], "route string, i int, lat double, lng double")
    nodes = graph.boat_nodes(piers, routes)
    assert {(r.pier, round(r.pos, 2)) for r in nodes.collect()} == {(1, 0.0), (2, 1.11)}
    assert [(r.src, r.dst) for r in graph.boat_edges(nodes).collect()] == [("boat_r_1", "boat_r_2")]


def test_masks_are_nested_and_sides_close(spark):
    cells = spark.createDataFrame([(r, c, float(r + c)) for r in range(4) for c in range(4)], "r int, c int, v double")
    mask = raster.masks(cells, "v", [1, 3, 9])
    sizes = {r.band: r["count"] for r in mask.groupBy("band").count().collect()}
    assert sizes == {0: 3, 1: 10, 2: 16}
    corners = {}
    for r in raster.outline(mask).collect():
        for p in ((r.r1, r.c1), (r.r2, r.c2)):
            corners[r.band, p] = corners.get((r.band, p), 0) + 1
    assert all(n % 2 == 0 for n in corners.values())
    ring = raster.rings(raster.outline(mask)).filter("band = 2").collect()
    assert len(ring) == 16


def test_density_without_stands(spark):
    none = spark.createDataFrame([], "stand_lat double, stand_lng double, drivers int")
    assert raster.density(raster.grid(spark), none).filter("density <> 0 OR drivers <> 0").count() == 0


def test_between_anchors(spark):
    rows = [("l", 0, False, True, 0.0, 0.0), ("l", 1, True, False, 1.0, 1.0), ("l", 2, False, True, 9.0, 9.0), ("l", 3, False, False, 9.0, 9.0), ("l", 4, False, True, 9.0, 9.0), ("l", 5, True, False, 4.0, 1.0), ("l", 6, False, True, 7.0, 7.0), ("m", 0, False, True, 5.0, 6.0)]
    got = lines.between_anchors(spark.createDataFrame(rows, "line string, i int, anchor boolean, fixable boolean, lat double, lng double"))
    at = {(r.line, r.i): (r.est_lat, r.est_lng) for r in got.collect()}
    assert at["l", 2] == pytest.approx((2, 1)) and at["l", 4] == pytest.approx((3, 1))
    assert at["l", 0] == pytest.approx((1 + (1 - 9), 1 + (1 - 9))) and at["l", 6] == pytest.approx((4 + (4 - 9), 1 + (1 - 9))) and at["m", 0] == (5, 6)


def test_snap_and_walk(spark):
    route = spark.createDataFrame([("l", 0, 13.5, 100.5), ("l", 1, 13.6, 100.5)], "line string, i int, lat double, lng double")
    p = spark.createDataFrame([(1, "l", 13.55, 100.51), (2, "l", 14.5, 100.5)], "point int, line string, lat double, lng double")
    got = {r.point: (round(r.snap_lat, 6), round(r.snap_lng, 6), r.snap_km is None) for r in lines.snap(p, route).collect()}
    assert got == {1: (13.55, 100.5, False), 2: (14.5, 100.5, True)}
    links = spark.createDataFrame([("l", "a", "c", "link"), ("l", "a", "b", "connection"), ("l", "c", "b", "link")], "line string, src string, dst string, type string")
    walk = lines.walk_lines(links, spark.createDataFrame([("l", "a")], "line string, start string")).orderBy("i").collect()
    assert [r.node for r in walk] == ["a", "c", "b"]


def test_matching_and_corrections(spark):
    own = spark.createDataFrame([("l", "s1", 1, "Alpha", "", 13.5, 100.5), ("l", "s2", 2, "Beta", "", 13.6, 100.5), ("l", "s3", 3, "Far", "", 13.9, 100.9)], "line string, sid string, ord long, name string, name_th string, lat double, lng double")
    other = spark.createDataFrame([("l", 10, " alpha ", "", 13.501, 100.5), ("l", 11, "", "", 13.601, 100.501)], "line string, ord long, name_en string, name_th string, lat double, lng double")
    m = resolve.match_stations(own, other)
    assert {(r.sid, r.other_ord, r.method, r.status) for r in m.collect()} == {("s1", 10, "name", "high"), ("s2", 11, "assignment", "high")}
    assert {r.sid for r in resolve.with_phantoms(own, m).filter("status = 'phantom'").collect()} == {"s3"}
    found = m.select("sid", "status", F.lit(13.7).alias("osm_lat"), F.lit(100.7).alias("osm_lng"), F.lit("New").alias("osm_name_en"), F.lit("").alias("osm_name_th"))
    got = {r.sid: (r.new_lat, r.new_name, r.moved, r.renamed) for r in resolve.apply_corrections(own, found).collect()}
    assert got["s1"] == (13.7, "New", True, True) and got["s3"] == (13.9, "Far", False, False)


def test_tags(spark):
    els = spark.createDataFrame([("relation", 1, [("way", 2), ("way", 2)]), ("way", 2, [("node", 3)]), ("node", 3, None), ("node", 4, None)], "type string, id long, members array<struct<type string, ref long>>")
    got = tags.recurse_down(els, els.filter("id = 1"))
    assert {(r.type, r.id) for r in got.collect()} == {("relation", 1), ("way", 2), ("node", 3)}
    links = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (9, 8)], "child long, parent long")
    assert {(r.node, r.depth) for r in tags.below(links, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_sources(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    m = readers.read_modes(spark, put("modes.json", {"modes": [{"id": "x", "name": "X", "type": "road", "baseFare": 5, "fareFormula": "per-km", "perKmRate": [{"maxKm": 2, "rate": 0}, {"maxKm": 99, "rate": 7}], "avgSpeedKmh": 20}]}))
    assert m.select(mode_fare(F.lit(3.5)).alias("f")).first().f == 16
    st = put("stations.json", {"lines": {"l": {"name": "L", "color": "#1"}}, "stations": {"s1": {"name": "A", "nameTh": "", "lat": 13.5, "lng": 100.5, "line": "l"}}})
    assert readers.read_stations(spark, st).first().node == "s1" and readers.read_lines(spark, st).first().line == "l"
    writers.write_stations(readers.read_stations(spark, st), readers.read_lines(spark, st), str(tmp_path / "out"))
    assert readers.read_stations(spark, str(tmp_path / "out")).collect() == readers.read_stations(spark, st).collect()
    assert [tuple(r) for r in readers.read_edges(spark, put("e.json", [{"from": "a", "to": "b", "type": "link"}])).collect()] == [("a", "b", "link")]
    assert [tuple(r) for r in readers.read_edges_csv(spark, put("e.csv", "from,to,weight,type\na,b,2,link\n")).collect()] == [("a", "b", 2, "link")]
    geo = {"features": [{"geometry": {"type": "Point", "coordinates": [100.5, 13.5]}, "properties": {"type": "pier"}}, {"geometry": {"type": "LineString", "coordinates": [[100.5, 13.5], [100.6, 13.6]]}, "properties": {"routeId": "r"}}]}
    feats = readers.read_features(spark, put("g.json", geo)).orderBy("ord").collect()
    assert feats[0].points[0].lat == 13.5 and [p.lng for p in feats[1].points] == [100.5, 100.6]
    assert readers.read_optional(spark, str(tmp_path / "missing.json")) is None
    put("stops.txt", 'stop_id,stop_lat,stop_lon,x\n"a",13.5,100.5,1\n"a",13.6,100.6,2\n')
    stops = readers.read_gtfs(spark, str(tmp_path), "stops").withColumn("ord", F.monotonically_increasing_id())
    assert readers.last_stops(stops, "ord").first().stop_lat == 13.6
    put("frequencies.txt", "trip_id,start_time,end_time,headway_secs\nt,04:00:00,24:00:00,1200\n")
    assert tuple(readers.read_gtfs(spark, str(tmp_path), "frequencies").first()) == ("t", 14400, 86400, 1200)
    assert [tuple(r) for r in readers.read_stands(spark, put("w.csv", "xcoord,ycoord,num_driver\n100.5,13.5,12\n1,x,3\n1,2,12.0\n,,\n")).collect()] == [(13.5, 100.5, 12)]
    assert readers.read_stands(spark, put("w2.csv", "xcoord,ycoord\n1,2\n")).count() == 0
    raw = {"elements": [{"type": "node", "id": 1, "lat": 13.5, "lon": 100.5, "tags": {"name:en": "A", "railway": "station"}}, {"type": "node", "id": 2, "lat": 13.50001, "lon": 100.50001, "tags": {"name:en": "A", "railway": "stop"}}, {"type": "way", "id": 3}]}
    rows = readers.read_overpass(spark, put("o.json", raw))
    assert [r.osm_id for r in resolve.transit_stations(rows).collect()] == [1] and rows.filter("name = ''").count() == 2
    bind = {"results": {"bindings": [{"station": {"value": "http://x/Q1"}, "stationLabel": {"value": "N"}, "coord": {"value": "Point(100.5 13.5)"}, "stationCode": {"value": "B"}}, {"station": {"value": "http://x/Q1"}, "stationLabel": {"value": "M"}, "coord": {"value": "Point(100.5 13.5)"}, "stationCode": {"value": "A"}}, {"station": {"value": "http://x/Q2"}, "coord": {"value": "bad"}}]}}
    merged = resolve.merge_entities(readers.read_sparql(spark, put("w.json", bind))).collect()
    assert [(r.qid, r.name, r.codes) for r in merged] == [("Q1", "N", ["A", "B"])]
    writers.write_list(rows, str(tmp_path / "list"))
    assert json.loads(spark.read.text(str(tmp_path / "list")).first().value)["count"] == 2
    match = spark.createDataFrame([("s1", "high", "name", 12)], "sid string, status string, method string, delta_m long")
    writers.write_matches(match, str(tmp_path / "m"))
    assert readers.read_matches(spark, str(tmp_path / "m")).first().sid == "s1"
    reached = spark.createDataFrame([("bus", "n", 13.5, 100.5, 1.25, 3.0)], "mode string, node string, lat double, lng double, km double, time_min double")
    writers.write_reach(reached, spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0)], "r int, c int, density double"), str(tmp_path / "r"))
    doc = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert doc["bus_stops"] == [[13.5, 100.5, 1.25, 3.0]] and doc["moto_density"] == [[0.5, 0.0]]


def test_snap_meets_across_cells(spark):
    """Long and short segments meet points in any cell of their widened boxes, as brute force over all segments finds."""
    import random

    from wayfare.operators import lines

    random.seed(3)
    spot = lambda: (13.5 + random.random() / 2, 100.3 + random.random() / 2)
    routes = [("a", i, *spot()) for i in range(25)] + [("b", i, 13.7 + i / 1000, 100.5) for i in range(20)]
    points = [(k, random.choice("abc"), *spot()) for k in range(80)]
    got = lines.snap(spark.createDataFrame(points, "point int, line string, lat double, lng double"), spark.createDataFrame(routes, "line string, i int, lat double, lng double")).collect()
    for r in got:
        own = sorted((i, la, ln) for line, i, la, ln in routes if line == r.line)
        inside = [1 for (_, a, b), (_, c, d) in zip(own, own[1:]) if min(a, c) - lines.BOX <= r.lat <= max(a, c) + lines.BOX and min(b, d) - lines.BOX <= r.lng <= max(b, d) + lines.BOX]
        assert (r.snap_km is None) or inside
        if not inside:
            assert (r.snap_lat, r.snap_lng) == (r.lat, r.lng)
            continue
        found = []
        for (_, a, b), (_, c, d) in zip(own, own[1:]):
            if min(a, c) - lines.BOX <= r.lat <= max(a, c) + lines.BOX and min(b, d) - lines.BOX <= r.lng <= max(b, d) + lines.BOX:
                square = (c - a) ** 2 + (d - b) ** 2
                t = min(1.0, max(0.0, ((r.lat - a) * (c - a) + (r.lng - b) * (d - b)) / square)) if square else 0.0
                found.append(_metres((r.lat, r.lng), (a + t * (c - a), b + t * (d - b))) / 1000)
        assert (r.snap_km == pytest.approx(min(found), abs=1e-6)) if min(found) <= lines.SNAP_KM else r.snap_km is None
    assert sum(r.snap_km is not None for r in got) > 20


def _metres(a, b):
    la, ln, lb, lm = (np.radians(x) for x in (*a, *b))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lm - ln) / 2) ** 2
    return 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def _match_line(own, other):
    """Stations one after the other, then every way to pair the rest of a small line."""
    taken, found = set(), {}
    for sid, name, th, *at in own:
        able = [(_metres(at, o[3:]), o[0]) for o in other if o[0] not in taken and ((name and name == o[1]) or (th and th == o[2]))]
        if able and min(able)[0] <= 4000:
            found[sid] = min(able)[1]
            taken.add(min(able)[1])
    a, b = [s for s in own if s[0] not in found], [o for o in other if o[0] not in taken]
    cost = lambda s, o: d if (d := _metres(s[3:], o[3:])) <= 2000 else 1e9
    small, big, turned = (a, b, False) if len(a) <= len(b) else (b, a, True)
    table = [[cost(x, y) if not turned else cost(y, x) for y in big] for x in small]
    best = min(itertools.permutations(range(len(big)), len(small)), key=lambda p: sum(table[i][j] for i, j in enumerate(p)))
    for i, j in enumerate(best):
        if table[i][j] < 1e9:
            s, o = (big[j], small[i]) if turned else (small[i], big[j])
            found[s[0]] = o[0]
    return found


def test_matching_equals_taking_turns(spark):
    random.seed(8)
    own, other, want = [], [], set()
    for k in range(12):
        spot = lambda: (13.5 + random.random() / 25, 100.5 + random.random() / 25)
        a = [(f"s{i}", random.choice(["", "x", "y", "z"]), random.choice(["", "", "t"]), *spot()) for i in range(random.randint(0, 9))]
        b = [(i, random.choice(["", "x", "y", "w"]), random.choice(["", "t"]), *spot()) for i in range(random.randint(0, 7))]
        own += [(f"l{k}", s[0], i, f" {s[1].upper()} ", *s[2:]) for i, s in enumerate(a)]
        other += [(f"l{k}", *o) for o in b]
        want |= {(f"l{k}", s, o) for s, o in _match_line(a, b).items()}
    x = spark.createDataFrame([*own, (None, "n", 1, "x", "", 13.5, 100.5)], "line string, sid string, ord long, name string, name_th string, lat double, lng double")
    y = spark.createDataFrame([*other, (None, 1, "x", "", 13.5, 100.5)], "line string, ord long, name_en string, name_th string, lat double, lng double")
    got = {(r.line, r.sid, r.other_ord) for r in resolve.match_stations(x, y).collect()}
    assert got == want and len(want) > 20


def test_displaced_stations_ask_again(spark):
    """A station that waits for an earlier one's refusal still goes before a later one that asked first."""
    at = lambda k: 13.5 + k / 1000
    own = [("l", "a", 1, "x", "", at(0), 100.5), ("l", "b", 2, "x", "", at(0.1), 100.5), ("l", "c", 3, "x", "", at(9), 100.5)]
    other = [("l", 1, "x", "", at(0), 100.5), ("l", 2, "x", "", at(8), 100.5), ("l", 3, "x", "", at(12), 100.5)]
    got = resolve.match_names(spark.createDataFrame(own, "line string, sid string, ord long, name string, name_th string, lat double, lng double"), spark.createDataFrame(other, "line string, ord long, name_en string, name_th string, lat double, lng double"))
    assert {(r.sid, r.o_ord) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_least_pairs():
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        pairs = sorted({(rng.randrange(n), rng.randrange(m)) for _ in range(rng.randint(1, 14))})
        cost = [round(rng.uniform(0, 10), 2) for _ in pairs]
        best = (0, 0.0)
        for k in range(1, min(n, m) + 1):
            for some in itertools.combinations(range(len(pairs)), k):
                if len({pairs[p][0] for p in some}) == k == len({pairs[p][1] for p in some}):
                    best = min(best, (-k, sum(cost[p] for p in some)))
        got = resolve.least_pairs([p[0] for p in pairs], [p[1] for p in pairs], cost)
        assert (-len(got), pytest.approx(sum(cost[p] for p in got))) == best


def test_components_of_links(spark):
    links = [(str(i), str(i + 1)) for i in range(100, 140)] + [("z", "a"), ("b", "a"), ("q", "q"), ("a", "b")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{str(i): "100" for i in range(100, 141)}, "z": "a", "a": "a", "b": "a"}


def test_a_round_shuffles_steps_only(spark):
    """Edges and known nodes are read by bucket: the one exchange of a round is that of its steps."""
    from wayfare.session import bucketed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        costs = spark.table(bucketed(spark.range(200).selectExpr("id AS src", "id * 7 % 200 AS dst", "1.0D AS km", "2.0D AS minutes"), "src"))
        known = bucketed(spark.range(9).selectExpr("id AS node", "0.0D AS km", "0.0D AS minutes", "0 AS round"), "node", parts=("round",))
        plan = graph.relax(costs, spark.table(known).filter("round = 0"), spark.table(known))._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "Exchange" in x]
        assert len(exchanges) == 1 and "hashpartitioning(dst" in exchanges[0] or "hashpartitioning(node" in exchanges[0]
        assert len(exchanges) == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _greedy(start, links):
    near = {}
    for a, b, t in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, []).append((t != "link", b))
            near.setdefault(b, []).append((t != "link", a))
    at, seen = start, []
    while at is not None:
        seen.append(at)
        at = min(((t, n) for t, n in near.get(at, []) if n not in seen), default=(None, None))[1]
    return seen


def test_walks_equal_step_by_step(spark):
    """Contracted stretches, branches, loops back to the start, parallel ways, dead ends and links that are none."""
    random.seed(6)
    lines_, starts = {}, {}
    for k in range(14):
        n = random.randint(1, 40)
        chain = [(f"{i:03d}", f"{i + 1:03d}", random.choice(["link", "link", "connection", None])) for i in range(n)]
        more = [(f"{random.randrange(n + 1):03d}", f"{random.randrange(n + 1):03d}", random.choice(["link", "connection"])) for _ in range(random.randint(0, 4))]
        lines_[f"l{k}"], starts[f"l{k}"] = [(b, a, t) if random.random() < 0.3 else (a, b, t) for a, b, t in chain + more], f"{random.randrange(n + 1):03d}"
    lines_["circle"], starts["circle"] = [(f"{i}", f"{(i + 1) % 9}", "link") for i in range(9)], "4"
    lines_["apart"], starts["apart"] = [("a", "b", "link"), ("x", "y", "link"), ("y", "z", "link"), ("z", "x", "link"), (None, "q", "link"), ("b", "b", "link")], "a"
    lines_["alone"], starts["alone"] = [], "s"
    links = spark.createDataFrame([(line, *x) for line, every in lines_.items() for x in every], "line string, src string, dst string, type string")
    got = {}
    for r in lines.walk_lines(links, spark.createDataFrame(list(starts.items()), "line string, start string")).orderBy("line", "i").collect():
        got.setdefault(r.line, []).append((r.i, r.node))
    assert got == {line: list(enumerate(_greedy(starts[line], every))) for line, every in lines_.items()}


def test_rings_of_masks(spark):
    """A block with a hole, another component, cells that touch by a corner, and a single cell."""
    block = [(0, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(0, 9, 9)]
    steps = [(1, 0, 0), (1, 1, 1), (1, 1, 2)]
    mask = spark.createDataFrame([*block, *steps, (2, 7, 7)], "band int, r int, c int")
    got = {}
    for r in raster.rings(raster.outline(mask)).orderBy("band", "i").collect():
        got.setdefault(r.band, []).append((round((r.lat - K.LAT_LOW) / (K.LAT_HIGH - K.LAT_LOW) * K.GRID), round((r.lng - K.LNG_LOW) / (K.LNG_HIGH - K.LNG_LOW) * K.GRID)))
    around = [(0, c) for c in range(5)] + [(r, 5) for r in range(5)] + [(5, 5 - c) for c in range(5)] + [(5 - r, 0) for r in range(5)]
    assert got[0] == around and got[1] == [(0, 0), (0, 1), (1, 1), (1, 0)] and sorted(got[2]) == [(7, 7), (7, 8), (8, 7), (8, 8)]


def test_table_functions(spark):
    """Arguments by name, defaults, columns as arguments, and the filter in the scan."""
    from wayfare.functions.tables import register

    register({"modes": modes(spark)})
    ten = {r["mode"]: r.fare for r in spark.sql("SELECT mode, fare FROM mode_cards()").collect()}
    assert ten == {m: f[3] for m, (f, _) in GOLDEN.items()}
    rail = spark.sql("SELECT mode, fare, minutes FROM mode_cards(mode_type => 'rail', distance_km => 11)").collect()
    assert {(r["mode"], r.fare) for r in rail} == {(m, GOLDEN[m][0][4]) for m in ("bts", "mrt_blue", "mrt_purple", "arl")}
    spark.createDataFrame([(1, 1.0), (2, 120.0)], "id int, km double").createOrReplaceTempView("wayfare_trips")
    taxi = spark.sql("SELECT id, fare FROM wayfare_trips t, LATERAL mode_cards(distance_km => t.km) WHERE mode = 'taxi' ORDER BY id").collect()
    assert [r.fare for r in taxi] == [35, 577]
    assert [tuple(r) for r in spark.sql("SELECT * FROM legend(view => 'time') WHERE band = 8").collect()] == [(8, K.COLORS[8], "120 min")]

