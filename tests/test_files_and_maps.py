"""Way stitching, file order, the document sink and the download source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wayfare.operators import resolve, ways
from wayfare.sources import download, files, readers, writers

PIECES = "line string, way long, i int, node long"


def strings(spark, pieces):
    """{line: set of node tuples} of stitched pieces {(line, way): nodes}."""
    rows = [(line, way, i, n) for (line, way), nodes in pieces.items() for i, n in enumerate(nodes)]
    out = {}
    for r in ways.stitch(spark.createDataFrame(rows, PIECES)).orderBy("line", "string", "place").collect():
        out.setdefault((r.line, r.string), []).append(r.node)
    found = {}
    for (line, _), nodes in out.items():
        found.setdefault(line, set()).add(tuple(nodes))
    return found


def test_pieces_become_lines(spark):
    chain = {("a", 10): [1, 2, 3], ("a", 11): [5, 4, 3], ("a", 12): [5, 6]}
    assert strings(spark, chain) == {"a": {(1, 2, 3, 4, 5, 6)}}
    branch = {("b", 1): [1, 2], ("b", 2): [2, 3], ("b", 3): [4, 2]}
    assert strings(spark, branch) == {"b": {(1, 2), (2, 3), (2, 4)}}
    circle = {("c", 1): [7, 8, 9], ("c", 2): [9, 3], ("c", 3): [7, 5, 3], ("c", 4): [20, 21, 20], ("c", 5): [30]}
    (round_, closed) = sorted(strings(spark, circle)["c"], key=len, reverse=True)
    assert round_ in ((3, 9, 8, 7, 5, 3), (3, 5, 7, 8, 9, 3)) and closed == (20, 21, 20)
    long = {("d", k): [k, k + 1] if k % 2 else [k + 1, k] for k in range(37)}
    assert strings(spark, long) == {"d": {tuple(range(38))}}
    both = {("e", 1): [1, 2], ("f", 1): [1, 2], ("f", 2): [2, 3]}
    assert strings(spark, both) == {"e": {(1, 2)}, "f": {(1, 2, 3)}}


def test_raw_map_to_lines(spark, tmp_path):
    """A download with a relation of relations; a way of both routes is in both, and elements of two files are merged."""
    node = lambda i: {"type": "node", "id": i, "lat": 13 + i / 100, "lon": 100 + i / 100}
    member = lambda t, i: {"type": t, "ref": i, "role": ""}
    one = [{"type": "relation", "id": 1, "tags": {"route": "train"}, "members": [member("relation", 2), member("way", 11), member("node", 1)]}, {"type": "relation", "id": 2, "members": [member("way", 10)]}, *map(node, range(1, 4))]
    two = [{"type": "way", "id": 10, "nodes": [1, 2]}, {"type": "way", "id": 11, "nodes": [3, 2]}, {"type": "relation", "id": 2, "tags": {"route": "x"}, "members": [member("way", 10)]}, node(2)]
    (tmp_path / "1.json").write_text(json.dumps({"elements": one}))
    (tmp_path / "2.json").write_text(json.dumps({"elements": two}))
    elements = readers.read_map(spark, str(tmp_path))
    assert elements.count() == 7 and elements.filter("tags.route = 'x'").count() == 1
    chosen = elements.filter("type = 'relation'")
    drawn = ways.line_strings(ways.stitch(ways.route_ways(elements, chosen)), elements.filter("type = 'node'").select(F.col("id").alias("node"), "lat", F.col("lon").alias("lng")))
    got = {r.line: [round(p.lat, 2) for p in r.points] for r in drawn.collect()}
    assert got == {"relation/1": [13.01, 13.02, 13.03], "relation/2": [13.01, 13.02]}


def test_last_row_in_file_order(spark, tmp_path):
    """Of an id in several files and blocks the last row wins, whatever the splits, and no column says where it was."""
    folder = tmp_path / "stops.txt"
    folder.mkdir()
    want, text = {}, {}
    for part in range(3):
        rows = []
        for k in range(4000):
            stop, lat = f"s{(k * 7 + part) % 500}", f"{part}.{k:05d}"
            rows.append(f'"{stop}",{lat},100.5')
            want[stop] = float(lat)
        text[part] = "stop_id,stop_lat,stop_lon\n" + "\n".join(rows) + "\n"
        (folder / f"part-{part}.csv").write_text(text[part])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "20k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            stops = readers.read_gtfs(spark, str(tmp_path), "stops", ordered=True)
            assert {r.stop_id: r.stop_lat for r in readers.last_stops(stops).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_document_in_parts(spark, tmp_path):
    """Sections and rows in order over many partitions, odd keys and texts included; nothing else is left in the folder."""
    path = str(tmp_path / "doc.json")
    rows = spark.range(0, 500, 1, 7).select(F.format_string("k%04d\"\\\n", "id").alias("key"), F.concat(F.lit("é\t"), F.col("id").cast("string")).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    files.write_document(files.keyed(rows, "m", "key").unionByName(files.listed(rows, "l", "n")), [("l", "list"), ("none", "list"), ("m", "map"), ("count", "count:m")], path)
    doc = json.loads(open(path).read())
    assert list(doc) == ["l", "none", "m", "count"] and doc["count"] == 500 and doc["none"] == []
    assert list(doc["m"]) == [f'k{i:04d}"\\\n' for i in range(500)] and doc["m"]['k0004"\\\n'] == {"v": "é\t4", "n": 4} and doc["m"]['k0003"\\\n'] == {"v": "é\t3"}
    assert [x["n"] for x in doc["l"] if "n" in x] == list(range(0, 500, 2))
    assert os.listdir(tmp_path) == ["doc.json"]


def test_failed_write_keeps_the_old_document(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    good = spark.createDataFrame([("a", 1)], "node string, lat int")
    writers.write_list(good, path)
    old = open(path).read()
    assert json.loads(old) == {"stations": [{"node": "a", "lat": 1}], "count": 1}
    with pytest.raises(Exception, match="on purpose"):
        writers.write_list(spark.range(50).select(F.when(F.col("id") == 37, F.raise_error(F.lit("on purpose"))).otherwise("x").alias("node")), path)
    assert open(path).read() == old and os.listdir(tmp_path) == ["doc.json"]
    writers.write_list(readers._json(spark, path, "stations array<struct<node string, lat int>>").select(F.explode("stations").alias("s")).select("s.*"), path, order="lat")
    assert json.loads(open(path).read()) == json.loads(old)
    writers.write_list(good.limit(0), path)
    assert json.loads(open(path).read()) == {"stations": [], "count": 0}


def test_reach_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.json")
    reached = spark.createDataFrame([("bus", "b", 13.5, 100.5, 1.25, 3.0), ("bus", "a", 13.6, 100.6, 2.0, 4.5), ("rail", "x", 13.7, 100.7, 0.0, 0.0)], "mode string, node string, lat double, lng double, km double, time_min double")
    writers.write_reach(reached, spark.createDataFrame([(0, 1, 0.0), (0, 0, 0.5), (1, 0, 1.0)], "r int, c int, density double"), path)
    stops, dense = readers.read_reach(spark, path)
    assert {tuple(r) for r in stops.collect()} == {("bus", 0, 13.6, 100.6, 2.0, 4.5), ("bus", 1, 13.5, 100.5, 1.25, 3.0), ("rail", 0, 13.7, 100.7, 0.0, 0.0)}
    assert {tuple(r) for r in dense.collect()} == {(0, 0, 0.5), (0, 1, 0.0), (1, 0, 1.0)}
    assert readers.read_reach(spark, str(tmp_path / "missing.json")) is None


def test_download_falls_over_to_the_next_endpoint(spark, tmp_path):
    """One dead endpoint, one that answers with an error page, one that works; stations of two tiles are merged by id."""
    dead, page, good = (str(tmp_path / n) for n in ("dead", "page", "good"))
    os.makedirs(page), os.makedirs(good)
    box = download.tiles(13.5, 100.3, 14.0, 100.9, 2)
    asked = [f"stations in {b}" for b in box[:2]]
    assert len(box) == 4 and box[0][2] == box[2][0]
    for n, text in enumerate(asked):
        station = lambda i: {"type": "node", "id": i, "lat": 13.5 + i / 100, "lon": 100.5, "tags": {"name": f"S{i}", "railway": "station"}}
        (tmp_path / "page" / download.file_of(text)).write_text("<html>busy</html>")
        (tmp_path / "good" / download.file_of(text)).write_text(json.dumps({"elements": [station(n), station(n + 1)]}))
    got = download.download(spark, [dead, page, good], asked, "folder", pause=0)
    assert [(r.request, r.query, r.endpoint) for r in got.orderBy("request").collect()] == [(0, asked[0], good), (1, asked[1], good)]
    stations = resolve.transit_stations(readers.overpass_rows(got, "body", "request"))
    assert sorted(r.name for r in stations.collect()) == ["S0", "S1", "S2"]
    assert readers.map_elements(got, "body").count() == 3
    with pytest.raises(Exception, match="no endpoint answered request 0"):
        download.download(spark, [dead, page], asked, "folder", pause=0, rounds=2).collect()


def test_download_over_http(spark):
    """Both kinds of requests against a server of our own."""
    import http.server
    import threading
    import urllib.parse

    class Answer(http.server.BaseHTTPRequestHandler):
        def reply(self, said):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.reply({"elements": [{"type": "node", "id": len(form["data"][0]), "lat": 1, "lon": 2}]})

        def do_GET(self):
            asked = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
            self.reply({"results": {"bindings": [{"station": {"value": "http://x/" + asked}, "coord": {"value": "Point(100.5 13.5)"}}]}})

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        here = f"http://127.0.0.1:{server.server_port}"
        got = download.download(spark, ["http://127.0.0.1:1", here], ["one & two", "x"], pause=0)
        assert sorted(r.id for r in readers.map_elements(got, "body").collect()) == [1, 9]
        found = readers.sparql_rows(download.download(spark, [here], ["Q1", "Q2"], "get", pause=0), "body", "request")
        assert sorted((r.qid, r.lat) for r in found.collect()) == [("Q1", 13.5), ("Q2", 13.5)]
    finally:
        server.shutdown()
