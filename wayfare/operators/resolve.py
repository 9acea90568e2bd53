"""Reconciling station gazetteers: filtering, line membership, matching, corrections."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.geo import rounded
from wayfare.functions.text import confidence, either, is_transit, normal, on_line
from wayfare.operators.graph import components
from wayfare.operators.ranking import global_rank
from wayfare.operators.spatial import first_rings, ring_join, zorder
from wayfare.session import broadcast_if_light, materialise

#: Metres up to which names match, and up to which the assignment pairs stations.
NAME_M, ASSIGN_M = 4000.0, 2000.0


def first_by_place(stations: DataFrame) -> DataFrame:
    """The first of the rows (ord) with one name and the same place to three decimals."""
    name = either(F.col("name"), F.col("name_en"))
    w = Window.partitionBy(name, rounded("lat", 3), rounded("lon", 3)).orderBy("ord")
    return stations.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def transit_stations(raw: DataFrame) -> DataFrame:
    """Named transit stations of a raw gazetteer, the first of each name and place."""
    named = (F.coalesce("name", F.lit("")) != "") | (F.coalesce("name_en", F.lit("")) != "")
    return first_by_place(raw.filter(is_transit(F.col("network"), F.col("operator"), F.col("station"), F.col("railway")) & named))


def line_members(stations: DataFrame, rules: DataFrame) -> DataFrame:
    """stations (ref, name_en) with each line whose rule (line, patterns, hints) they fit; rules are a few lines."""
    fits = on_line(F.col("ref"), F.col("name_en"), F.col("patterns"), F.col("hints"))
    return stations.crossJoin(broadcast_if_light(rules)).filter(fits).drop("patterns", "hints")


#: Metres up to which a station looks at first, where enough lies there, and then ring by ring.
RINGS = (31.25, 62.5, 125.0, 250.0, 500.0, 1000.0, ASSIGN_M, NAME_M)
#: Stations of a task that take turns among themselves, and pairs of a task that are assigned, where components allow.
TURN_ROWS, SOLVE_ROWS = 16_000, 200_000
#: Rounds of taking turns before which refused pairs are left out of what is read on.
PRUNED = (3, 9, 27)


def _names(en: str, th: str):
    """A row for each name that is not empty, as the struct `name`."""
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), normal(F.col(c)).alias("v")) for k, c in (("en", en), ("th", th))))
    return F.explode(F.filter(kinds, lambda x: x.v != "")).alias("name")


def _rivals(seekers: DataFrame, other: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Pairs within the ring of each seeker (ring, inner: metres it has looked through before), with their distance as `metres`."""
    rows = ring_join(seekers, other, RINGS, ("lat", "lng"), ("o_lat", "o_lng"), on)
    return rows.withColumn("metres", F.round(F.col("km") * 1000, 6)).filter((F.col("metres") <= F.element_at(F.array(*map(F.lit, RINGS)), F.col("ring") + 1)) & (F.col("metres") > F.col("inner")))


def _take_turns(part: pd.DataFrame) -> pd.DataFrame:
    """Of pairs (turn, o, metres): every turn takes the nearest that no earlier one has taken."""
    part = part.sort_values(["turn", "metres", "o"])
    taken, rows, last = set(), [], None
    for k, (turn, o) in enumerate(zip(part.turn.tolist(), part.o.tolist(), strict=True)):
        if turn != last and o not in taken:
            taken.add(o)
            rows.append(k)
            last = turn
    return part.iloc[rows]


def _in_turn(own: DataFrame) -> DataFrame:
    """own with `turn`, the rank of (ord, sid), one for rows with the same line, sid and ord, and two numbers for about TURN_ROWS stations of a line that lie together: `tile0` and `tile1`."""
    own = materialise(own)
    tiles = max(1, -(-own.count() // TURN_ROWS))
    dealt = own.repartitionByRange(tiles, "line", zorder("lat", "lng"), "sid").withColumn("tile0", F.spark_partition_id())
    dealt = global_rank(dealt, ["ord", "sid", "line"], "turn").repartitionByRange(tiles, "line", "lng", "sid").withColumn("tile1", F.spark_partition_id())
    same = Window.partitionBy("line", "sid", "ord")
    return materialise(dealt.withColumns({c: F.min(c).over(same) for c in ("turn", "tile0", "tile1")}))


def match_names(own: DataFrame, other: DataFrame) -> DataFrame:
    """line, sid, o_ord, metres: every station in turn (ord) takes the nearest free namesake of its line.

    Taking turns is what deferred acceptance comes to when everyone on the other side prefers the earliest: every
    station asks for the nearest namesake that has not refused it, and each of these keeps the earliest asker and
    refuses all later ones for good. In what order they ask does not matter, so in each round the stations of a tile
    take turns among themselves, and namesakes choose between the tiles. Only tiles with stations that nobody keeps
    take turns again, and rounds go by two ways to cut tiles, so that few chains of refusals stay at an edge. A station
    that all within its ring have refused looks in a wider one, so pairs that nobody has to ask about are never made.
    It ends when all are kept or have looked everywhere.
    """
    own = _in_turn(own.select("line", "sid", "ord", "lat", "lng", "name", "name_th"))
    other = other.select("line", F.col("ord").alias("o_ord"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), "name_en", "name_th").filter("line IS NOT NULL AND o_ord IS NOT NULL")
    other = materialise(global_rank(other, ["o_ord", "line"], "o").withColumn("o", F.min("o").over(Window.partitionBy("line", "o_ord"))))
    named = other.select("line", "o", "o_lat", "o_lng", _names("name_en", "name_th"))
    known = materialise(named.select("line", "name").distinct().withColumn("of", F.monotonically_increasing_id()))
    there = materialise(named.join(known, ["line", "name"]).select("of", "o", "o_lat", "o_lng"))
    seekers = own.filter("lat IS NOT NULL AND lng IS NOT NULL").select("turn", "tile0", "tile1", "line", "lat", "lng", _names("name", "name_th")).join(known, ["line", "name"]).drop("line", "name")
    seekers = materialise(first_rings(seekers, there, RINGS, ("lat", "lng"), ("o_lat", "o_lng"), ("of",), "turn"))
    columns = ["turn", "tile0", "tile1", "o", "metres"]
    rivals = lambda of: materialise(_rivals(of, there, ("of",)).select(*columns))  # noqa: E731, a pair may share both names and come twice
    pairs = rivals(seekers.withColumn("inner", F.lit(-1.0)))
    asking = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    looked, seekers = materialise(seekers.groupBy("turn", "tile0", "tile1").agg(F.max("ring").alias("ring"))), seekers.drop("ring", "tile0", "tile1")
    held, free, tile = own.sparkSession.createDataFrame([], asking), looked.select("tile0", "tile1"), "tile0"
    for k in itertools.count():
        again, by = free.select(tile).distinct(), held.select("o", F.col("turn").alias("by"))
        allowed = lambda some: some.join(by, "o", "left").filter("by IS NULL OR by >= turn").select(*columns)  # noqa: B023, E731
        if k in PRUNED:  # most refusals come early, and hold for good
            pairs = materialise(allowed(pairs))
        asked = allowed(pairs.join(again, tile, "left_semi")).groupBy(tile).applyInPandas(_take_turns, asking)
        asked = held.join(again, tile, "left_anti").select(*columns).unionByName(asked)  # tiles that rest keep what they hold
        asked = materialise(asked.withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy("turn"))))
        held, refused = asked.filter("k = 1").drop("k"), asked.filter("k > 1")
        hungry = materialise(looked.groupBy("turn", "tile0", "tile1").agg(F.max("ring").alias("ring")).filter(F.col("ring") < len(RINGS) - 1).join(asked, "turn", "left_anti"))
        if not hungry.isEmpty():
            farther = hungry.withColumn("inner", F.element_at(F.array(*map(F.lit, RINGS)), F.col("ring") + 1)).withColumn("ring", F.least(F.col("ring") + 2, F.lit(len(RINGS) - 1)))
            pairs = pairs.unionByName(rivals(seekers.join(farther, "turn")))
            looked = looked.unionByName(farther.drop("inner"))
        elif refused.isEmpty():
            return held.join(own.select("turn", "sid").distinct(), "turn").join(other.select("o", "line", "o_ord").distinct(), "o").select("line", "sid", "o_ord", "metres")
        free, tile = refused.select("tile0", "tile1").unionByName(hungry.select("tile0", "tile1")), "tile1" if tile == "tile0" else "tile0"


def least_cost(left: list[int], right: list[int], cost: list) -> tuple[list[int], list]:
    """The pair that each left end takes (or -1) and its price: as many pairs as can be without sharing an end, and of these the least total cost.

    Left ends come one by one; each takes the shortest way over pairs that are taken and free ones to a free right end,
    or to a left end that stays alone, which costs more than any way that spares it. A search ends where the way does,
    so it sees what lies near; memory is in proportion to the pairs. Whole numbers as costs make it exact. The prices
    (u) prove it least: with prices v <= 0 of the right ends, 0 where free, u + v is the cost of all pairs that are taken
    and no more than that of any other. So a pair that is not given changes nothing if it costs u of its left end or more.
    """
    n, m = max(left) + 1, max(right) + 1
    alone = 2 * (max(cost) + 1) * (n + 1)
    out: list[list[int]] = [[] for _ in range(n)]
    for p in sorted(range(len(cost)), key=cost.__getitem__):
        out[left[p]].append(p)
    of_left, of_right, u, v = [-1] * n, [-1] * m, [0] * n, [0] * m
    for start in range(n):
        reach, far, came, settled, heap = {start: 0}, {}, {}, set(), [(0, start)]
        best, free, stays = alone, -1, start
        while heap:
            d, i = heapq.heappop(heap)
            if d >= best:
                break
            if i in settled:
                continue
            settled.add(i)
            for p in out[i]:
                at = d - u[i] + cost[p]
                if at >= best:  # pairs come by cost, and v <= 0
                    break
                j = right[p]
                at -= v[j]
                held = of_right[j]
                if at >= best or at >= far.get(j, math.inf) or (held >= 0 and left[held] in settled):  # not again where sums of fractions differ in the last bit
                    continue
                far[j], came[j] = at, p
                if held < 0:
                    best, free, stays = at, j, -1
                elif at < reach.get(k := left[held], math.inf):  # on along the pair that holds it, at no cost
                    reach[k] = at
                    heapq.heappush(heap, (at, k))
                    if at + alone - u[k] < best:
                        best, free, stays = at + alone - u[k], -1, k
        for i, d in reach.items():
            if d < best:
                u[i] += best - d
        for j, d in far.items():
            if d < best:
                v[j] -= best - d
        if stays == start:
            continue
        j = free
        if stays >= 0:
            j, of_left[stays] = right[of_left[stays]], -1
        while j >= 0:
            p = came[j]
            before = of_left[left[p]]
            of_left[left[p]] = of_right[j] = p
            j = right[before] if before >= 0 else -1
    return of_left, u


def least_pairs(left: list[int], right: list[int], cost: list[float]) -> list[int]:
    """Which of the pairs to take: as many as can be without sharing an end, and of these the least total cost."""
    return sorted(p for p in least_cost(left, right, cost)[0] if p >= 0)


def _solve(pairs: DataFrame) -> DataFrame:
    """line, sid, part (which component), need (the price in micrometres), and o_ord and micro where the station is paired.

    By connected component of the pairs (line, sid, o_ord, micro); what fits one task is a component.
    """
    linked = materialise(pairs.withColumn("a", F.xxhash64(F.lit("a"), "line", "sid")).withColumn("b", F.xxhash64(F.lit("b"), "line", "o_ord")))  # equal hashes only join components
    rows = linked.count()
    if rows <= SOLVE_ROWS:
        grouped = linked.withColumn("part", F.lit(uuid.uuid4().hex)).withColumn("task", F.lit(0))
    else:
        tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SOLVE_ROWS))
        of = components(linked.select("a", "b")).select(F.col("node").alias("a"), F.concat(F.lit(f"{uuid.uuid4().hex} "), "component").alias("part"))
        grouped = linked.join(of, "a").withColumn("task", F.pmod(F.xxhash64("part"), F.lit(tasks)))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["line", "sid", "o_ord"])
        left, right = (part.groupby(["line", c]).ngroup().tolist() for c in ("sid", "o_ord"))
        taken, price = least_cost(left, right, part.micro.tolist())
        ends = part.drop_duplicates(["line", "sid"])[["line", "sid", "part"]].reset_index(drop=True)
        o_ord, micro = part.o_ord.tolist(), part.micro.tolist()
        ends["o_ord"] = pd.Series([o_ord[p] if p >= 0 else None for p in taken], dtype=object)
        ends["micro"] = pd.Series([micro[p] if p >= 0 else None for p in taken], dtype="Int64")
        return ends.assign(need=[min(x, 2**62) for x in price])

    return materialise(grouped.groupBy("task").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("line", "sid", "o_ord", "micro")) + ", part string, need long"))


def match_rest(own: DataFrame, other: DataFrame) -> DataFrame:
    """line, sid, o_ord, metres: the most pairs within ASSIGN_M metres on a line, and of these the least total way.

    Where a pair beyond the limit costs more than all others together, this is what least total cost over all pairs
    means. Each station begins with the nearest only. Prices tell whether it has to look farther: it is right once the
    price of a station is no more than the distance up to which all its pairs are there. So components are no larger
    than what competes, pairs far beyond it are never made, and only components that get new pairs are solved again.
    """
    limit, last, key = round(ASSIGN_M * 1e6), RINGS.index(ASSIGN_M), ["line", "sid"]
    other = materialise(other.select("line", F.col("ord").alias("o_ord"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng")).filter("line IS NOT NULL AND o_ord IS NOT NULL"))
    places = materialise(own.select(*key, "lat", "lng").filter("line IS NOT NULL AND sid IS NOT NULL").distinct())
    made = lambda of: materialise(_rivals(places.join(of, key), other, ("line",)).select(*key, "o_ord", F.round(F.col("metres") * 1e6).cast("long").alias("micro")))
    first = materialise(first_rings(places, other, RINGS[: last + 1], ("lat", "lng"), ("o_lat", "o_lng"), ("line",), *key).groupBy(*key).agg(F.least(F.max("ring") + 1, F.lit(last)).alias("ring")))
    pairs = made(first.withColumn("inner", F.lit(-1.0)))
    state = materialise(first.join(pairs.groupBy(*key).agg(F.min("micro").alias("reach")), key))
    within = lambda: pairs.join(state.select(*key, "reach"), key).filter("micro <= reach").drop("reach")
    solved = _solve(within())
    while True:
        wanting = state.join(solved.select(*key, "need", "part"), key).filter((F.col("need") > F.col("reach")) & (F.col("reach") < limit))
        twice = F.greatest(F.col("reach") * 2, F.lit(round(RINGS[0] * 1e6)))
        farther = F.least(F.when(F.col("need") <= limit, F.greatest("need", F.col("reach") * 2)).otherwise(twice), F.lit(limit))
        ring = F.greatest("ring", sum((F.col("farther") > round(r * 1e6)).cast("int") for r in RINGS[:last]))
        wanting = materialise(wanting.withColumn("farther", farther).select(*key, "part", F.col("ring").alias("before"), ring.alias("ring"), F.col("farther").alias("reach")))
        if wanting.isEmpty():
            return solved.filter("o_ord IS NOT NULL").select(*key, "o_ord", (F.col("micro") / 1e6).alias("metres"))
        state = materialise(state.join(wanting, key, "left_anti").unionByName(wanting.drop("part", "before")))
        grown = wanting.filter("ring > before").select(*key, "ring", F.element_at(F.array(*map(F.lit, RINGS)), F.col("before") + 1).alias("inner"))
        if not grown.isEmpty():
            pairs = pairs.unionByName(made(grown))
        now = materialise(within())
        met = now.join(now.join(wanting, key, "left_semi").select("line", "o_ord").distinct(), ["line", "o_ord"], "left_semi").select(*key).distinct()
        parts = solved.join(met, key, "left_semi").select("part").unionByName(wanting.select("part")).distinct()
        again = _solve(now.join(solved.join(parts, "part", "left_semi").select(*key), key, "left_semi"))
        solved = materialise(solved.join(again, key, "left_anti").unionByName(again))


def match_stations(own: DataFrame, other: DataFrame) -> DataFrame:
    """own (line, sid, ord, name, name_th, lat, lng), other (line, ord, name_en, name_th, lat, lng) to line, sid, other_ord, method, delta_m, status.

    By name first, then by least total way among what is left. Claims are of a line: a station of `other` may match on several.
    """
    named = materialise(match_names(own, other))
    rest = match_rest(own.join(named, ["line", "sid"], "left_anti"), other.join(named.select("line", F.col("o_ord").alias("ord")), ["line", "ord"], "left_anti"))
    out = named.withColumn("method", F.lit("name")).unionByName(rest.withColumn("method", F.lit("assignment")))
    metres = F.col("metres")
    return out.select("line", "sid", F.col("o_ord").cast("long").alias("other_ord"), "method", F.bround(metres).cast("long").alias("delta_m"), confidence(metres).alias("status"))


def match_records(own: DataFrame, other: DataFrame, matches: DataFrame) -> DataFrame:
    """Every station with its match in full: status, method, what it has now (current_*), what the match has (osm_*), delta_m.

    other: line, ord, osm_id, ref, name_en, name_th, lat, lng. Stations without a match are phantoms with what they have now.
    """
    now = own.select("line", "sid", *(F.col(a).alias(f"current_{a}") for a in ("lat", "lng", "name", "name_th")))
    theirs = other.select("line", F.col("ord").alias("other_ord"), "osm_id", F.col("ref").alias("osm_ref"), F.col("name_en").alias("osm_name_en"), F.col("name_th").alias("osm_name_th"), F.col("lat").alias("osm_lat"), F.col("lng").alias("osm_lng"))
    rows = now.join(matches.join(theirs, ["line", "other_ord"]), ["line", "sid"], "left").drop("other_ord")
    return rows.withColumn("status", F.coalesce("status", F.lit("phantom")))


def with_phantoms(own: DataFrame, matches: DataFrame) -> DataFrame:
    """All stations with their match; those without one as phantoms."""
    rest = own.join(matches, "sid", "left_anti").select("line", "sid", F.lit("phantom").alias("status"))
    return matches.unionByName(rest, allowMissingColumns=True)


def apply_corrections(stations: DataFrame, matches: DataFrame) -> DataFrame:
    """stations (sid, name, name_th, lat, lng) with the matched places and names: new_* and whether moved or renamed.

    Names change where the match has one; phantoms and stations without a match stay as they are.
    """
    m = matches.filter(~F.col("status").isin("phantom", "no_osm_line", "phantom_duplicate"))
    m = m.select("sid", F.col("osm_lat").alias("_lat"), F.col("osm_lng").alias("_lng"), F.col("osm_name_en").alias("_en"), F.col("osm_name_th").alias("_th"))
    lat, lng = (F.coalesce(F.round(f"_{c}", 5), F.col(c)) for c in ("lat", "lng"))
    name = either(F.col("_en"), F.col("name"))
    return stations.join(m, "sid", "left").select(
        *stations.columns,
        lat.alias("new_lat"),
        lng.alias("new_lng"),
        name.alias("new_name"),
        either(F.col("_th"), F.col("name_th")).alias("new_name_th"),
        (~lat.eqNullSafe(F.col("lat")) | ~lng.eqNullSafe(F.col("lng"))).alias("moved"),
        (~name.eqNullSafe(F.col("name"))).alias("renamed"),
    )


def merge_entities(rows: DataFrame) -> DataFrame:
    """rows (qid, name, lat, lng, code, line, ord) to one for each qid: the first name and place, all codes and lines sorted."""
    first = F.min(F.struct("ord", "name", "lat", "lng")).alias("f")
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("code", "line")]
    return rows.groupBy("qid").agg(first, *sets).select("qid", "f.name", "f.lat", "f.lng", "codes", "lines")


def correction_report(corrected: DataFrame, matches: DataFrame) -> DataFrame:
    """What apply_corrections did: name, n for updated, kept, renamed, and rows that lack a required field."""
    used = matches.filter(~F.col("status").isin("phantom", "no_osm_line", "phantom_duplicate")).select("sid").withColumn("_used", F.lit(True))
    rows = corrected.join(used, "sid", "left")
    lacking = F.col("new_lat").isNull() | F.col("new_lng").isNull() | (F.coalesce("new_name", F.lit("")) == "")
    counts = {"updated": F.col("_used") & F.col("moved"), "kept": F.col("_used").isNull(), "renamed": F.col("_used") & F.col("renamed"), "lacking": lacking}
    wide = rows.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in counts))).alias("x")).select("x.*")


def line_report(matches: DataFrame) -> DataFrame:
    """line, status, n: how well each line is matched; a missing line is `?`."""
    return matches.groupBy(F.coalesce("line", F.lit("?")).alias("line"), "status").agg(F.count("*").alias("n"))
