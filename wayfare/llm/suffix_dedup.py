"""Repeated passages by suffix arrays: every byte that an earlier 100-byte string covers is taken out.

Copies of whole texts are settled first. Every 100-byte window of the other texts is kept by one anchor gram (the one of
least hash in it), so equal windows meet at equal anchors; consecutive windows of an anchor are one run with one segment
of text. Anchors that stand once are done with. Of equal segments the first stays (a minimum that is combined before
its shuffle) and the later ones go. Where one anchor has different segments, these are laid end to end, and a suffix
array finds the windows that they have in common: two-stage sorting sorts only suffixes that are smaller than their
successors, induces the others by scans of the buckets of first bytes, and adjacent common prefixes of 100 bytes mark
equal windows. Anchors with very many segments are cut into blocks, each of which gives its own distinct windows to a
combined minimum, so no key has to be sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.anchors import Rolling, anchored
from wayfare.llm.common import broadcast_if_light, materialise, read, slices, string_buffers, tidied

WINDOW = 100
GRAM = 32
#: Segments of one anchor that are sorted together.
BLOCK = 2000
#: Bytes of segments that are sorted together, whole blocks of anchors.
BUNDLE = 1 << 19


def eights(text: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places on, as a number."""
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= text[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes (rounded up to eight), ties in any order."""
    at = at[np.argsort(words[at], kind="stable")]
    edge = np.ones(len(at), bool)
    edge[1:] = words[at[1:]] != words[at[:-1]]
    for d in range(8, depth, 8):
        tied = ~edge
        tied[:-1] |= ~edge[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        group, sub = np.cumsum(edge)[tied], at[tied]
        key = words[sub + d]
        order = np.lexsort((key, group))
        at[tied], key = sub[order], key[order]
        edge[tied[1:]] |= key[1:] != key[:-1]
    return at


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (and those that place them) in order of their first `depth` bytes.

    text ends with at least `depth` + 16 bytes of padding, the first of them 0 and the second 255.
    """
    n = len(wanted)
    # smaller than its successor: the next different byte is larger
    change = np.flatnonzero(text[:n] != text[1 : n + 1])
    run_end = change[np.searchsorted(change, np.arange(n))] if len(change) and change[-1] == n - 1 else None
    if run_end is None:
        change = np.append(change, n - 1)
        run_end = change[np.searchsorted(change, np.arange(n))]
    smaller = text[run_end] < text[run_end + 1]
    places = np.flatnonzero(smaller)
    # each wanted suffix that is larger than its successor needs all up to the next smaller one
    last = np.flatnonzero(wanted)
    opens = np.zeros(n + 1, np.int64)
    np.add.at(opens, last, 1)
    np.add.at(opens, places[np.searchsorted(places, last)] + 1, -1)
    need = np.cumsum(opens)[:n] > 0
    words = eights(text, len(text) - 8)
    direct = sort_directly(words, np.flatnonzero(need & smaller), depth)
    induce = need & ~smaller
    bounds = np.searchsorted(text[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = []
        front = np.concatenate(queue[c]) if queue[c] else direct[:0]
        while len(front):  # runs of one byte extend their own bucket
            parts.append(front)
            before = front[front > 0] - 1
            front = before[induce[before] & (text[before] == c)]
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induce[before] & (text[before] > c)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            chars, starts = np.unique(text[before], return_index=True)
            for ch, part in zip(chars, np.split(before, starts[1:]), strict=True):
                queue[ch].append(part)
    return np.concatenate(out) if out else direct


def equal_windows(segments: list[bytes], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the segments: its segment, its place there, and a class that equal windows share.

    starts: how many windows each segment has.
    """
    sizes = np.array([len(s) for s in segments])
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = int(base[-1]) + 1
    text = np.zeros(n + window + 32, np.uint8)
    text[: n - 1] = np.frombuffer(b"".join(segments), np.uint8)
    text[n] = 255  # behind a 0: every suffix has a smaller one after it
    wanted = np.zeros(n, bool)
    segment = np.repeat(np.arange(len(segments)), starts)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(starts) - starts, starts)
    wanted[base[segment] + place] = True
    order = two_stage(text, wanted, window)
    # adjacent common prefixes, eight bytes at a time and then one by one; only whether they reach the window counts
    same = np.ones(max(0, len(order) - 1), bool)
    words = eights(text, len(text) - 8)
    for d in range(0, window - 7, 8):
        live = np.flatnonzero(same)
        same[live] = words[order[live] + d] == words[order[live + 1] + d]
    for d in range(window - window % 8, window):
        live = np.flatnonzero(same)
        same[live] = text[order[live] + d] == text[order[live + 1] + d]
    group = np.zeros(n, np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)]) if len(order) else 0
    return segment, place, group[base[segment] + place]


def _later(group: np.ndarray, ord_: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an earlier equal one, and which are the first of their class."""
    order = np.lexsort((start, ord_, group))
    g, o, s = group[order], ord_[order], start[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else g
    later = np.zeros(len(g), bool)
    later[order] = (o != o[first]) | (s != s[first])
    heads = np.zeros(len(g), bool)
    heads[order] = head
    return later, heads


def resolve(rows: dict[str, list], window: int) -> dict[str, np.ndarray]:
    """Of some blocks of segments: stretches of windows to remove, and windows that other blocks must still be held against.

    rows: anchor, ord, said, lo, split (whether the anchor has other blocks), bytes. Gives ord, said, lo, hi, anchor, key;
    key is 0 with `open` false for stretches, and the hash of an open window else. Windows are equal only if their
    anchors are, so both together name one.
    """
    raw = rows["bytes"]
    starts = np.array([len(b) - window + 1 for b in raw])
    segment, place, group = equal_windows(raw, starts, window)
    ord_, said, lo, split, anchor = (np.array(rows[c]) for c in ("ord", "said", "lo", "split", "anchor"))
    start = lo[segment] + place
    later, heads = _later(group, ord_[segment], start)
    out = {k: [] for k in ("ord", "said", "lo", "hi", "anchor", "key", "open")}

    def add(seg, a, b, key, open_):
        for name, x in (("ord", ord_[seg]), ("said", said[seg]), ("lo", a), ("hi", b), ("anchor", anchor[seg]), ("key", key), ("open", np.full(len(seg), open_))):
            out[name].append(x)

    gone = later | split[segment]  # what other blocks may hold goes, but for the windows that prove to be first
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (segment[1:] != segment[:-1])
    end = gone.copy()
    end[:-1] &= ~gone[1:] | (segment[1:] != segment[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(end)
    add(segment[a], start[a], start[b], np.zeros(len(a), np.int64), False)
    at = np.flatnonzero(heads & split[segment])
    if len(at):
        rolling = Rolling(np.frombuffer(b"".join(raw), np.uint8))
        base = (np.cumsum([len(x) for x in raw]) - [len(x) for x in raw])[segment[at]] + place[at]
        add(segment[at], start[at], start[at], rolling.hash(base, base + window).view(np.int64), True)
    return {k: np.concatenate(v) for k, v in out.items()}


OUT = "ord long, said long, lo int, hi int, anchor long, key long, open boolean"


def _bundles(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, list]]:
    """Rows sorted by (anchor, block), in runs of whole blocks of about `limit` bytes."""
    names = ("anchor", "block", "ord", "said", "lo", "split", "bytes")
    rows: dict[str, list] = {c: [] for c in names}
    size, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if size >= limit and (row[0], row[1]) != last:
                yield rows
                rows, size = {c: [] for c in names}, 0
            for c, v in zip(names, row, strict=True):
                rows[c].append(v)
            size += len(row[-1])
            last = (row[0], row[1])
    if size:
        yield rows


def _arrow(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"ord": pa.int64(), "said": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "anchor": pa.int64(), "key": pa.int64(), "open": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in kinds.items()], list(kinds))


def repeats(firsts: DataFrame, window: int, gram: int) -> DataFrame:
    """firsts (ord, said, text), no two texts equal, to stretches: ord, said, lo, hi, keep.

    Windows that start from lo to hi repeat an earlier one, but for those of rows with keep. Anchors are found twice, as
    most stand once: to count them first costs less than to write all runs (40 bytes for about 35 of text).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, n = np.unique(anchored(*string_buffers(part.column("text")), window, gram)["anchor"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["anchor", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                r = anchored(*string_buffers(part.column("text")), window, gram)
                doc = pa.array(r["doc"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("ord").take(doc), part.column("said").take(doc), pa.array(r["lo"], pa.int32()), pa.array(r["hi"], pa.int32()), pa.array(r["anchor"]), pa.array(r["segment"])],
                    ["ord", "said", "lo", "hi", "anchor", "segment"],
                )

    repeated = firsts.select("text").mapInArrow(tidied(count), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    repeated = materialise(repeated)
    all_runs = materialise(firsts.mapInArrow(tidied(runs), "ord long, said long, lo int, hi int, anchor long, segment long").join(repeated, "anchor"))
    first = materialise(all_runs.groupBy("anchor", "segment").agg(F.min(F.struct("ord", "lo", "said", "hi")).alias("f")))
    same = all_runs.join(first, ["anchor", "segment"]).filter((F.col("ord") > F.col("f.ord")) | ((F.col("ord") == F.col("f.ord")) & (F.col("lo") > F.col("f.lo"))))
    same = same.select("ord", "said", "lo", "hi", F.lit(False).alias("keep"))

    several = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("segment"), F.col("blocks")).cast("int")
    need = first.join(several, "anchor").select("f.ord", "f.said", F.struct("f.lo", "f.hi", "anchor", block.alias("block"), (F.col("blocks") > 1).alias("split")).alias("x"))
    lists = materialise(need.groupBy("ord", "said").agg(F.collect_list("x").alias("x")))  # no more for each text than it has runs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "block", "ord", "said", "lo", "split", "bytes"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = string_buffers(part.column("text"))
                rows = []
                for i, (o, s, x) in enumerate(zip(part.column("ord").to_pylist(), part.column("said").to_pylist(), part.column("x").to_pylist(), strict=True)):
                    text = raw[at[i] : at[i + 1]].tobytes()
                    rows += [(r["anchor"], r["block"], o, s, r["lo"], r["split"], text[r["lo"] : r["hi"] + window]) for r in x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    segments = firsts.join(lists, ["ord", "said"]).mapInArrow(tidied(cut), "anchor long, block int, ord long, said long, lo int, split boolean, bytes binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bundles(batches, BUNDLE):
            yield _arrow(resolve(rows, window))

    dealt = segments.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    found = materialise(dealt.mapInArrow(tidied(sort), OUT))
    gone = found.filter("NOT open").select("ord", "said", "lo", "hi", F.lit(False).alias("keep"))
    kept = found.filter("open").groupBy("anchor", "key").agg(F.min(F.struct("ord", "lo", "said")).alias("f"))
    kept = kept.select("f.ord", "f.said", "f.lo", F.col("f.lo").alias("hi"), F.lit(True).alias("keep"))
    return same.union(gone).union(kept)


def spans_of(n: int, stretches: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes of a text of n bytes."""
    opens = np.zeros(n + 2, np.int32)
    for r in stretches:
        if not r["keep"]:
            opens[r["lo"]] += 1
            opens[r["hi"] + 1] -= 1
    gone = np.cumsum(opens, dtype=np.int32) > 0
    for r in stretches:
        if r["keep"]:
            gone[r["lo"]] = False
    at = np.flatnonzero(gone)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(at, breaks)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (lo, hi in bytes, hi exclusive), kept (the bytes that stay) of every row.

    Texts are UTF-8 bytes; null counts as empty. Earlier means a smaller id, or the same id and an earlier start; a
    null id comes before all others, and rows that repeat an id are one document to each other: of equal starts none
    is earlier. Strings of fewer than `window` bytes are never removed. Long texts are taken in stretches for their
    anchors, but a text is held whole. An empty table gives no rows; further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ["said", "also", "n_bytes"]  # 128 bits and the length name a text
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("ord"), text.alias("text"), F.xxhash64(text).alias("said"), F.xxhash64(F.lit(1), text).alias("also"), F.octet_length(text).cast("long").alias("n_bytes"))
    by_id = base.groupBy(*names, "ord").agg(F.count("*").alias("n"))
    copies = by_id.groupBy(*names).agg(F.min("ord").alias("rep"), F.sum("n").alias("n"), F.min_by("n", "ord").alias("same")).filter("n > 1").drop("n")
    copies = broadcast_if_light(materialise(copies))
    marked = base.join(copies, names, "left").withColumn("copy", F.coalesce(F.col("ord") > F.col("rep"), F.lit(False)) & (F.col("n_bytes") >= window))
    able = marked.filter(~F.col("copy") & (F.col("n_bytes") >= window))
    # rows that repeat an id and a text are looked at once; each then takes the result
    once, again = able.filter(F.coalesce("same", F.lit(1)) == 1), able.filter("same > 1").dropDuplicates(["ord", "said"])
    firsts = once.union(again).select("ord", "said", "text")
    stretches = repeats(firsts, window, gram)
    grouped = stretches.groupBy("ord", "said").agg(F.collect_list(F.struct("lo", "hi", "keep")).alias("x"))
    rest = marked.filter(~F.col("copy")).select("doc_id", "ord", "said", "text").join(grouped, ["ord", "said"], "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "spans", "kept"]
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = string_buffers(part.column("text"))
                spans, kept = [], []
                for i, x in enumerate(part.column("x").to_pylist()):
                    own = spans_of(int(at[i + 1] - at[i]), x, window) if x else []
                    bounds = [0, *(v for s in own for v in s), int(at[i + 1] - at[i])]
                    kept.append(b"".join(raw[at[i] + a : at[i] + b].tobytes() for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                    spans.append([{"lo": a, "hi": b} for a, b in own])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, span), pa.array(kept, pa.binary())], names)

    done = rest.mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    return done.union(marked.filter("copy").select("doc_id", "n_bytes", whole.alias("spans"), F.lit(b"").alias("kept")))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The registered query's rows by comparing all windows, for small fixtures."""
    least = -(1 << 63)
    first: dict[bytes, tuple[int, int]] = {}
    raws = [(i, least if i is None else i, (t or "").encode()) for i, t in docs]
    for _, o, raw in raws:
        for s in range(len(raw) - window + 1):
            key = raw[s : s + window]
            first[key] = min(first.get(key, (o, s)), (o, s))
    out = []
    for i, o, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if first[raw[s : s + window]] < (o, s):
                gone[s : s + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, o, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT r, o, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS s FROM d)),
f AS (SELECT k, min({'o': o, 's': s}) AS m FROM w GROUP BY k),
g AS (SELECT r, s FROM w JOIN f USING (k) WHERE {'o': o, 's': s} > m),
i AS (SELECT r, s, sum(CASE WHEN s - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS island
    FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM g)),
p AS (SELECT r, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY r, island),
q AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS back FROM p),
a AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(h, 2 * back + 1, 2 * (lo - back)), '' ORDER BY lo) AS kept
    FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
