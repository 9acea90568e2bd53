"""Near-duplicates by circulant MinHash, banding and exact Jaccard.

Two permutations make the whole signature: the first scatters a document's shingles over a circle of SLOTS places,
the second ranks the places; coordinate k is the least rank of the document's places after a shift by k. Bands of
the signature are hashed to keys, and documents that share a key are candidates.

Links are confirmed on the full shingle sets. Documents with the same set are one node from the start. In each bucket
(the nodes of a key) every node is first held against one central node; what these links join is done with. Nodes of a
bucket that are still apart are then compared in blocks of bounded size, so that no link between components is lost,
while no task gets a whole bucket and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import broadcast_if_light, byte_class, materialise, mix, read, slices, string_buffers, tell_apart, text_hash, tidied, Words
from wayfare.llm.components import components

ROWS, BANDS = 5, 40
SLOTS = 1 << 20
#: Sets of more shingles than this fill the circle too well; they get keys from a circle of 2^64 places instead. Sets of
#: four fifths of that and more get both, so linked sets always have keys of one kind.
LONG = SLOTS >> 4
SEED = 20240613
#: Shingles that a block of the exhaustive comparison holds (a longer single document apart), each node counting as
#: PLUS more: so a block has BLOCK / PLUS nodes at most, whatever their size.
BLOCK, PLUS = 200_000, 150

IN_WORD = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))

_ring: dict[int, np.ndarray] = {}


def ring(width: int) -> np.ndarray:
    """The second permutation as a table in which row p holds the ranks of the places p, p + 1, ... (width of them)."""
    if width not in _ring:
        ranks = np.random.default_rng(SEED).permutation(SLOTS).astype(np.uint32)
        _ring[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: width - 1]]), width)
    return _ring[width]


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """All coordinates of a set of shingle hashes."""
    table, out = ring(width), np.full(width, SLOTS, np.uint32)
    places = (shingles * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - 20)).astype(np.int64)  # the first permutation, folded to the circle
    for low in range(0, len(places), 256):
        np.minimum(out, table[places[low : low + 256]].min(0), out=out)
    return out


def wide_signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """All coordinates on a circle of 2^64 places, whose ranks are computed; for long sets."""
    out, shift = np.full(width, np.iinfo(np.uint64).max, np.uint64), np.arange(width, dtype=np.uint64)
    places = mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    for low in range(0, len(places), 2048):
        np.minimum(out, mix(places[low : low + 2048, None] + shift).min(0), out=out)
    return out


def keys_of(shingles: np.ndarray, rows: int, bands: int, percent: int) -> np.ndarray:
    """The band keys of a set: by the table for short sets, by the wide circle for long ones, both in between."""
    parts = []
    if len(shingles) <= LONG:
        parts.append(band_keys(signature(shingles, rows * bands)[None], rows, bands)[0])
    if 100 * len(shingles) >= percent * LONG:
        parts.append(band_keys(wide_signature(shingles, rows * bands)[None], rows, bands, 1 << 32)[0])
    return np.concatenate(parts)


def band_keys(signatures: np.ndarray, rows: int, bands: int, salt: int = 0) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.tile(np.arange(salt, salt + bands, dtype=np.uint64), (len(signatures), 1))
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def shingle_sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; all its words as one where there are fewer than k."""
    words = Words(*string_buffers(part.column("text")), IN_WORD)
    grams = words.grams(k)
    for i in range(part.num_rows):
        low, high = words.first[i], words.first[i + 1]
        if high - low >= k:
            yield np.unique(grams[low : high - k + 1])
        elif high > low:
            whole = np.full(1, high - low, np.uint64)
            for h in words.hash[low:high]:
                whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set; both together tell sets apart."""
    if not len(shingles):
        return 0, 0
    one, two = mix(shingles), mix(shingles ^ np.uint64(0xE7037ED1A0B428DB))
    total = np.array([one.sum() + np.uint64(len(shingles)), (one * two).sum()], np.uint64)
    a, b = mix(total).view(np.int64)
    return int(a), int(b)


def signed_docs(docs: DataFrame, k: int, rows: int, bands: int, percent: int) -> DataFrame:
    """docs (doc_id, text, text_hash) to doc_id, text_hash, n, node, check, keys; empty sets have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, node, check, keys = [], [], [], []
                for found in shingle_sets(part, k):
                    n.append(len(found))
                    a, b = set_keys(found)
                    node.append(a)
                    check.append(b)
                    keys.append(keys_of(found, rows, bands, percent) if len(found) else np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), lists], ["doc_id", "text_hash", "n", "node", "check", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"doc_id {kind}, text_hash long, n long, node long, check long, keys array<long>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """docs (node, text) to node and its shingles (little-endian unsigned 64-bit, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [x.tobytes() for x in shingle_sets(part, k)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "set"])

    return docs.mapInArrow(tidied(run), "node long, set binary")


def alike(shared: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                keep.append(bool(alike(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def block_links(node: list[int], group: list[int], side: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different groups that join them: at most one fewer than there are groups.

    side: 1 for nodes compared with all others, 0 for those compared with side 1 only.
    """
    sizes = np.array([len(s) for s in sets])
    ask, all_at = np.flatnonzero(side), np.arange(len(sets))
    values, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(all_at, sizes)
    use = seen[inverse] > 1  # what one set alone has is in no intersection
    column, row = (np.cumsum(seen > 1) - 1)[inverse[use]], row[use]
    shared, width = np.zeros((len(ask), len(sets)), np.float32), int((seen > 1).sum())
    step = max(64, 4_000_000 // max(1, len(sets)))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, width, step):
        a, b = np.searchsorted(column, [low, low + step])
        has = np.zeros((len(sets), min(step, width - low)), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        shared += has[ask] @ has.T
    group = np.array(group)
    good = alike(np.rint(shared).astype(np.int64), sizes[ask][:, None], sizes[None, :], percent) & (group[ask][:, None] != group[None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(good), strict=True):
        i = ask[i]
        a, b = find(int(group[i])), find(int(group[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(node[i]), int(node[j])))
    return out


def apart_links(members: DataFrame, labels: DataFrame, leaders: DataFrame, sets_for, percent: int) -> DataFrame | None:
    """Links between nodes of a bucket that lie in different components; None where no bucket needs a look.

    members (key, node, n), labels (node, component), leaders (key, leader). A bucket of two is settled by its
    leader. The nodes outside the leader's component are compared with all others, block by block.
    """
    own = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("group"))
    heads = leaders.join(labels, leaders.leader == labels.node, "left").select("key", F.coalesce("component", "leader").alias("head"))
    sided = own.join(heads, "key").withColumn("side", (F.col("group") != F.col("head")).cast("int"))
    facts = sided.groupBy("key").agg(F.sum("side").alias("asks"), F.count("*").alias("nodes"), F.sum(F.col("side") * (F.col("n") + PLUS)).alias("asking"), F.sum(F.col("n") + PLUS).alias("asked"))
    facts = facts.filter((F.col("asks") > 0) & (F.col("nodes") > 2)).select("key", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("asking", "asked")))
    rows = materialise(sided.join(facts, "key"))
    if rows.isEmpty():
        return None
    place = lambda blocks: F.pmod(F.xxhash64("node", "key"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    asks = rows.filter("side = 1").select("key", "node", "group", F.lit(1).alias("side"), place("asking").alias("i"), every("asked").alias("j"))
    told = rows.select("key", "node", "group", F.lit(0).alias("side"), every("asking").alias("i"), place("asked").alias("j"))
    dealt = asks.union(told).groupBy("key", "i", "j", "node", "group").agg(F.max("side").alias("side"))
    full = dealt.join(sets_for(rows.select("node").distinct()), "node")

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        side = table.column("side").to_pylist()
        found = block_links(table.column("node").to_pylist(), table.column("group").to_pylist(), side, sets, percent) if any(side) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return full.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document: doc_id, text_hash, node (name of its shingle set), component (least node of the
    linked ones), n_shingles, component_id, kept.

    Two documents are linked if their sets of k-word shingles have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest id reachable, kept says whether it is the document's own. Null, empty and wordless
    texts have no shingles and are linked with nothing; a text of fewer than k words is one shingle. Rows that repeat
    an id are each judged by their own text, so several can be kept: doc_id with text_hash tells them apart, and
    component those that are linked. Rows with a null id are linked like others; component_id is null only where all
    ids of a component are, and then all its rows are kept. node and component are null without shingles. An empty table gives no rows; further columns
    are not read. With the default bands, a pair at exactly the threshold shares a key with probability 1 - 1e-7. Sets are
    told apart by 128 bits. Texts are looked at whole, a set of eight bytes a shingle at a time.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    signed = materialise(signed_docs(texts, k, rows, bands, percent))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")  # null ids last
    nodes = signed.filter("n > 0").groupBy("node", "check").agg(row, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.select("node", "check", "row.doc_id", "row.text_hash", "n", "keys"))
    signed, nodes = tell_apart(nodes, signed, nodes)
    banded = nodes.select(F.explode("keys").alias("key"), "node", "n")
    busy = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialise(banded.join(busy, "key"))

    def sets_for(wanted: DataFrame) -> DataFrame:
        own = nodes.join(broadcast_if_light(materialise(wanted)), "node", "left_semi").select("node", F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
        rows_of = texts.join(broadcast_if_light(materialise(own)), same).select("node", "text")
        return materialise(sets_of(rows_of, k).dropDuplicates(["node"]))  # rows that repeat an id and text

    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(central, "node")
    leaders = materialise(weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("head")).select("key", F.col("head.node").alias("leader"), F.col("head.n").alias("leader_n")))
    able = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    pairs = members.join(leaders, "key").filter((F.col("node") != F.col("leader")) & able)
    pairs = materialise(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = materialise(verified(pairs, sets_for(ends), percent))
    labels = components(links)
    more = apart_links(members, labels, leaders.select("key", "leader"), sets_for, percent)
    if more is not None:
        more = materialise(more)
        if not more.isEmpty():
            labels = components(links.union(more))
    labels = materialise(labels)
    named = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = broadcast_if_light(materialise(named.join(least, "component").select("node", "component", "component_id")))
    wide = signed.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return wide.select("doc_id", "text_hash", "node", "component", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2).drop("text_hash", "node", "component")


OP10_SQL = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w
        ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS g
    FROM d),
u AS (SELECT g, row_number() OVER () AS node, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT node, len(g) AS n, unnest(g) AS t FROM u),
p AS (
    SELECT a.node AS a, b.node AS b
    FROM x a JOIN x b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c(node, reach) AS (SELECT node, node FROM u UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a),
m AS (SELECT c.node, min(u.least) AS component_id FROM c JOIN u ON u.node = c.reach GROUP BY c.node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) > 0 THEN m.component_id ELSE s.doc_id END AS component_id,
    s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.g) > 0 THEN m.component_id ELSE s.doc_id END AS kept
FROM s LEFT JOIN u ON s.g = u.g AND len(s.g) > 0 LEFT JOIN m ON u.node = m.node
"""
