"""Near-duplicate vectors by product quantisation.

A coarse quantiser of two levels deals unit vectors to inverted lists: lists that hold many vectors are dealt again to
lists of their own, so their number grows with the table and not their size. What is left of each vector is coded by
subspace, once, when it is dealt. Every vector also asks the lists near to it (all whose centroid is nearly as close as
the best, on both levels). Inside a list, distances come from look-up tables of the asking vector against the stored
codes. As each code carries how far it lies from its vector, the table distance bounds the cosine from above, so the
codes dismiss no link; what passes is confirmed by its cosine in double precision. Vectors travel with their codes as
they are in the table (four bytes a number): to fetch them for the survivors alone would mean to write these out, which
in a group of near-equal vectors are all pairs.

The quantisers are fitted on bounded samples; every vector is indexed. Equal vectors are one entry with a count. Lists
are cut into blocks, so that a hot one is many tasks, and blocks give counts and joining links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import broadcast_if_light, materialise, read, tell_apart, tidied
from wayfare.llm.components import components

#: Vectors that fit the coarse lists and the codewords: a bounded sample, chosen by hash.
SAMPLE = 16_384
#: Inverted lists of the first level at most; fewer for small tables.
LISTS = 1024
#: Vectors from which a list is dealt again, how many a list of the second level shall hold, and how many of these it has at most.
SPLIT, HOLD, FINE = 8192, 1024, 256
#: Vectors that fit the second level of one list at most, chosen by hash.
FINE_SAMPLE = 4096
#: Subspaces and codewords in each.
SUBSPACES, CODEWORDS = 16, 64
#: Rows of a block: asking and asked.
BLOCK = 2048
#: Standard deviations of the difference of two linked vectors that probing allows for.
REACH = 3.0
SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from a hashed start; empty cells keep their centroid."""
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = (x @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=k)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def directions(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of unit length."""
    found = kmeans(x, k)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norm > 0, norm, 1)


class Quantiser:
    """Coarse centroids of unit length on two levels, and residual codebooks. A list is its first level x FINE + its second."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float):
        k = max(1, min(LISTS, int(math.sqrt(n)) // 2, len(sample)))
        self.dim = sample.shape[1]
        self.coarse = directions(sample, k)
        self.fine: dict[int, np.ndarray] = {}
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        residual = sample - self.coarse[self.nearest(sample)]
        self.books = [kmeans(residual[:, p], min(CODEWORDS, len(sample))) for p in self.parts]
        # two linked vectors differ by this much at most; along one direction by this share of it
        apart = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.margin = min(apart * math.sqrt(2), REACH * apart * math.sqrt(2) / math.sqrt(self.dim))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The first-level list of each vector."""
        return (x @ self.coarse.T).argmax(1)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The list that holds each vector."""
        out = self.nearest(x) * FINE
        for at, centroids in self.fine.items():
            own = np.flatnonzero(out == at * FINE)
            if len(own):
                out[own] += (x[own] @ centroids.T).argmax(1)
        return out

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which vector asks which list."""
        near = x @ self.coarse.T
        row, at = np.nonzero(near >= near.max(1, keepdims=True) - self.margin)
        plain = ~np.isin(at, list(self.fine))
        rows, lists = [row[plain]], [at[plain] * FINE]
        for first in np.unique(at[~plain]).tolist():
            own = row[at == first]
            near = x[own] @ self.fine[first].T
            i, sub = np.nonzero(near >= near.max(1, keepdims=True) - self.margin)
            rows.append(own[i])
            lists.append(first * FINE + sub)
        return np.concatenate(rows), np.concatenate(lists)

    def asks(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether each vector asks the list beside it."""
        near = x @ self.coarse.T
        first, sub = lists // FINE, lists % FINE
        good = near[np.arange(len(x)), first] >= near.max(1) - self.margin
        for at in np.unique(first[good]).tolist():
            if at in self.fine:
                own = np.flatnonzero(good & (first == at))
                near = x[own] @ self.fine[at].T
                good[own] = near[np.arange(len(own)), sub[own]] >= near.max(1) - self.margin
        return good

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to first-level lists `at`, and how far each vector lies from what its code stands for."""
        rest = x - self.coarse[at]
        codes, error = np.empty((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for j, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            near = ((rest[:, None, p] - book[None]) ** 2).sum(2) if len(x) * len(book) < 1 << 22 else (rest[:, p] ** 2).sum(1)[:, None] - 2 * rest[:, p] @ book.T + (book**2).sum(1)
            codes[:, j] = near.argmin(1)
            error += np.maximum(0, near[np.arange(len(x)), codes[:, j]])
        return codes, np.sqrt(error)

    def bounds(self, asking: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Upper bounds of the cosines of the asking vectors with the coded ones of first-level list `at`."""
        total = np.repeat((asking @ self.coarse[at])[:, None], len(codes), 1)
        for j, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            total += (asking[:, p] @ book.T)[:, codes[:, j]]  # asymmetric: exact vector, table of codewords
        return total + error


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors at length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(batch: pa.RecordBatch, kind: np.dtype) -> tuple[list[int], list[bytes | None]]:
    """Number of components and bytes of each vector; 0 and none where it links with nothing."""
    sizes, out = [0] * batch.num_rows, [None] * batch.num_rows
    rows = batch.column("vec").to_pylist()
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        if x and None not in x:
            by_size.setdefault(len(x), []).append(i)
    for size, at in by_size.items():
        x = np.array([rows[i] for i in at], kind)
        fine = np.isfinite(x).all(1) & (x != 0).any(1)
        for i, row in zip(np.array(at)[fine].tolist(), x[fine], strict=True):
            sizes[i], out[i] = size, row.tobytes()
    return sizes, out


def as_bytes(vectors: DataFrame, kind: np.dtype) -> DataFrame:
    """vectors (vec_id, vec) to vec_id, dim, vec (binary; null where the vector links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = usable(batch, kind)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])

    return vectors.mapInArrow(tidied(run), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, dim int, vec binary")


def matrix(column, kind: np.dtype) -> np.ndarray:
    return scaled(np.stack([np.frombuffer(v.as_buffer(), kind) for v in column])) if len(column) else np.zeros((0, 0))


def fitted(entries: DataFrame, n: int, cosine: float, kind: np.dtype):
    """A broadcast quantiser for entries (node, vec) of one size, fitted on bounded samples of them."""
    sc = entries.sparkSession.sparkContext

    def picked(count, most: int):
        return F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 20)) < F.ceil(F.least(F.lit(1.0), F.lit(most) / count) * (1 << 20))

    sample = entries.filter(picked(F.lit(n), SAMPLE)).orderBy("node").limit(SAMPLE).select("vec").toArrow()
    quantiser = Quantiser(matrix(sample.column("vec"), kind), n, cosine)
    if n <= SPLIT:
        return sc.broadcast(quantiser)
    first = sc.broadcast(quantiser)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = first.value.nearest(matrix(batch.column("vec"), kind)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("node")], ["list", "node"])

    lists = materialise(entries.select("node", "vec").mapInArrow(tidied(listed), "list int, node long"))
    large = lists.groupBy("list").agg(F.count("*").alias("held")).filter(F.col("held") > SPLIT)
    large = materialise(large)
    if large.isEmpty():
        return first
    chosen = materialise(lists.join(F.broadcast(large), "list").filter(picked(F.col("held"), FINE_SAMPLE)))  # LISTS rows at most

    def fit(table: pa.Table) -> pa.Table:
        k = min(FINE, -(-int(table.column("held")[0].as_py()) // HOLD), table.num_rows)
        found = directions(matrix(table.column("vec"), kind), k).astype(np.float32)
        return pa.table({"list": pa.array([table.column("list")[0].as_py()] * k, pa.int32()), "centroid": pa.array([c.tobytes() for c in found], pa.binary())})

    rows = entries.select("node", "vec").join(broadcast_if_light(chosen), "node").groupBy("list").applyInArrow(fit, "list int, centroid binary")
    centroids: dict[int, list[np.ndarray]] = {}
    for r in rows.collect():  # at most LISTS x FINE centroids
        centroids.setdefault(r["list"], []).append(np.frombuffer(r["centroid"], np.float32))
    quantiser.fine = {at: np.stack(c).astype(np.float64) for at, c in centroids.items()}
    return sc.broadcast(quantiser)


def dealt(entries: DataFrame, quantiser, kind: np.dtype) -> DataFrame:
    """entries (node, n, vec) to one row for each list that asks or holds: list, side (0 holds, 1 asks), home, node, n, vec, and codes and error of those held."""
    names = ["list", "side", "home", "node", "n", "vec", "codes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), kind)
            home = q.homes(x)
            codes, error = q.encode(x, home // FINE)
            row, lists = q.probes(x)
            none = pa.nulls(len(row), pa.binary())
            for at, where, side, coded, wrong in ((np.arange(len(x)), home, 0, pa.array([c.tobytes() for c in codes], pa.binary()), error), (row, lists, 1, none, np.zeros(len(row)))):
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), pa.array(np.full(len(at), side, np.int32)), pa.array(home[at], pa.int32()), *(batch.column(c).take(taken) for c in ("node", "n", "vec")), coded, pa.array(wrong)],
                    names,
                )

    return entries.mapInArrow(tidied(run), "list int, side int, home int, node long, n long, vec binary, codes binary, error double")


def block_result(q: Quantiser, at: int, asking: dict, asked: dict, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Of one block of list `at`: links counted for each node, and links that join its nodes.

    A pair that its other side finds for itself is counted there; one that only this side can find counts for both.
    """
    count: dict[int, int] = {}
    root: dict[int, int] = {}
    joins = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for top in range(0, len(asking["x"]), 256):
        possible = q.bounds(asking["x"][top : top + 256], at // FINE, asked["codes"], asked["error"]) >= cosine - 1e-9
        rows, columns = np.nonzero(possible)
        rows += top
        other = asking["node"][rows] != asked["node"][columns]
        rows, columns = rows[other], columns[other]
        for low in range(0, len(rows), 16_384):
            i, j = rows[low : low + 16_384], columns[low : low + 16_384]
            near = (asking["x"][i] * asked["x"][j]).sum(1) >= cosine
            i, j = i[near], j[near]
            back = q.asks(asked["x"][j], asking["home"][i])  # the asked one asks the list of the asking one
            for node, n in ((asking["node"][i], asked["n"][j]), (asked["node"][j[~back]], asking["n"][i[~back]])):
                values, place = np.unique(node, return_inverse=True)
                total = np.zeros(len(values), np.int64)
                np.add.at(total, place, n)
                for v, t in zip(values.tolist(), total.tolist(), strict=True):
                    count[v] = count.get(v, 0) + t
            for a, b in zip(asking["node"][i].tolist(), asked["node"][j].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    joins.append((a, b))
    return count, joins


def links_of(entries: DataFrame, n: int, cosine: float, kind: np.dtype) -> DataFrame:
    """entries (node, n, vec) of one size to (a, b, links): counted links of a where b is null, else a link that joins."""
    shared = fitted(entries, n, cosine, kind)
    placed = materialise(dealt(entries.select("node", "n", "vec"), shared, kind))
    sizes = placed.groupBy("list").agg(F.sum("side").alias("asking"), F.sum(1 - F.col("side")).alias("asked"))
    cuts = materialise(sizes.select("list", *(F.greatest(F.ceil(F.col(c) / BLOCK).cast("int"), F.lit(1)).alias(c) for c in ("asking", "asked"))))
    cut = placed.join(broadcast_if_light(cuts), "list")
    hashed = F.xxhash64("node", "list")
    names = ["list", "side", "home", "node", "n", "vec", "codes", "error"]
    asks = cut.filter("side = 1").select(*names, F.pmod(hashed, "asking").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"))
    holds = cut.filter("side = 0").select(*names, F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), F.pmod(hashed, "asked").cast("int").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        halves = []
        for k in (1, 0):
            part = table.filter(pa.array(side == k))
            halves.append({"x": matrix(part.column("vec"), kind), **{c: part.column(c).to_numpy() for c in ("home", "node", "n", "error")}})
        count, joins = {}, []
        if len(halves[0]["x"]) and len(halves[1]["x"]):
            halves[1]["codes"] = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in part.column("codes")])
            count, joins = block_result(shared.value, int(table.column("list")[0].as_py()), *halves, cosine)
        a = [*count, *(x for x, _ in joins)]
        b = [*([None] * len(count)), *(x for _, x in joins)]
        links = [*count.values(), *([0] * len(joins))]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return materialise(asks.union(holds).groupBy("list", "i", "j").applyInArrow(run, "a long, b long, links long"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Only vectors of equally
    many components are compared (each size by quantisers of its own), as others have no cosine. Rows that repeat an id
    are vectors of their own, linked if they are alike. Null ids take part; a component without any other id has a null
    one. An empty table gives no rows. Further columns, labels included, are not read.
    """
    kind = np.dtype("<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8")
    rows = as_bytes(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")), kind)
    rows = materialise(rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("check", F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(SEED), "vec"))))
    known = rows.filter("vec IS NOT NULL").groupBy("node", "check", "dim")
    entries = materialise(known.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    rows, entries = tell_apart(entries, rows.select("vec_id", "node", "check"), entries)
    sizes = sorted((r["dim"], r["n"]) for r in entries.groupBy("dim").agg(F.count("*").alias("n")).collect())  # a row for each size of vectors
    found = [links_of(entries.filter(F.col("dim") == dim), n, cosine, kind) for dim, n in sizes]
    every = entries.sparkSession.createDataFrame([], "a long, b long, links long")
    for part in found:
        every = every.union(part)
    counts = every.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(every.filter("b IS NOT NULL"))
    named = entries.select("node", "vec_id", "n").join(labels, "node", "left").join(counts, "node", "left")
    named = named.select("node", "vec_id", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of_node = broadcast_if_light(materialise(named.join(least, "component").select("node", "n_links", "component_id")))
    wide = rows.join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return wide.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x,
        embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
    FROM embeddings),
u AS (SELECT r, vec_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS x FROM v WHERE good),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND list_inner_product(a.x, b.x) >= 0.95),
c(r, reach) AS (SELECT r, r FROM u UNION SELECT c.r, p.b FROM c JOIN p ON c.reach = p.a),
m AS (SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.reach GROUP BY c.r),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(m.component_id, vec_id) AS component_id, vec_id = coalesce(m.component_id, vec_id) AS kept
FROM v LEFT JOIN k ON v.r = k.a LEFT JOIN m ON v.r = m.r
"""
