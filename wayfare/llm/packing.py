"""Best-fit packing of token pieces into sequences by a configuration linear program over the length histogram.

Tokens are counted once, piece by piece. All the solver needs is how many pieces have each length: at most LIMIT
numbers, whatever the corpus. The fractional covering program "choose configurations (multisets of lengths that fit
a sequence) so that every piece is covered" is solved by multiplicative weights: every length has a price that falls
as it is covered, a knapsack dynamic program finds the configurations of most worth at these prices (each length no
more often than it has pieces), and the solution is the average over the rounds. Each round's prices also bound every
packing from below. The average is rounded to whole configurations; what these leave is priced again and again on the
pieces that are left, and the best configurations are taken, down to the last piece. The plan is a table of slots (length, first rank, count, first sequence, offset); pieces take the slot of their rank among pieces of
their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import materialise, read, slices, tidied
from wayfare.llm.tokens import default_path, encode

LIMIT = 1024
END = 2
#: Pieces of one length that are ranked together in a task.
RANKED = 50_000
#: Rounds of multiplicative weights, and their step; documented bounds on the solver, not on the data.
ROUNDS, STEP = 24, 1.0
#: Times that the program is solved at most, each for what rounding has left, and the share of sequences for which it is solved again.
REPEATS, GAIN = 12, 0.02
#: Pieces kept from the first solutions, as short ones waste little at the end: the longest length, and the share of these.
RESERVE = (384, 0.7)
#: In the last phase a token's price rises with the length of its piece, to this power, and only configurations of pieces
#: of at least this share of the longest one left are taken before the next pricing.
RISE, AHEAD = 0.5, 0.5
SEED = 11

Config = tuple[tuple[int, int], ...]

PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """Pieces (piece, start, length, crc32) of a document's ids; the first takes what is over."""
    n = len(ids) // 4
    first = (n - 1) % limit + 1
    bounds = [0, *range(first, n + 1, limit)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32. Null text counts as empty."""
    end = np.array([END], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [cut(x + end, limit) for x in encode([t or "" for t in part.column("text").to_pylist()], path)]
                doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                flat = list(zip(*(p for x in found for p in x), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(flat[0], pa.int32()), *(pa.array(x, pa.int64()) for x in flat[1:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run, "tokens"), f"doc_id {kind}, {PIECE}")


def price(worth: np.ndarray, counts: np.ndarray, limit: int, start: np.ndarray, full: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """The most worth of a configuration, and the configurations of most worth with each length of `start`.

    worth and counts are by length (index 0 unused). A bounded knapsack: a length is offered in lots of 1, 2, 4, ...
    pieces, as many as it has or as fit, so no configuration takes more than there are. One table holds the best of
    each size at most (which bounds all packings), the other the best of exactly that size (which wastes nothing).
    Configurations are rows, by the second table if `full`, else by the first; lengths that no such configuration has give none.
    """
    lots = []
    for length in np.flatnonzero(counts)[::-1]:  # of equal worth, fewer and longer pieces
        able, lot = min(int(counts[length]), limit // int(length)), 1
        while able > 0:
            lots.append((int(length), min(lot, able)))
            able, lot = able - lot, 2 * lot
    value = np.full((2, limit + 1), -np.inf)
    value[0], value[1, 0] = 0, 0
    of = int(full)
    taken = np.zeros((len(lots), limit + 1), bool)
    for i, (length, lot) in enumerate(lots):
        size = length * lot
        other = value[:, :-size] + worth[length] * lot
        taken[i, size:] = other[of] > value[of, size:]
        np.maximum(value[:, size:], other, out=value[:, size:])
    start = start[np.isfinite(value[of, limit - start])]
    rows = np.zeros((len(start), limit + 1), np.int64)
    rows[np.arange(len(start)), start] = 1
    room = limit - start
    for i in range(len(lots) - 1, -1, -1):
        length, lot = lots[i]
        use = taken[i, room]
        if use.any():
            rows[use, length] += lot
            room = room - use * (length * lot)
    able = (rows <= counts).all(1)
    return float(value[0, limit]), rows[able], start[able]


def fractional(counts: np.ndarray, limit: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[Config, float], float]:
    """Configurations with how often to use each (fractional), and a lower bound on the sequences of any packing.

    Multiplicative weights: the price of a length's tokens is exp(-step x how many rounds its cover is ahead of an even
    share), less a charge that grows the same way, as no more pieces can be used than there are. Every round takes the
    best configuration with each length that lags, in proportion to its lag, and spreads the same number of sequences
    over them. The bound is that of linear programming: prices times pieces over the most worth of a configuration.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}, 0.0
    bound = float((lengths * counts[lengths]).sum()) / limit
    each = bound / rounds
    cover, found = np.zeros(limit + 1), {}
    for t in range(rounds):
        ahead = cover[lengths] * rounds / counts[lengths] - t
        worth = np.zeros(limit + 1)
        worth[lengths] = lengths * np.exp(-step * np.clip(ahead, -20, 20)) - np.expm1(step * np.clip(ahead, 0, 8))
        lag = np.maximum((t + 1) / rounds * counts - cover, 0)
        most, rows, start = price(worth, counts, limit, np.flatnonzero(lag))
        bound = max(bound, float((np.maximum(worth, 0) * counts).sum()) / most)
        if not len(rows):
            break
        amount = lag[start] / rows[np.arange(len(rows)), start]
        amount *= each / amount.sum()
        for row, x in zip(rows, amount.tolist(), strict=True):
            at = np.flatnonzero(row)
            config = tuple(zip(at.tolist(), row[at].tolist(), strict=True))
            found[config] = found.get(config, 0.0) + x
        cover += amount @ rows
    return found, bound


def rounded(found: dict[Config, float], left: np.ndarray, rng: np.random.Generator) -> list[tuple[Config, int]]:
    """Whole configurations from the fractional solution, as far as there are pieces; takes these from `left`.

    Whole parts first, then one more of each with the probability of its fraction.
    """
    chosen: dict[Config, int] = {}
    configs = sorted(found, reverse=True)
    whole = [int(found[c]) for c in configs]
    more = [int(u < found[c] - w) for c, w, u in zip(configs, whole, rng.random(len(configs)), strict=True)]
    for wanted in (whole, more):
        for config, times in zip(configs, wanted, strict=True):
            times = min(times, *(int(left[length] // n) for length, n in config)) if times else 0
            if times > 0:
                chosen[config] = chosen.get(config, 0) + times
                for length, n in config:
                    left[length] -= n * times
    return list(chosen.items())


def dive(left: np.ndarray, limit: int) -> tuple[list[tuple[Config, int]], int]:
    """Configurations for all pieces of `left`, and how many sequences of them pricing gave.

    The knapsack prices what is left; its best configurations with the longest pieces are taken as often as there are
    pieces, and the rest is priced again. Where none can be taken, one sequence is filled by best fit.
    """
    lengths = np.arange(limit + 1)
    worth = lengths * (lengths / limit) ** RISE
    out, given, left = [], 0, left.copy()
    while left.any():
        start = np.flatnonzero(left)[::-1]
        _, rows, start = price(worth, left, limit, start[start >= AHEAD * start[0]], full=False)
        taken = 0
        for row in rows[np.argsort(-start, kind="stable")]:
            at = np.flatnonzero(row)[::-1]
            times = int((left[at] // row[at]).min())
            if times:
                left[at] -= times * row[at]
                taken += times
                out.append((tuple(zip(at.tolist(), row[at].tolist(), strict=True)), times))
        if not taken:
            row = fill(left, limit)
            left -= row
            at = np.flatnonzero(row)[::-1]
            out.append((tuple(zip(at.tolist(), row[at].tolist(), strict=True)), 1))
        given += taken
    return out, given


def solve(pieces: np.ndarray, limit: int) -> tuple[list[tuple[Config, int]], int, float]:
    """Configurations that pack all pieces, how many sequences of them the program gave, and the lower bound.

    The program is solved for all pieces but a reserve of short ones, rounded, and solved again for what is left while
    that gives enough; then what is left, reserve included, is dived for. The same at every size of the table.
    """
    longest, share = RESERVE
    held = np.zeros(limit + 1, np.int64)
    held[: longest + 1] = np.ceil(pieces[: longest + 1] * share)
    bound = float((np.arange(limit + 1) * pieces).sum()) / limit
    left, chosen, rng = pieces - held, [], np.random.default_rng(SEED)
    for _ in range(REPEATS):
        found, least = fractional(left, limit)
        bound = max(bound, least)
        new = rounded(found, left, rng)
        chosen += new
        if sum(n for _, n in new) <= GAIN * sum(n for _, n in chosen):
            break
    rest, given = dive(left + held, limit)
    return chosen + rest, sum(n for _, n in chosen) + given, bound


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) that place every piece of the histogram."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left = counts.copy()
    chosen: list[tuple[Config, int]] = []
    if left[limit]:
        chosen.append((((limit, 1),), int(left[limit])))
        left[limit] = 0
    chosen += solve(left, limit)[0]
    slots, rank, sequence = [], np.zeros(limit + 1, np.int64), 0
    for config, times in chosen:
        offset = 0
        for length, n in config:
            for _ in range(n):
                slots.append((length, int(rank[length]), times, sequence, offset))
                rank[length] += times
                offset += length
        sequence += times
    return slots


def fill(left: np.ndarray, limit: int) -> np.ndarray:
    """One sequence by length: the longest piece left, then the longest that fits, and so on."""
    taken, room = np.zeros(limit + 1, np.int64), limit
    length = int(np.flatnonzero(left)[-1])
    while length > 0:
        taken[length] += 1
        room -= length
        able = np.flatnonzero((left - taken > 0)[: room + 1])
        length = int(able[-1]) if len(able) else 0
    return taken


def best_fit(left: np.ndarray, limit: int) -> list[tuple[Config, int]]:
    """All pieces by best fit alone, which the program is held against. Equal sequences are made together."""
    out = []
    left = left.copy()
    while left.any():
        taken = fill(left, limit)
        at = np.flatnonzero(taken)[::-1]
        times = int((left[at] // taken[at]).min())
        left[at] -= times * taken[at]
        out.append((tuple((int(x), int(taken[x])) for x in at), times))
    return out


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """`rows` with rank: the place of each piece among those of its length, without one length in one task.

    Pieces of a length are dealt to buckets by hash; the buckets' counts (a table of at most lengths x buckets rows,
    kept in Spark) give each bucket its first rank.
    """
    from pyspark.sql import Window

    buckets = max(1, -(-total // RANKED))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return dealt.join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1).drop("first", "bucket")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone; ids may be null. Rows that repeat are packed each for itself; ties
    among pieces of one length are broken by id, piece and checksum, and rows that share all of these are alike. A text
    and its ids are held whole, however long. An empty table gives no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = materialise(pieces(docs, path, id_col, text_col, limit))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `limit` rows at most
    slots = plan(histogram, limit)
    table: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in slots:
        table.setdefault(length, []).append((first, sequence, offset))
    places = {length: tuple(np.array(x, np.int64) for x in zip(*at, strict=True)) for length, at in table.items()}
    shared = spark.sparkContext.broadcast(places)  # a few slots for each length
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                firsts, sequences, offsets = shared.value[int(value)]
                slot = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at] = sequences[slot] + rank[at] - firsts[slot]
                offset[at] = offsets[slot]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked(rows, sum(histogram.values())).mapInArrow(tidied(place), f"doc_id {kind}, {PIECE}, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_path())
