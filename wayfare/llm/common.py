"""Shared helpers of the training-data operators: shared-folder tables, size checks, vectorised word kernels."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import ARROW_ROWS, BROADCAST_BYTES, broadcast_if_light, materialise, shared_dir  # noqa: F401 - for the operators

#: Bytes of text that a kernel looks at together.
CHUNK_BYTES = 1 << 19
#: What workers remember from task to task, by kind; tasks of another kind drop it.
CACHES: dict[str, list[dict]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, unless the session has its own setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _forget(kind: str) -> None:
    for name, caches in CACHES.items():
        if name != kind:
            for cache in caches:
                cache.clear()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run, kind: str = ""):
    """A function of batches whose task starts without what other kinds of tasks remember, and gives freed memory back at its end.

    Workers live on from task to task; without this each keeps what its largest task took.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget(kind)  # by reference: a nested function's own globals would be copies in the worker
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy


def text_hash(text: Column) -> Column:
    """A 64-bit name of a text; with its id it tells the rows of a table apart. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def tell_apart(nodes: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables with another `node` for things that share a 64-bit name but not `check`, a second one.

    nodes: one row for each thing (node, check). All things of a name but one are renamed from both names.
    """
    twice = materialise(nodes.groupBy("node").agg(F.min("check").alias("least"), F.count("*").alias("things")).filter("things > 1").select("node", "least"))
    if twice.isEmpty():
        return list(tables)
    other = F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return [x.join(broadcast_if_light(twice), "node", "left").withColumn("node", other).drop("least") for x in tables]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column end to end, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about `limit` bytes of text (a longer single row stays whole)."""
    at = np.zeros(batch.num_rows + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), out=at[1:])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


#: Odd multipliers of the polynomial hashes (fixed values; any odd numbers do).
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
BYTE_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[name] = np.multiply.accumulate(table)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some documents, lower-cased: where each begins and ends, its hash, its document."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, in_word: np.ndarray):
        self.documents = len(at) - 1
        flag = in_word[raw]
        n = len(raw)
        begins = np.zeros(n + 1, bool)
        begins[at[:-1]] = True  # a document's first byte never continues a word
        begins = begins[:n]
        first = flag.copy()
        if n:
            first[1:] &= ~flag[:-1] | begins[1:]
            last = flag.copy()
            last[:-1] &= ~flag[1:] | begins[1:]
            self.start = np.flatnonzero(first)
            self.end = np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(at, self.start, "right") - 1
        #: for each document, its first word and the one behind its last
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hashes(raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + CHUNK_BYTES, "right")))
            part = LOWER[raw[low : self.end[j - 1]]].astype(np.uint64) + np.uint64(1)
            part *= _power_table("up", BYTE_BASE, len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            s, e = self.start[i:j] - low, self.end[i:j] - low
            down = _power_table("down", BYTE_BASE_INVERSE, len(part))[s]
            out[i:j] = mix((total[e] - total[s]) * down + (e - s).astype(np.uint64))
            i = j
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; what runs past a document's end has no meaning."""
        n = len(self.hash)
        out = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            out[: max(0, n - j)] = out[: max(0, n - j)] * WORD_BASE + self.hash[j:]
        return mix(out)

    def fits(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one document."""
        left = self.first[1:][self.doc] - np.arange(len(self.doc))
        return left >= k


def byte_class(allowed) -> np.ndarray:
    """A 256-entry truth table for the bytes that `allowed` accepts."""
    return np.array([bool(allowed(b)) for b in range(256)])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
