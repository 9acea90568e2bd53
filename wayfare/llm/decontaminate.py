"""Benchmark decontamination by winnowing.

Every text is lower-cased (A-Z) and cut into words. Of the hashes of all K-word grams, winnowing keeps the least in
each run of W consecutive ones. Any two texts that share K + W - 1 = 10 consecutive words keep a common fingerprint
there, so the join of document and benchmark fingerprints finds the place of every common window. Around each hit the
windows of the document are named (two 64-bit hashes) and joined with the windows of the items, an index that all
documents share; no item's text is sent to a document. Items of fewer than ten words are one window each: for their
few lengths (below ten) every gram is kept, which is the same guarantee with a run of one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import broadcast_if_light, byte_class, materialise, mix, read, signed, slices, string_buffers, text_hash, tidied, WORD_BASE, Words

WINDOW = 10
K = 5
W = WINDOW - K + 1

IN_WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def winnow(words: Words) -> np.ndarray:
    """Where the kept grams begin: the least of each W consecutive grams, the last of equal ones."""
    n = len(words.hash) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    gram = words.grams(K)
    least, at = gram[:n].copy(), np.arange(n)
    for j in range(1, W):
        other = gram[j : j + n]
        better = other <= least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + j
    kept = np.zeros(len(gram), bool)
    kept[at[words.fits(WINDOW)[:n]]] = True
    return np.flatnonzero(kept)


def fingerprints(batch: pa.RecordBatch, short: list[int]) -> pa.RecordBatch:
    """Distinct (key, fingerprint) of a batch (key, text); `short`: the lengths of which every gram counts."""
    words = Words(*string_buffers(batch.column("text")), IN_WORD)
    at = winnow(words)
    doc, value = [words.doc[at]], [words.grams(K)[at]]
    for length in short:
        whole = words.fits(length)
        doc.append(words.doc[whole])
        value.append(words.grams(length)[whole])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    key = batch.column("key").take(pa.array(doc[new]))
    return pa.RecordBatch.from_arrays([key, signed(value[new])], ["key", "fingerprint"])


def _fingerprint_rows(texts: DataFrame, short: list[int]) -> DataFrame:
    """texts (key, text) to (key, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield fingerprints(part, short)

    return texts.mapInArrow(tidied(run), f"key {texts.schema['key'].dataType.simpleString()}, fingerprint long")


def item_lengths(items: DataFrame) -> list[int]:
    """The lengths in words of the items below WINDOW words: nine values at most."""
    cut = F.translate("text", "".join(map(chr, LOWER)), "".join(map(chr, LOWER.values())))
    n = F.size(F.regexp_extract_all(F.coalesce(cut, F.lit("")), F.lit(WORD.pattern), F.lit(0)))
    rows = items.select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()
    return sorted(r["n"] for r in rows)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def windows_of(words: list[str]) -> list[tuple[str, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))]


def extend(text: str | None, items: list[dict]) -> tuple[int, int, list[str]]:
    """Words of a text, how many of them lie in a window of the items, and the items with such windows."""
    words = words_of(text)
    lookup: dict[tuple[str, ...], set[str]] = {}
    for item in items:
        for window in windows_of(words_of(item["text"])):
            lookup.setdefault(window, set()).add(item["id"])
    hit, found = bytearray(len(words)), set()
    for length in {len(w) for w in lookup}:
        for i in range(len(words) - length + 1):
            if (ids := lookup.get(tuple(words[i : i + length]))) is not None:
                hit[i : i + length] = b"\1" * length
                found |= ids
    return len(words), sum(hit), sorted(found)


def second_name(words: Words, k: int) -> np.ndarray:
    """A hash of the k words from each word on that has nothing to do with `Words.grams`."""
    n = len(words.hash)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out[: max(0, n - j)] = mix(out[: max(0, n - j)] ^ words.hash[j:]) * WORD_BASE
    return out


def item_windows(items: DataFrame) -> DataFrame:
    """items (key, text) to their windows: item, size (words), a and b (names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*string_buffers(part.column("text")), IN_WORD)
                n = np.diff(words.first)
                for size in sorted({min(WINDOW, x) for x in n.tolist()} - {0}):
                    at = np.flatnonzero(words.fits(size) & ((n[words.doc] == size) | (size == WINDOW)))
                    key = part.column("key").take(pa.array(words.doc[at]))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(at), size, np.int32)), signed(words.grams(size)[at]), signed(second_name(words, size)[at])], ["item", "size", "a", "b"])

    return items.mapInArrow(tidied(run), "item string, size int, a long, b long").distinct()


def windows_at(words: Words, hits: list[np.ndarray | None], short: list[int]) -> tuple[np.ndarray, ...]:
    """Document, first word (of all words), size and names of the windows around the hits of each document."""
    kept, found = winnow(words), []
    wanted = np.array([x is not None for x in hits], bool)
    grams = words.grams(K)

    def among(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Which of the places hold a gram that is a hit of their own document."""
        at = at[wanted[words.doc[at]]]
        doc = words.doc[at]
        bounds = np.searchsorted(doc, np.arange(words.documents + 1))
        parts = [at[a:b][np.isin(value[at[a:b]], hits[i])] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        return np.concatenate(parts) if parts else at

    at = among(kept, grams)
    starts = np.unique((at[:, None] - np.arange(W)[None, :]).ravel())
    starts = starts[starts >= 0]
    found.append((starts[words.fits(WINDOW)[starts]], WINDOW))
    for size in short:
        found.append((among(np.flatnonzero(words.fits(size)), words.grams(size)), size))
    start = np.concatenate([x for x, _ in found])
    size = np.repeat([n for _, n in found], [len(x) for x, _ in found])
    a, b = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for n in {n for _, n in found}:
        a[size == n], b[size == n] = words.grams(n)[start[size == n]], second_name(words, n)[start[size == n]]
    return words.doc[start], start, size, a, b


def _looked_at(texts: DataFrame, short: list[int]) -> DataFrame:
    """texts (doc_id, text_hash, text, hits) to doc_id, text_hash, n_words and the windows around its hits."""
    window = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*string_buffers(part.column("text")), IN_WORD)
                has = part.column("hits").is_valid().to_numpy(zero_copy_only=False)
                hits = [np.array(part.column("hits")[i].as_py(), np.int64).view(np.uint64) if h else None for i, h in enumerate(has)]
                doc, start, size, a, b = windows_at(words, hits, short) if has.any() else (np.zeros(0, np.int64),) * 5
                order = np.argsort(doc, kind="stable")
                fields = [pa.array((start - words.first[doc])[order], pa.int32()), pa.array(size[order], pa.int32()), signed(a[order].astype(np.uint64)), signed(b[order].astype(np.uint64))]
                ends = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(window)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(words.first)), lists], ["doc_id", "text_hash", "n_words", "windows"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidied(run), f"doc_id {kind}, text_hash long, n_words long, windows array<struct<start:int,size:int,a:long,b:long>>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For each document the benchmark items that share a ten-word window (or a whole shorter item) with it.

    Returns doc_id, text_hash, n_words, n_hit, items (sorted ids as strings). Null and empty texts have no words and no
    hits; items without words are in no document; repeated items count once, by id; items without an id count as one
    item, which the list writes as an empty string; documents that repeat an id each get the result of their own text,
    told apart by text_hash. Texts are looked at whole, about a megabyte of them at a time (a longer one alone). Empty
    tables give no rows or no hits. Further columns are not read.
    """
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("key"), "text").filter(F.col("text").isNotNull())
    short = item_lengths(items)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    wanted = materialise(_fingerprint_rows(items, short).select("fingerprint").distinct())
    prints = _fingerprint_rows(docs.select(F.col("text_hash").alias("key"), "text"), short)
    hits = prints.join(broadcast_if_light(wanted), "fingerprint").groupBy("key").agg(F.collect_set("fingerprint").alias("hits"))
    hits = broadcast_if_light(materialise(hits))  # only texts with a common fingerprint have a row
    looked = materialise(_looked_at(docs.join(hits, docs.text_hash == hits.key, "left").select("doc_id", "text_hash", "text", "hits"), short))
    index = materialise(item_windows(items))
    names = ["size", "a", "b"]
    near = looked.filter(F.size("windows") > 0).select("doc_id", "text_hash", F.explode("windows").alias("w")).select("doc_id", "text_hash", "w.*").distinct()
    met = materialise(near.join(broadcast_if_light(materialise(index.select(*names).distinct())), names))
    spans = met.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    state = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))

    def step(done, x):
        to = F.greatest(done["to"], x["end"])
        return F.struct(to.alias("to"), (done["n"] + to - F.least(to, F.greatest(done["to"], x["start"]))).alias("n"))

    covered = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.aggregate("spans", state, step, lambda done: done["n"]).cast("long").alias("n_hit"))
    named = met.select("doc_id", "text_hash", *names).distinct().join(broadcast_if_light(index), names).select("doc_id", "text_hash", "item").distinct()
    named = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = lambda x, y: x.doc_id.eqNullSafe(y["_id"]) & (x.text_hash == y["_hash"])
    both = materialise(named.join(covered, same(named, covered)).select("_id", "_hash", "n_hit", "items"))
    rows = looked.join(broadcast_if_light(both), same(looked, both), "left")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The registered query's rows by comparing all windows, for small fixtures."""
    every = [{"id": "" if i is None else str(i), "text": t} for i, t in items if t is not None]
    out = []
    for doc_id, text in docs:
        n, hit, found = extend(text, every)
        out.append((doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    return out


OP9_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS n, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
bw AS (
    SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
    SELECT n, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT n, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hw AS (SELECT n, count(DISTINCT j) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS j FROM h) GROUP BY n),
hi AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM h) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (n) LEFT JOIN hi USING (n)
"""
