"""Fill-in-middle transformation of whole texts, cut between units (lines, words or code points).

A batch is looked at as the UTF-8 bytes of its texts end to end. A table gives each byte its class; the classes of two
adjacent bytes say whether a unit ends between them; cumulative sums, started anew at each document, number the units;
one binary search finds the cuts of all rows. Where to cut comes from a seeded digest of the id, so a retried task
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import read, slices, string_buffers, tidied

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50

OTHER, LINE_END, BLANK, INNER = range(4)
#: The class of each byte: line end, other white space, second and further bytes of a code point, all others.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[10] = LINE_END
CLASS[[9, 11, 12, 13, 32]] = BLANK
CLASS[0x80:0xC0] = INNER


def _pairs(ends) -> np.ndarray:
    """Whether a unit ends between bytes of two classes, at 4 x the first class + the second."""
    return np.array([bool(ends(a, b)) for a in range(4) for b in range(4)])


#: A line takes its line end, a word the white space behind it.
UNITS = {
    "line": _pairs(lambda a, b: a == LINE_END),
    "word": _pairs(lambda a, b: a in (LINE_END, BLANK) and b not in (LINE_END, BLANK)),
    "char": _pairs(lambda a, b: b != INNER),
}


def checked(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The marks as bytes. The code point that one begins with must stand nowhere else in them, or outputs could be read in two ways."""
    first = {m[:1] for m in marks}
    if len(set(marks)) != 3 or "" in marks or any(c in m[1:] for m in marks for c in first) or any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError("marks must differ, begin each with a code point that stands nowhere else in them, and not begin with each other")
    return tuple(m.encode() for m in marks)


def find(raw: np.ndarray, at: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a mark inside documents, and the documents."""
    place = np.flatnonzero(raw == mark[0])
    place = place[place + len(mark) <= len(raw)]
    for j in range(1, len(mark)):
        place = place[raw[place + j] == mark[j]]
    doc = np.searchsorted(at, place, "right") - 1
    inside = place + len(mark) <= at[doc + 1]
    return place[inside], doc[inside]


def cuts(raw: np.ndarray, at: np.ndarray, unit: str, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document: units, where the prefix and the middle end (bytes), and the code points of both."""
    kind = CLASS[raw]
    ends = np.zeros(len(raw), bool)
    ends[:-1] = UNITS[unit][(kind[:-1] << 2) | kind[1:]]
    ends[at[1:][at[1:] > at[:-1]] - 1] = True  # the last byte of a document ends its last unit
    size = np.int32 if len(raw) < 1 << 31 else np.int64
    done = np.cumsum(ends, dtype=size)
    before = lambda sums, place: np.where(place > 0, sums[np.maximum(place - 1, 0)], 0).astype(np.int64) if len(sums) else np.zeros(len(place), np.int64)
    base = before(done, at[:-1])
    n = before(done, at[1:]) - base
    ks = [draw % (n + 1) for draw in draws]
    low, high = (np.where(k > 0, np.searchsorted(done, base + k, "left") + 1, at[:-1]) for k in (np.minimum(*ks), np.maximum(*ks)))
    points = np.cumsum(kind != INNER, dtype=size)
    begin, p, m = (before(points, x) for x in (at[:-1], low, high))
    return n, low, high, p - begin, m - p


def strings(parts: list, lengths: np.ndarray) -> pa.Array:
    """A string column from pieces of bytes in order, and the bytes of each row."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at), pa.py_buffer(b"".join(parts))).cast(pa.string())


def transform(column: pa.Array, h: list[np.ndarray], unit: str, marks: tuple[bytes, bytes, bytes], rate: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch's texts."""
    raw, at = string_buffers(column)
    n, low, high, prefix, middle = cuts(raw, at, unit, (h[0], h[1]))
    plain = (at[1:] == at[:-1]) | (h[2] % 100 >= rate)
    for mark in marks:
        plain[find(raw, at, mark)[1]] = True
    turned = h[3] % 100 < spm
    p, s, m = marks
    data, parts = memoryview(raw), []
    for a, i, j, b, whole, spm_row in zip(at[:-1].tolist(), low.tolist(), high.tolist(), at[1:].tolist(), plain.tolist(), turned.tolist(), strict=True):
        if whole:
            parts.append(data[a:b])
        elif spm_row:
            parts += (s, data[j:b], p, data[a:i], m, data[i:j])
        else:
            parts += (p, data[a:i], s, data[j:b], m, data[i:j])
    lengths = at[1:] - at[:-1] + np.where(plain, 0, len(p) + len(s) + len(m))
    form = pa.array(np.where(plain, "plain", np.where(turned, "spm", "psm")), pa.string())
    return [pa.array(n, pa.int64()), form, pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), strings(parts, lengths)]


def rebuilt(output: pa.Array, form: np.ndarray, marks: tuple[bytes, bytes, bytes]) -> pa.Array:
    """The texts that outputs of these forms were made of."""
    raw, at = string_buffers(output)
    made = form != "plain"
    places = []
    for mark in marks:
        place, doc = find(raw, at, mark)
        own = np.zeros(len(form), np.int64)
        own[doc] = place
        if (np.bincount(doc, minlength=len(form))[made] != 1).any():
            raise ValueError("an output must hold each mark once")
        places.append(own)
    size = [len(m) for m in marks]
    data, parts = memoryview(raw), []
    for a, b, kind, p, s, m in zip(at[:-1].tolist(), at[1:].tolist(), form.tolist(), *(x.tolist() for x in places), strict=True):
        if kind == "plain":
            parts.append(data[a:b])
        elif kind == "spm":
            parts += (data[p + size[0] : m], data[m + size[2] : b], data[s + size[1] : p])
        else:
            parts += (data[p + size[0] : s], data[m + size[2] : b], data[s + size[1] : m])
    return strings(parts, at[1:] - at[:-1] - np.where(made, sum(size), 0))


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the digest of seed and id, as unsigned integers; a null id counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    `rate` percent of the documents are transformed, `spm` percent of these with the suffix first. Null text counts as
    empty; empty texts and those that hold a mark stay plain. Rows that share an id are cut by the same draws, each in
    its own units; rows that repeat give rows that repeat. A text is held whole with about a dozen bytes for each of
    its own, however long. An empty table gives none; further columns are not read.
    """
    found, kind = checked(marks), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h = [part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
                out = transform(part.column("text"), h, unit, found, rate, spm)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *draws(id_col, seed))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All columns of `transformed` (output, form, ...) with restored, the exact text, built from these two alone."""
    found, rest = checked(marks), [c for c in transformed.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                text = rebuilt(part.column("output"), part.column("form").to_numpy(zero_copy_only=False), found)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), text], [*rest, "restored"])

    schema = "".join(f"`{c}` {transformed.schema[c].dataType.simpleString()}, " for c in rest)
    return transformed.select(*rest).mapInArrow(tidied(run), f"{schema}restored string")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    k AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high FROM u),
    p AS (SELECT doc_id, text, n, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
