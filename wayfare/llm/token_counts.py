"""Token counts that follow edits.

A document's pre-tokens (the stretches that byte-pair merging never crosses) are cut into leaves of a few dozen; a
segment tree keeps for each node the code points and tokens below it. An edit finds its leaves by the code points,
splits the text again from a boundary that the edit can't have moved until a new boundary meets an old leaf's, encodes
only that stretch, and updates the sums above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import CACHES, read, slices, tidied
from wayfare.llm.tokens import default_path, specials, tokenizer

#: Pre-tokens in a leaf.
LEAF = 64
#: Code points behind a boundary on which the boundary depends, beside the longest added token: an edit further on leaves it where it is.
LOOK = 3
#: Bytes of pre-tokens and counts that a worker remembers, about, and what each takes beside its own; the memory starts anew beyond it.
REMEMBERED, ENTRY = 64 << 20, 110
#: Characters beyond which a pre-token is not remembered.
LONG = 64

EDIT = "struct<start:int,length:int,text:string>"

_patterns: list[regex.Pattern] = []
_memories: dict[str, dict[str, int]] = {}
_held: dict[str, int] = {}
_marks: dict[str, regex.Pattern | None] = {}
CACHES.setdefault("tokens", []).extend([_memories, _held])


def pattern() -> regex.Pattern:
    if not _patterns:
        import public_tokenizers

        _patterns.append(regex.compile(public_tokenizers.PATTERN))
    return _patterns[0]


def marks(path: str) -> regex.Pattern | None:
    """The added tokens of the file, which are cut out before the pattern applies; None if there are none."""
    if path not in _marks:
        found = sorted(specials(path), key=len, reverse=True)
        _marks[path] = regex.compile("|".join(map(regex.escape, found))) if found else None
    return _marks[path]


def pretokens(text: str, path: str, begin: int = 0) -> Iterator[tuple[int, str]]:
    """Place and text of each pre-token from `begin` on, which must be a boundary."""
    while True:
        m = marks(path).search(text, begin) if marks(path) else None
        for t in pattern().finditer(text, begin, m.start() if m else len(text)):
            yield t.start(), t[0]
        if not m:
            return
        yield m.start(), m[0]
        begin = m.end()


def counts(tokens: list[str], path: str) -> list[int]:
    """Tokens of each pre-token."""
    memory = _memories.setdefault(path, {})
    if _held.get(path, 0) > REMEMBERED:
        memory.clear()
        _held[path] = 0
    new = [t for t in set(tokens) if t not in memory]
    if new:
        for t, found in zip(new, tokenizer(path).encode_batch(new, add_special_tokens=False), strict=True):
            memory[t] = len(found.ids)
    out = [memory[t] for t in tokens]
    for t in new:
        if len(t) > LONG:
            del memory[t]
        else:
            _held[path] = _held.get(path, 0) + ENTRY + len(t)
    return out


def leaves(tokens: list[str], path: str, size: int = LEAF) -> list[tuple[int, int]]:
    """(code points, tokens) of each leaf."""
    n = counts(tokens, path)
    return [(sum(map(len, tokens[i : i + size])), sum(n[i : i + size])) for i in range(0, len(tokens), size)]


class Tree:
    """Sums over leaves in heap order: node 1 is the root, node i has the children 2i and 2i + 1."""

    def __init__(self, parts: list[tuple[int, int]]):
        self.build(parts)

    def build(self, parts: list[tuple[int, int]]) -> None:
        self.parts, self.width = parts, 1
        while self.width < len(parts):
            self.width *= 2
        blank = (0, 0)
        self.sums = [blank] * self.width + parts + [blank] * (self.width - len(parts))
        for i in range(self.width - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last one for the end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            left = self.sums[2 * i][0]
            i, start = (2 * i, start) if place - start < left else (2 * i + 1, start + left)
        leaf = i - self.width
        if leaf >= len(self.parts):
            leaf = max(0, len(self.parts) - 1)
            start = self.chars - (self.parts[leaf][0] if self.parts else 0)
        return leaf, start

    def replace(self, low: int, high: int, parts: list[tuple[int, int]]) -> None:
        """New leaves in place of those from low to high (exclusive).

        Up to as many of them update only the sums above (empty leaves make up the number); more build the tree anew.
        """
        parts = parts + [(0, 0)] * (high - low - len(parts))
        if len(parts) != high - low:
            self.build(self.parts[:low] + parts + self.parts[high:])
            return
        self.parts[low:high] = parts
        self.sums[self.width + low : self.width + high] = parts
        a, b = (self.width + low) // 2, (self.width + high - 1) // 2
        while a >= 1 and parts:
            for i in range(a, b + 1):
                self._pull(i)
            a, b = a // 2, b // 2


def plant(text: str, path: str) -> Tree:
    plain = marks(path) is None or not marks(path).search(text)
    return Tree(leaves(pattern().findall(text) if plain else [t for _, t in pretokens(text, path)], path))


def leaf_size(tokens: int, able: int) -> int:
    """Pre-tokens of a leaf that let `tokens` fit `able` leaves; LEAF where that would take leaves of over four times as many."""
    fit = -(-tokens // able) if able else LEAF
    return fit if LEAF < fit <= 4 * LEAF else LEAF


def edit(tree: Tree, text: str, start: int, length: int, put: str, path: str) -> tuple[str, int]:
    """Applies one edit to the text and its tree; gives the new text and how many pre-tokens were encoded again."""
    start = min(max(0, start), len(text))
    length = min(max(0, length), len(text) - start)
    new = text[:start] + put + text[start + length :]
    moved = len(put) - length
    look = LOOK + max(map(len, specials(path)), default=0)
    low, begin = tree.leaf_at(max(0, start - look))
    high, bound = low, begin  # leaves from low up to high are replaced; bound is where leaf `high` starts
    while high < len(tree.parts) and bound < start + length:
        bound += tree.parts[high][0]
        high += 1
    tokens = []
    for place, token in pretokens(new, path, begin):
        at = place - moved
        while high < len(tree.parts) and bound < at:
            bound += tree.parts[high][0]
            high += 1
        if at == bound and place >= start + len(put) and high < len(tree.parts):
            break
        tokens.append(token)
    else:
        high = len(tree.parts)
    tree.replace(low, high, leaves(tokens, path, leaf_size(len(tokens), high - low)))
    return new, len(tokens)


LEAVES = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def plant_trees(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with leaves: the code points and tokens of each leaf, all that a tree is built of again.

    Kept beside the texts, they spare later edits the encoding of what these don't touch. Null text has no leaves.
    """
    rest = [c for c in docs.columns if c != "leaves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = [[{"chars": c, "tokens": t} for c, t in plant(text or "", path).parts] for text in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(found, LEAVES)], [*rest, "leaves"])

    return docs.select(*rest).mapInArrow(tidied(run, "tokens"), f"{_fields(docs, rest)}leaves array<struct<chars:int,tokens:int>>")


def apply_edits(planted: DataFrame, path: str, edits_col: str = "edits", text_col: str = "text") -> DataFrame:
    """planted (text, leaves, edits, ...) with the edits applied to text and leaves, and the counts before and after.

    edits: array<struct<start, length, text>> in code points, applied in turn; each counts in the text that the last
    has left. Places beyond the text are moved to its end; a null list, edit or part counts as none. Null text counts
    as empty. n_encoded: pre-tokens encoded again.
    """
    numbers = ["n_chars", "n_tokens", "n_chars_after", "n_tokens_after", "n_encoded"]
    rest = [c for c in planted.columns if c not in (text_col, edits_col, "leaves", *numbers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out = []
                for text, leaf, changes in zip(*(part.column(c).to_pylist() for c in (text_col, "leaves", edits_col)), strict=True):
                    tree, encoded, now = Tree([(x["chars"], x["tokens"]) for x in leaf or []]), 0, text or ""
                    before = (tree.chars, tree.tokens)
                    for e in changes or []:
                        if e is not None:
                            now, n = edit(tree, now, e["start"] or 0, e["length"] or 0, e["text"] or "", path)
                            encoded += n
                    out.append((*before, tree.chars, tree.tokens, encoded, now, [{"chars": c, "tokens": t} for c, t in tree.parts]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), pa.array(cols[6], LEAVES)],
                    [*rest, *numbers, text_col, "leaves"],
                )

    longs = "".join(f"{c} long, " for c in numbers)
    return planted.select(*rest, text_col, "leaves", edits_col).mapInArrow(tidied(run, "tokens"), f"{_fields(planted, rest)}{longs}`{text_col}` string, leaves array<struct<chars:int,tokens:int>>")


def count_tokens(docs: DataFrame, path: str, edits: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens, and after the edits: n_chars_after, n_tokens_after, n_encoded, text_after.

    Trees are planted and the edits applied to them, as plant_trees and apply_edits say. A text is held whole, however
    long, with the list of its pre-tokens. Rows that repeat give rows that repeat; an empty table gives none; further
    columns are not read.
    """
    changes = (F.col(edits) if isinstance(edits, str) else edits).cast(f"array<{EDIT}>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), changes.alias("edits"))
    return apply_edits(plant_trees(rows, path), path).withColumnRenamed("text", "text_after").drop("leaves")


def hashed_edit(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """One edit for each document: up to 15 code points at a hashed place give way to a hashed word."""
    key = F.xxhash64(id_col)
    start = F.pmod(key, F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("int")
    length = F.pmod(F.shiftright(key, 20), F.lit(16)).cast("int")
    word = F.element_at(F.array(*map(F.lit, ("", " ", "'s", "naïve", "\n\n", "<MAIL>", " 2024", "x"))), (F.pmod(F.shiftright(key, 40), F.lit(8)) + 1).cast("int"))
    return F.array(F.struct(start.alias("start"), length.alias("length"), word.alias("text")))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return count_tokens(docs, default_path(), hashed_edit()).drop("text_after")
