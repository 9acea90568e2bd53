"""Token alignment across two tokenizers of different kinds, and how often the corpus links their ids.

Both tokenizers cut the same bytes. The union of their token ends cuts a batch into elementary intervals; binary search
gives each interval its owner on either side, and an end that both have closes a group. Three kinds of links come from
this: tokens that end together, tokens that overlap (one link for each interval), and all pairs of a group. Id pairs
are counted over the corpus in Spark, and each document is scored by the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import BROADCAST_BYTES, CACHES, broadcast_if_light, materialise, read, slices, tidied
from wayfare.llm.tokens import ENTRY, LONG, default_path, encode, tokenizer

LINKS = ("ends", "overlaps", "products")
#: Pairs with more than this share of all links are hot: at most its inverse of them can be, so they may be broadcast.
HOT = 1 / 1000
#: Parts that the rows of a hot pair are dealt to where pairs are joined by shuffle.
SALTS = 64

#: Bytes of words and piece ids that a worker remembers, about; the memory starts anew beyond it.
REMEMBERED = 64 << 20

_pieces: dict[str, object] = {}
_memories: dict[str, dict[str, bytes]] = {}
_held: dict[str, int] = {}
_tables: dict[str, Vocabulary] = {}
_codes: dict[tuple[str, int], np.ndarray] = {}
CACHES.setdefault("tokens", []).extend([_memories, _held])


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_model(path: str):
    if path not in _pieces:
        import sentencepiece

        _pieces[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _pieces[path]


class Vocabulary:
    """The bytes of each token, end to end, and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of tokens in turn."""
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def byte_characters() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(path: str) -> Vocabulary:
    """A's entries, decoded."""
    if path not in _tables:
        found, own = tokenizer(path).get_vocab(), byte_characters()
        tokens = [b""] * (max(found.values()) + 1)
        for entry, i in found.items():
            tokens[i] = bytes(own[c] for c in entry) if all(c in own for c in entry) else entry.encode()
        _tables[path] = Vocabulary(tokens)
    return _tables[path]


def pieces(path: str) -> Vocabulary:
    """B's pieces: U+2581 is a space, <0xHH> a byte."""
    if path not in _tables:
        sp = piece_model(path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        _tables[path] = Vocabulary([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
    return _tables[path]


def piece_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, the same as the model gives for the whole text.

    No piece has a space behind another character and none a line end, so words between single spaces or line ends are
    encoded once and remembered. A text with other runs of spaces, at its ends or inside, or with U+2581, is encoded whole.
    """
    sp, memory = piece_model(path), _memories.setdefault(path, {})
    if _held.get(path, 0) > REMEMBERED:
        memory.clear()
        _held[path] = 0
    words = [None if "▁" in t or t[:1] == "\n" else t.replace("\n", " \n").split(" ") for t in texts]
    words = [None if w is None or "" in w else w for w in words]
    new = list(set().union(*(w for w in words if w is not None)).difference(memory))
    for word, ids in zip(new, sp.encode(new, num_threads=1) if new else [], strict=True):
        memory[word] = np.array(ids[1:] if word[:1] == "\n" else ids, "<u4").tobytes()  # without the space that the model adds before a line end
    known = memory.__getitem__
    out = [np.array(sp.encode(t), "<u4").tobytes() if w is None else b"".join(map(known, w)) for t, w in zip(texts, words, strict=True)]
    for word in new:
        if len(word) > LONG:
            del memory[word]
        else:
            _held[path] = _held.get(path, 0) + ENTRY + len(word) + len(memory[word])
    return out


def union_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.union1d of two ascending arrays: a stable sort merges them in linear time."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.diff(both, prepend=-1) != 0]


def _written(mark: str, size: int) -> np.ndarray:
    """Each id as text with a mark behind it."""
    if (mark, size) not in _codes:
        _codes[mark, size] = np.array([f"{i}{mark}" for i in range(size)], object)
    return _codes[mark, size]


class Side:
    """Tokens of several documents, end to end."""

    def __init__(self, ids: list[np.ndarray], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.n = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        self.sizes = vocabulary.size[self.ids]

    def bytes_of_documents(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.sizes)])
        ends = np.cumsum(self.n)
        return sums[ends] - sums[ends - self.n]

    def keep(self, good: np.ndarray) -> None:
        held = np.repeat(good, self.n)
        self.ids, self.sizes, self.n = self.ids[held], self.sizes[held], self.n[good]

    def differs(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For documents of equal length: whether the joined bytes differ from `raw` anywhere."""
        wrong = np.flatnonzero(self.vocabulary.joined(self.ids, self.sizes) != raw)
        out = np.zeros(len(ends), bool)
        out[np.searchsorted(ends, wrong, "right")] = True
        return out


def link(a: Side, b: Side, ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Groups of each document, places of the linked tokens of A and of B, and each document's groups as text.

    ends: where documents end. No token is empty, so each side's ends differ.
    """
    a_end, b_end = np.cumsum(a.sizes), np.cumsum(b.sizes)
    edges = union_of(a_end, b_end)  # each closes an elementary interval
    own_a, own_b = np.searchsorted(a_end, edges), np.searchsorted(b_end, edges)
    shared = (a_end[own_a] == edges) & (b_end[own_b] == edges)
    closing = edges[shared]
    groups = np.diff(np.searchsorted(closing, ends, "right"), prepend=0)
    # tokens of each group: up to the owner of its closing interval
    last_a, last_b = own_a[shared], own_b[shared]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    if kind == "ends":
        pairs = last_a, last_b
    elif kind == "overlaps":
        pairs = own_a, own_b
    else:
        many = n_a * n_b
        group = np.repeat(np.arange(len(many)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = (last_a - n_a + 1)[group] + place // n_b[group], (last_b - n_b + 1)[group] + place % n_b[group]
    text = np.empty(len(a.ids) + len(b.ids), object)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    at_a = np.arange(len(a.ids)) + (last_b - n_b + 1)[group_a]
    at_b = np.arange(len(b.ids)) + (last_a + 1)[group_b]
    for side, at, last, mark in ((a, at_a, last_a, "|"), (b, at_b, last_b, ";")):
        size = len(side.vocabulary.size)
        text[at] = _written(",", size)[side.ids]
        text[at[last]] = _written(mark, size)[side.ids[last]]
    bounds = np.cumsum(a.n + b.n).tolist()
    whole = text.tolist()
    return groups, *pairs, ["".join(whole[i:j])[:-1] for i, j in zip([0, *bounds], bounds)]


def counted(doc: np.ndarray, key: np.ndarray, documents: int) -> tuple[pa.Array, pa.Array]:
    """Lists of each document's different keys and of how often it has each."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    times = np.diff(at, append=len(key))
    offsets = np.zeros(documents + 1, np.int32)
    np.cumsum(np.bincount(doc[at], minlength=documents), out=offsets[1:])
    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, t))
    return lists(key[at], pa.int64()), lists(times, pa.int32())


def aligned(texts: list[str], a_path: str, b_path: str, kind: str) -> tuple[list[np.ndarray], list[str], pa.Array, pa.Array]:
    """n_a, n_b, n_groups, n_links; groups as text; the linked id pairs (A's id x 2^32 + B's) and how often, of each text."""
    some = np.flatnonzero([bool(t) for t in texts])
    said = [texts[i] for i in some]
    data = [b" " + t.encode() for t in said]
    a = Side([np.frombuffer(x, "<u4") for x in encode([" " + t for t in said], a_path, plain=True)], byte_level(a_path))
    b = Side([np.frombuffer(x, "<u4") for x in piece_ids(said, b_path)], pieces(b_path))
    size = np.array([len(x) for x in data], np.int64)
    good = (a.bytes_of_documents() == size) & (b.bytes_of_documents() == size)
    for _ in range(2):  # by length first, then byte by byte
        a.keep(good), b.keep(good)
        some, size, data = some[good], size[good], [x for x, ok in zip(data, good.tolist(), strict=True) if ok]
        ends, raw = np.cumsum(size), np.frombuffer(b"".join(data), np.uint8)
        good = ~(a.differs(raw, ends) | b.differs(raw, ends))
        if good.all():
            break
    groups, of_a, of_b, written = link(a, b, ends, kind)
    doc_a = np.repeat(some, a.n)
    doc = doc_a[of_a]
    numbers = [np.zeros(len(texts), np.int64) for _ in range(4)]
    for x, found in zip(numbers, (a.n, b.n, groups), strict=False):
        x[some] = found
    numbers[3] = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    out = [""] * len(texts)
    for i, text in zip(some.tolist(), written, strict=True):
        out[i] = text
    return numbers, out, *counted(doc, a.ids[of_a] << 32 | b.ids[of_b], len(texts))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", links: str = "ends", digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`, or its sha256), pairs and times: the linked id pairs and how often.

    A is the byte-level vocabulary of a_path on space and text, B the piece model of b_path on the text (it adds the
    space itself); strings of special tokens are plain text. A document that is null, empty or not spelled byte for
    byte by both has no tokens: zeros, '' and empty lists. Rows that repeat give rows that repeat, null ids included;
    a text is held whole with both token lists, however long; an empty table gives no rows; further columns are not read.
    """
    if links not in LINKS:
        raise ValueError(f"links must be one of {LINKS}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                numbers, groups, pairs, times = aligned([t or "" for t in part.column("text").to_pylist()], a_path, b_path, links)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(groups, pa.string()), pairs, times], ["doc_id", *NUMBERS, "groups", "pairs", "times"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = "".join(f"{n} long, " for n in NUMBERS)
    return rows.mapInArrow(tidied(run, "tokens"), f"doc_id {kind}, {longs}groups string, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n and best: how many links of the corpus hold an id pair, and whether no pair of its B id has more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    each = materialise(each)  # at most one row for each two ids
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = each.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    return each.withColumn("b_id", b_id).join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(found: DataFrame, counts: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """row, n_best, count_sum of rows with links (row, pairs, times), by the corpus-wide counts (a written table).

    Counts of up to `limit` bytes are broadcast. Beyond that both sides meet by pair; the few pairs that hold more
    than HOT of all links are dealt to SALTS parts each.
    """
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    light = broadcast_if_light(counts, limit)
    if light is not counts:
        both = links.join(light, "pair")
    else:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
        hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") > HOT * F.col("total")).select("pair", F.lit(SALTS).alias("parts"))  # 1 / HOT rows at most
        dealt = lambda df: df.join(F.broadcast(hot), "pair", "left")
        salted = dealt(links).withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0))
        spread = dealt(counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        both = salted.drop("parts").join(spread.drop("parts"), ["pair", "salt"])
    return both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document, as `align` says.

    n_best: links whose count over the corpus is the highest of their B id; count_sum: the counts of all links.
    """
    found = align(docs, a_path, b_path, id_col, text_col, links, digest=True)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()))
    scores = score(found, materialise(pair_counts(found)), limit)
    whole = found.drop("pairs", "times").join(scores, "row", "left").fillna(0, ["n_best", "count_sum"])
    return whole.select("doc_id", *NUMBERS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_corpus(read(spark, sf_dir, "documents"), default_path(), piece_path())
