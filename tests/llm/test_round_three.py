"""Fill-in-middle, token alignment and token files against brute force, exact round trips and odd tables."""

import bisect
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfare.llm import fill_in_middle, token_alignment, token_frames, tokens

SF = "/root/testdata/sf0.001"
PATH, PIECES = tokens.default_path(), token_alignment.piece_path()
LONG = "Ein langer Text, at length — über alles. " * 20000
ODD = ["", None, " ", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\r\nü 日本\n\n語", "has <P> inside\nx", "<S>\n<M>", "<P", "x<\nP>y", "  two  spaces \n end ", "<|endoftext|> and </s> are text", "tab\there", "under▁score", "ﬁ ｘ", "\x00\x7f", "🙂\n🙃 " * 9, LONG]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, texts):
    """Rows with ids, repeated and null ones among them, over a few partitions, with columns of clashing names."""
    docs = [(i if i % 5 else None if i % 2 else 7, t, 1, "x") for i, t in enumerate(texts)] + [(3, "again\nand again\n", 1, "x")] * 3
    return docs, spark.createDataFrame(docs, "doc_id long, text string, n int, output string").repartition(3)


def source(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# 11 fill-in-middle


def fim(doc_id, text, seed=7, spm=50, rate=100, marks=("<P>", "<S>", "<M>"), unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(unit, text, re.S)
    assert "".join(units) == text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    P, S, M = marks
    turned = h[3] % 100 < spm
    return doc_id, len(units), "spm" if turned else "psm", len(p), len(m), S + s + P + p + M + m if turned else P + p + S + s + M + m


def test_fim_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*f[:5], sha(f[5]), sha(t or "")) for i, t in source(spark) for f in [fim(i, t)]]
    assert rows(fill_in_middle.op11_fill_in_middle(spark, SF)) == sorted(want, key=str)


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+"), ("char", r".")])
def test_fim_odd_rows(spark, unit, pattern):
    docs, df = table(spark, ODD)
    out = fill_in_middle.fill_in_middle(df, unit=unit)
    assert rows(out) == sorted((fim(i, t, unit=pattern) for i, t, *_ in docs), key=str)
    assert sorted(r.restored for r in fill_in_middle.restore(out).collect()) == sorted(t or "" for _, t, *_ in docs)


def test_fim_settings(spark):
    docs, df = table(spark, ODD)
    marks = ("⟨pre⟩", "«s»", "[m]")
    out = fill_in_middle.fill_in_middle(df, marks=marks, seed=1, rate=60, spm=20)
    assert rows(out) == sorted((fim(i, t, 1, 20, 60, marks) for i, t, *_ in docs), key=str)
    assert sorted(r.restored for r in fill_in_middle.restore(out, marks).collect()) == sorted(t or "" for _, t, *_ in docs)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P<", "a", "b"), ("ab", "a", "c")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(df, marks=bad)


# 12 token alignment


PLAIN = Tokenizer.from_file(PATH)
LITERAL = Tokenizer.from_file(PATH)
LITERAL.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def align(text, kind="ends"):
    """n_a, n_b, groups (lists of ids of both), linked id pairs, by walking over the bytes."""
    if not text:
        return 0, 0, [], []
    t, sp = LITERAL, SP
    own = token_alignment.byte_characters()
    a = [(i, bytes(own[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    names = [(i, sp.id_to_piece(i)) for i in sp.encode(text)]
    b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in names]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return 0, 0, [], []
    spans = []
    for side in (a, b):
        at, found = 0, []
        for i, x in side:
            found.append((i, at, at + len(x)))
            at += len(x)
        spans.append(found)
    shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = [[[], []] for _ in shared]
    for k, side in enumerate(spans):
        for i, _, end in side:
            groups[bisect.bisect_left(shared, end)][k].append(i)
    if kind == "products":
        pairs = [(x, y) for ga, gb in groups for x in ga for y in gb]
    elif kind == "overlaps":
        of = [[i for i, s, e in side for _ in range(s, e)] for side in spans]  # the token of each byte
        cuts = sorted({s for side in spans for _, s, _ in side})
        pairs = [(of[0][c], of[1][c]) for c in cuts]
    else:
        ends = {e: y for y, _, e in spans[1]}
        pairs = [(x, ends[e]) for x, _, e in spans[0] if e in ends]
    return len(a), len(b), groups, pairs


def scored(docs, kind="ends"):
    found = [(i, align(t, kind)) for i, t in docs]
    counts = Counter(p for _, (*_, pairs) in found for p in pairs)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    for i, (a, b, groups, pairs) in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield i, a, b, len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest


def test_alignment_query(spark):
    docs = [(i, t) for i, t in source(spark) if not t or len(t) < 20_000]
    got = token_alignment.align_corpus(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH, PIECES)
    assert got.columns == token_alignment.op12_token_alignment(spark, SF).columns
    assert rows(got) == sorted(scored(docs), key=str)


@pytest.mark.parametrize("kind", token_alignment.LINKS)
@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_alignment_odd_rows(spark, kind, limit, monkeypatch):
    """The counts broadcast and joined by shuffle, where the few frequent pairs are dealt to several tasks."""
    monkeypatch.setattr(token_alignment, "HOT", 1 / 20)
    docs, df = table(spark, ODD[:-1] + ["the cat sat on the mat\n" * 5] * 8)
    got = token_alignment.align_corpus(df, PATH, PIECES, kind, limit=limit)
    assert rows(got) == sorted(scored([d[:2] for d in docs], kind), key=str)


def test_alignment_long_text():
    """One text of many words equals its walk, and cuts of batches do not matter."""
    text = LONG[:60_000]
    numbers, groups, pairs, times = token_alignment.aligned(["x", text, "", "y z"], PATH, PIECES, "ends")
    a, b, want, links = align(text)
    assert [int(n[1]) for n in numbers] == [a, b, len(want), len(links)] and groups[1] == ";".join("|".join(",".join(map(str, side)) for side in g) for g in want)
    assert dict(zip(pairs[1].as_py(), times[1].as_py())) == Counter(x << 32 | y for x, y in links)


def test_vocabularies_spell_bytes():
    t, sp = LITERAL, SP
    text = "Grüße, 日本語 <x> 🙂 \t end"
    a = np.array(t.encode(text, add_special_tokens=False).ids)
    v = token_alignment.byte_level(PATH)
    assert v.joined(a, v.size[a]).tobytes().decode() == text
    b = np.array(sp.encode(text))
    w = token_alignment.pieces(PIECES)
    assert w.joined(b, w.size[b]).tobytes().decode() == " " + text
    assert (v.size > 0).all() and (w.size > 0).all()


# 13 token files


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_query(spark):
    start, want = 0, []
    for i, t in sorted(source(spark)):
        ids = plain_ids(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_frames.op13_token_frames(spark, SF)) == sorted(want, key=str)


def test_token_files_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls first, then ids in order; every document whole, one after the other, whatever its files and frames."""
    monkeypatch.setattr(token_frames, "FRAME", 4096)
    docs, df = table(spark, ODD)
    index = token_frames.write_tokens(df, PATH, str(tmp_path / "a"))
    got = token_frames.read_all(spark, str(tmp_path / "a")).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), plain_ids(t)) for i, t, *_ in docs)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    few = token_frames.read_documents(spark, str(tmp_path / "a"), spark.createDataFrame([(3,), (20,), (99,)], "doc_id long"))
    assert sorted((r.doc_id, r.ids) for r in few.collect()) == sorted((i, plain_ids(t)) for i, t, *_ in docs if i in (3, 20))
    assert index.count() == len(docs)


def test_frames_stand_alone(tmp_path):
    """Any zstandard reader gives all ids; a reader of ours decompresses one document's frames; a broken byte is found."""
    path = str(tmp_path / "x.zst")
    ids = [np.arange(k, dtype="<u4").tobytes() for k in (5, 1, 3_000_000, 7)]
    out = token_frames.FrameWriter(open(path, "wb"), pa.string())
    out.add(pa.array(["a", None]), ids[:2])
    out.add(pa.array(["c", "d"]), ids[2:])
    out.close()
    raw = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(ids)
    reader = token_frames.FrameReader(pa.OSFile(path))
    assert reader.names.to_pylist() == ["a", None, "c", "d"] and reader.n_tokens.tolist() == [5, 1, 3_000_000, 7]
    assert reader.ids(3) == ids[3] and reader.frames_read == 1 and reader.ids(2) == ids[2] and reader.frames_read == 4
    place = int(reader.at[int(reader.first[0])]) + int(reader.packed[0]) - 2
    broken = bytearray(raw)
    broken[place] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.FrameReader(pa.BufferReader(bytes(broken))).ids(0)
    with pytest.raises(ValueError):
        token_frames.FrameReader(pa.BufferReader(raw[:-3] + b"abc"))


def test_broken_file_fails_the_read(spark, tmp_path):
    folder = tmp_path / "b"
    token_frames.write_tokens(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), PATH, str(folder))
    (name,) = [p for p in folder.iterdir() if p.suffix == ".zst"]
    raw = bytearray(name.read_bytes())
    raw[12] ^= 8
    name.write_bytes(raw)
    with pytest.raises(PythonException):
        token_frames.read_all(spark, str(folder)).collect()
