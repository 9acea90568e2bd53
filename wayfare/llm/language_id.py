"""Language identification by rank-order profiles.

A profile is the K most frequent character n-grams (n = 1 to 3, within words, with word ends marked) in order. Each
language's profile is counted in Spark over labelled training documents; a document goes to the language whose
profile is nearest to its own by out-of-place distance: for each of its n-grams, how far its rank lies from the rank
in the profile, or K where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import read, slices, tidied

#: n-grams in a profile.
K = 400
#: Labelled documents of a language that training looks at, chosen by hash; the bound on the fitted sample.
TRAIN_DOCUMENTS = 20_000
#: Score below which the pipeline rejects a document in any case; see `least_scores` for the threshold learned on top.
LEAST_SCORE = 0.05
#: Share of the median score of labelled documents that a document must reach.
MARGIN = 0.5
#: Labelled rows from which a threshold is learned; profiles fit the texts of a smaller corpus too well to judge by their scores.
LEAST_ROWS = 100
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        found = [c for c in range(0x110000) if chr(c).isalpha()]
        table[found] = found
        _letters.append(table)
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, three code points of 21 bits each; 0 marks a word's end."""
    points = letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    marked = np.zeros(len(points) + 2, np.uint64)
    marked[1:-1] = points
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] != 0) | (marked[:-1] != 0)
    seq = marked[keep]
    if len(seq) < 3:
        return np.zeros(0, np.uint64)
    one = seq[seq != 0]
    two = (seq[:-1] << np.uint64(21)) | seq[1:] | np.uint64(1 << 62)
    inside = seq[1:-1] != 0
    three = ((seq[:-2] << np.uint64(42)) | (seq[1:-1] << np.uint64(21)) | seq[2:])[inside] | np.uint64(1 << 63)
    return np.concatenate([one, two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(text), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, k: int = K) -> np.ndarray:
    """The k most frequent codes in order; the smaller code first among equals."""
    return codes[np.argsort(-counts, kind="stable")[:k]]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCUMENTS, key_col: str = "doc_id", k: int = K) -> dict[str, list[int]]:
    """Profiles of the labelled documents: language to its n-gram codes in order.

    Rows with null text or null label are left out. At most about `per_language` documents of each language are
    counted, chosen by the hash of their key; where there are fewer, all are.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))))
    place = F.pmod(F.xxhash64(key_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(place < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    codes, n = counted("\n".join(texts))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    totals = sample.mapInArrow(tidied(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.shiftrightunsigned("code", 1), "code"))
    rows = totals.withColumn("rank", rank).filter(F.col("rank") <= k).orderBy("lang", "rank").collect()  # k rows a language
    profiles: dict[str, list[int]] = {}
    for r in rows:
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], k: int = K):
        self.k, self.languages = k, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(p, np.int64).view(np.uint64) for p in profiles.values()])) if profiles else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for j, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[lang], np.int64).view(np.uint64)), j] = np.arange(len(profiles[lang]))

    def distances(self, text: str) -> np.ndarray | None:
        codes, counts = counted(text)
        if not len(codes) or not len(self.languages):
            return None
        own = top(codes, counts, self.k)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)  # in no profile
        ranks = self.ranks[at]
        return np.where(ranks < 0, self.k, np.abs(ranks - np.arange(len(own))[:, None])).sum(0) / (self.k * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text else None
        if found is None:
            return UNKNOWN, 0.0
        best = int(found.argmin())
        return self.languages[best], float(1 - found[best])


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """All columns of `docs` with lang_pred and score (replacing columns of these names).

    score is 1 less the distance as a share of the greatest possible. Null texts and texts without letters are
    `und` with score 0, as is every text if there are no profiles; of languages at equal distance the first by name
    wins. Rows that repeat give rows that repeat; a text is held whole, however long; an empty table gives none.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            found = [ranker.predict(x.as_py()) for x in batch.column(text_col)]
            arrays = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *arrays], [*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(tidied(run), f"{fields}, lang_pred string, score double")


def least_scores(judged: DataFrame, margin: float = MARGIN) -> dict[str, float]:
    """For each language the score below which a text is not taken for it, learned from judged rows (lang, lang_pred, score).

    The rule: `margin` times the median score of the language's labelled rows, or of all labelled rows where that is
    less (a profile of few documents fits these too well). A median doesn't fall as rows are added, as the lowest score
    does, and some wrong labels hardly move it. Rows without label or letters are left out. Counted on scores cut to
    three places, so at most 1,001 counts a language reach the driver. With fewer than LEAST_ROWS such rows there are
    no thresholds.
    """
    known = judged.filter(F.col("lang").isNotNull() & (F.col("lang_pred") != UNKNOWN))
    counts = known.groupBy("lang", F.floor(F.col("score") * 1000).alias("score")).agg(F.count("*").alias("n")).collect()

    def median(rows: list) -> float:
        rows = sorted((r["score"], r["n"]) for r in rows)
        at = np.cumsum([n for _, n in rows])
        return rows[int(np.searchsorted(at, at[-1] / 2))][0] / 1000

    if sum(r["n"] for r in counts) < LEAST_ROWS:
        return {}
    overall = median(counts)
    return {lang: max(LEAST_SCORE, margin * min(overall, median([r for r in counts if r["lang"] == lang]))) for lang in sorted({r["lang"] for r in counts})}


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = train(docs.filter(~held_out("doc_id") & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(rows, profiles).drop("text")
