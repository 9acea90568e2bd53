"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of `documents`. Every stage survives nulls, empty texts, repeated rows, empty tables and further columns: what it
doesn't read passes through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate as leaks
from wayfare.llm import language_id, minhash, packing, secret_scan
from wayfare.llm.common import broadcast_if_light, materialise, read, text_hash
from wayfare.llm.tokens import default_path


def _split(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` that are (left_semi) or are not (left_anti) among `rows` (wanted, said), by id and text hash; null counts as an id."""
    same = docs.doc_id.eqNullSafe(rows.wanted) & (text_hash(docs.text) == rows.said)
    return docs.join(broadcast_if_light(rows), same, how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that are far from every language profile (`language_id.least_scores`)."""
    judged = language_id.identify(docs.select("doc_id", "text", "lang"), language_id.train(docs))
    judged = materialise(judged.select(F.col("doc_id").alias("wanted"), text_hash(F.col("text")).alias("said"), "lang", "lang_pred", "score"))
    least = F.lit(language_id.LEAST_SCORE)
    for lang, score in language_id.least_scores(judged).items():
        least = F.when(F.col("lang_pred") == lang, score).otherwise(least)
    good = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least)
    bad = judged.filter(~good).select("wanted", "said")
    return _split(docs, materialise(bad.distinct()), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates, that of least id, and of its repeated rows one.

    Rows that repeat an id (null counts as one) are judged by their own texts. Where linked texts share the least id,
    that of least hash stays; rows are dropped as repeated only if id and text are the same.
    """
    found = minhash.near_duplicates(docs).select(F.col("doc_id").alias("wanted"), F.col("text_hash").alias("said"), "component", "kept")
    judged = materialise(found.groupBy("wanted", "said", "component", "kept").agg(F.count("*").alias("n")))
    heads = judged.filter("kept AND component IS NOT NULL").groupBy("component").agg(F.min("said").alias("head"), F.count("*").alias("texts"))
    heads = materialise(heads.filter("texts > 1").select("component", "head"))
    beside = judged.filter("kept").join(broadcast_if_light(heads), "component").filter("said <> head")
    bad = materialise(judged.filter("NOT kept").select("wanted", "said").union(beside.select("wanted", "said")).distinct())
    kept = _split(docs, bad, "left_anti")
    again = materialise(judged.filter("n > 1").select("wanted", "said"))
    if again.isEmpty():
        return kept
    return _split(kept, again, "left_anti").union(_split(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that shares a ten-word window (or a whole shorter item) with the benchmark."""
    found = leaks.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("wanted"), F.col("text_hash").alias("said"))
    return _split(docs, materialise(hit.distinct()), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs, secret_scan.secret_scan(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, default_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", pack),
]

#: Profiles, shingle sets of words and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
