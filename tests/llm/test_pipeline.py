"""The pipeline's stages on odd rows and against brute force."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline as p
from wayfare.llm import language_id
from wayfare.llm.common import materialise

from .test_operators import jaccard_components, rows


def test_stages_on_odd_rows(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = materialise(stage(spark, docs, edge))
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.collect()]
    assert not {4, 5, 6} & set(kept["language_id"]) and 13 in kept["language_id"]
    assert kept["near_duplicates"].count(7) == 1 and 2 not in kept["near_duplicates"] and kept["near_duplicates"].count(15) <= 2
    assert not {1, 13, 14, 15, 16} & set(kept["decontaminate"]) and {11, 12} <= set(kept["decontaminate"])  # 13 holds an item without an id
    assert "hunter2hunter2" not in "".join(r.text for r in docs.collect())
    last = p.STAGES[-1][1](spark, docs, edge)
    assert {"doc_id", "piece", "sequence_id"} <= set(last.columns) and last.count() >= docs.count()


def test_empty(spark, empty):
    assert p.run(spark, empty).count() == 0


def test_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = materialise(p.language(spark, docs, folder))
    profiles = language_id.train(docs)
    ranker = language_id.Ranker(profiles)
    good = [r.doc_id for r in docs.collect() if (x := ranker.predict(r.text))[0] != "und" and x[1] >= language_id.LEAST_SCORE]
    assert sorted(r.doc_id for r in lang.collect()) == sorted(good)
    near = materialise(p.near_duplicates(spark, lang, folder))
    want = jaccard_components([(r.doc_id, r.text) for r in lang.collect()], 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    from wayfare.llm.decontaminate import brute_force

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clean = materialise(p.decontaminate(spark, near, folder))
    judged = brute_force([(r.doc_id, r.text) for r in near.collect()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in judged if not r[-1])
    secret = p.secrets(spark, clean, folder)
    assert sorted(r.doc_id for r in secret.collect()) == sorted(r.doc_id for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in secret.collect())
    assert rows(p.pack(spark, secret, folder).select("doc_id").distinct()) == rows(clean.select("doc_id"))
    assert len(list(itertools.chain(p.STAGES))) == 5


def test_ids_that_repeat(spark, tmp_path):
    """Rows are judged by id and text: a clean row survives beside copies and hits that share its id."""
    from .conftest import PARA, tables

    clean, other, third, leak = "an unlike clean text about rivers and mills", "another clean text on harbours, ferries and piers", "seven lamps burn in the old tower", "solo item"
    near = [(9, "one two three four five six seven eight nine ten eleven twelve"), (9, "ONE two three four five six seven eight nine ten eleven twelve")]
    texts = [(1, PARA * 3), (None, PARA * 3), (None, clean), (None, leak), (7, third), (7, other), (7, other), (7, PARA * 3), (8, leak), (8, other + " by night"), *near]
    docs = [(i, t, "en", "a", len(t), "k", 7, 1, 2, "w", 3) for i, t in texts]
    folder = tables(spark, tmp_path, docs, [(2, leak)], [], [])
    kept = materialise(p.near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    got = [(r.doc_id, r.text.lower() if r.doc_id == 9 else r.text) for r in kept.collect()]
    want = [(1, PARA * 3), (None, clean), (7, third), (7, other), (8, leak), (8, other + " by night"), near[0]]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = p.decontaminate(spark, kept, folder).collect()
    assert sorted((r.text.lower() for r in left)) == sorted(t.lower() for _, t in want if t != leak)


def test_clean_null_id_row_survives(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for _, stage in p.STAGES[:3]:
        docs = materialise(stage(spark, docs, edge))
    assert [r.text[:12] for r in docs.collect() if r.doc_id is None] == ["null id text"]


POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."


def test_far_texts_go(spark):
    """Gibberish of ten words or more and unlearned Latin-script languages go; no document of the corpus does."""
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9)))
    junk = [" ".join(word() for _ in range(n)) for n in (10, 30, 100, 1000) for _ in range(10)]
    junk += [" ".join("%032x" % random.getrandbits(128) for _ in range(20)), POLISH, FINNISH, POLISH * 20, FINNISH * 20]
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
        extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)], "doc_id long, text string").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text", F.lit(None).cast("string").alias("lang"))
        kept = [r.doc_id for r in p.language(spark, docs.union(extra), folder).collect()]
        assert not [i for i in kept if i < 0]
        assert sorted(kept) == sorted(r.doc_id for r in docs.collect())


def test_least_scores(spark):
    judged = [("a", "a", 0.8)] * 90 + [("a", "a", 0.01)] * 9 + [("a", "und", 0.0), (None, "a", 0.1), ("b", "b", 0.6), ("c", "c", 1.0)]
    got = language_id.least_scores(spark.createDataFrame(judged, "lang string, lang_pred string, score double"))
    assert got == {"a": 0.4, "b": 0.3, "c": 0.4}  # one wrong label moves nothing; c's single row fits its own profile too well
    assert language_id.least_scores(spark.createDataFrame(judged[:98], "lang string, lang_pred string, score double")) == {}


def test_stages_without_n_chars_and_with_long_texts(spark):
    """Tables without n_chars keep their columns through every stage; a text of half a million characters passes whole."""
    folder = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").filter("length(text) > 200")
    long = " ".join(r.text for r in some.filter("lang = 'en'").orderBy("doc_id").collect())
    long = (long * (1 + 500_000 // len(long)))[:500_000].rsplit(" ", 1)[0]
    docs = some.union(spark.createDataFrame([(-7, "unlike any other: " + long[::-1][:50] + " " + long, "en", "z")], "doc_id long, text string, lang string, source string").select(*(F.col(f.name).cast(f.dataType) for f in some.schema.fields)))
    for name, stage in p.STAGES[:2]:
        docs = materialise(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source"], name
        assert docs.filter("doc_id = -7").count() == 1, name
    docs = materialise(p.secrets(spark, docs, folder))
    assert docs.columns == ["doc_id", "text", "lang", "source"] and len(docs.filter("doc_id = -7").first().text) > 400_000
    packed = p.pack(spark, docs, folder).filter("doc_id = -7").agg(F.sum("length"), F.count("*"), F.max("length")).first()
    assert packed[1] == -(-packed[0] // 1024) and packed[2] == 1024
    clean = p.decontaminate(spark, docs, folder)
    assert clean.columns == ["doc_id", "text", "lang", "source"]

