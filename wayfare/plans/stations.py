"""Queries on matching stations with a gazetteer, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import resolve
from wayfare.plans.dialect import sql_km
from wayfare.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# stand-ins: suppliers are our stations, every tenth customer a gazetteer entry, close enough to compete
_AT = "13.7e0 + ({0} * 7919 % 6500) / 65000.0e0 AS lat, 100.5e0 + ({0} * 104729 % 6000) / 60000.0e0 AS lng"
_OWN = f"""(SELECT CAST(s_nationkey % 5 AS VARCHAR) AS line, s_suppkey AS ord, CASE WHEN s_suppkey % 6 > 0 THEN 'stop ' || s_suppkey % 6 ELSE '' END AS en,
    CASE WHEN s_suppkey % 9 > 3 THEN 't' || s_suppkey % 9 ELSE '' END AS th, {_AT.format('s_suppkey')} FROM supplier)"""
_OTHER = f"""(SELECT CAST(c_nationkey % 5 AS VARCHAR) AS line, c_custkey AS ord, CASE WHEN c_custkey // 10 % 7 > 0 THEN 'stop ' || c_custkey // 10 % 7 ELSE '' END AS en,
    CASE WHEN c_custkey // 10 % 11 > 3 THEN 't' || c_custkey // 10 % 11 ELSE '' END AS th, {_AT.format('c_custkey')} FROM customer WHERE c_custkey % 10 = 0)"""


def _place(key):
    return (F.lit(13.7) + key * 7919 % 6500 / F.lit(65000.0)).alias("lat"), (F.lit(100.5) + key * 104729 % 6000 / F.lit(60000.0)).alias("lng")


def _named(prefix: str, n, least: int):
    return F.when(n > least, F.concat(F.lit(prefix), n.cast("string"))).otherwise("")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    own = table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5).cast("string").alias("line"), s.cast("string").alias("sid"), s.alias("ord"), _named(" Stop  ", s % 6, 0).alias("name"), _named("T", s % 9, 3).alias("name_th"), *_place(s)
    )
    tens = F.expr("c_custkey DIV 10")
    other = table(spark, sf_dir, "customer").filter(c % 10 == 0).select(
        (F.col("c_nationkey") % 5).cast("string").alias("line"), c.alias("ord"), c.alias("osm_id"), F.concat(F.lit("R"), c.cast("string")).alias("ref"), _named("stop ", tens % 7, 0).alias("name_en"), _named("t", tens % 11, 3).alias("name_th"), *_place(c)
    )
    return own, other


@query(f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ord) AS k, count(*) OVER (PARTITION BY line) AS n FROM {_OWN}),
    c AS MATERIALIZED (SELECT * FROM (SELECT a.line, a.k, o.ord AS o, round({sql_km('a.lat', 'a.lng', 'o.lat', 'o.lng')} * 1000, 6) AS d FROM a JOIN {_OTHER} o
        ON a.line = o.line AND ((a.en <> '' AND a.en = o.en) OR (a.th <> '' AND a.th = o.th))) WHERE d <= 4000),
    r AS (SELECT DISTINCT line, CAST(0 AS BIGINT) AS k, n, CAST([] AS BIGINT[]) AS taken FROM a
        UNION ALL SELECT line, k + 1, n, list_append(taken, coalesce(x.o, -1)) FROM (
            SELECT r.line, r.k, r.n, any_value(r.taken) AS taken, min({{'d': c.d, 'o': c.o}}) FILTER (c.o IS NOT NULL) AS x
            FROM r LEFT JOIN c ON c.line = r.line AND c.k = r.k + 1 AND NOT list_contains(r.taken, c.o) WHERE r.k < r.n GROUP BY r.line, r.k, r.n))
    SELECT a.line, CAST(a.ord AS VARCHAR) AS sid, c.o AS other, round(c.d, 3) AS metres FROM r JOIN a ON a.line = r.line AND r.k = r.n JOIN c ON c.line = a.line AND c.k = a.k AND c.o = r.taken[a.k]""")
def name_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations in turn claim the nearest free namesake of their line."""
    found = resolve.match_names(*_both(spark, sf_dir))
    return found.select("line", "sid", F.col("o_ord").alias("other"), F.round("metres", 3).alias("metres"))


@query()
def assign_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations matched with the gazetteer by name, and what is left by least total way."""
    return resolve.match_stations(*_both(spark, sf_dir))


@query()
def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station with its match in full, or as a phantom."""
    own, other = _both(spark, sf_dir)
    return resolve.match_records(own, other, resolve.match_stations(own, other))
