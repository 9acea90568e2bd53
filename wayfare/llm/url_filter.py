"""URL filter: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join.

DataFrame functions only. A listed URL is a canonical `host/path` prefix with a verdict. Each page's URL gives one
lookup key for every listed shape (labels of the host, characters of the path) that it can fill; the blocked Bloom
filter (one block of eight 32-bit words a key, one bit in each word) passes the keys that may be listed, and an exact
hash join on the key removes the false positives. The longest listed URL that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import broadcast_if_light, materialise, read

WORDS = 8
#: Listed keys for each 256-bit block: about 16 bits a key.
KEYS_PER_BLOCK = 16
#: Shapes up to which each URL tries the listed shapes; beyond, it tries the path lengths listed for its own host and
#: the domains above it, found by a join.
MAX_SHAPES = 256

#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is no `://`."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    bit = F.pmod(F.xxhash64(key, F.lit(word)), F.lit(32)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: one row for each block that has a key, with its eight words."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(
        *(F.bit_or(_mask(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS))
    )


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """Verdict for every row of `pages` (url) by `rules` (host, path, verdict).

    Null urls and urls without `://` have an empty host and path and get the default. Rows that repeat give
    rows that repeat; an empty table gives no rows; further columns of `pages` are not read. A rule listed twice
    with different verdicts counts as block. Null parts of a rule count as empty. Of rules of
    equal length that fit (host and path split at another place), the last one by name wins. A long url tries no more
    prefixes than there are lengths listed for its host.
    """
    listed = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy(_key(F.col("host"), F.col("path")).alias("key"), "host", "path")
        .agg(F.max(F.coalesce("verdict", F.lit("block"))).alias("verdict"))
    )
    listed = materialise(listed)
    shape = F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars"))
    facts = listed.agg(F.count("*").alias("n"), F.slice(F.collect_set(shape), 1, MAX_SHAPES + 1).alias("shapes")).first()
    blocks = max(1, facts["n"] // KEYS_PER_BLOCK)

    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
    ).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = rows.select("host", "path").distinct()  # a verdict depends on nothing else; copies collapse before the shuffle
    labels, chars = _labels(F.col("host")), F.length("path")
    if len(facts["shapes"]) <= MAX_SHAPES:
        shapes = F.array(
            *(F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["chars"]).alias("chars")) for s in sorted(facts["shapes"]))
        ).cast("array<struct<labels:int,chars:int>>")
    else:
        lengths = materialise(listed.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")))
        ways = places.select("host", "path", F.explode(F.sequence(F.lit(1), labels)).alias("n"))
        ways = ways.withColumn("suffix", F.array_join(F.slice(F.split("host", r"\."), -F.col("n"), F.col("n")), "."))
        fit = ways.join(broadcast_if_light(lengths.withColumnRenamed("host", "suffix")), "suffix")
        each = F.transform("lengths", lambda c: F.struct(F.col("n").alias("labels"), c.alias("chars")))
        places = fit.groupBy("host", "path").agg(F.flatten(F.collect_list(each)).alias("shapes"))
        shapes = F.col("shapes")
    tried = F.filter(shapes, lambda s: (s["labels"] <= labels) & (s["chars"] <= chars))

    def part(s: Column) -> Column:
        suffix = F.array_join(F.slice(F.split("host", r"\."), -s["labels"], s["labels"]), ".")
        return _key(suffix, F.substring(F.col("path"), F.lit(1), s["chars"]))

    probes = places.select("host", "path", F.explode(F.array_distinct(F.transform(tried, part))).alias("key"))
    probes = probes.withColumn("block", _block(F.col("key"), blocks))

    filter_table = broadcast_if_light(materialise(bloom(listed, blocks)))
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(_mask(F.col("key"), w)) != 0)
    possible = probes.join(filter_table, "block").filter(hit).select("host", "path", "key")

    exact = broadcast_if_light(listed.select("key", F.concat("host", "path").alias("rule"), "verdict"))
    best = (
        possible.join(exact, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return url_filter(read(spark, sf_dir, "pages"), rules)


OP2_SQL = """
WITH r(host, path, verdict) AS (VALUES
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
    SELECT page_id, row_number() OVER () AS n,
        CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
    FROM pages),
q AS (
    SELECT page_id, n,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM p),
j AS (
    SELECT q.page_id, q.n, q.host, q.path, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY q.n ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
    FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""
