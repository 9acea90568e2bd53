"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Base spans come from three fixed patterns. The method looks at wider candidates (long mixed tokens), hashes every
candidate, counts over the whole corpus the distinct repositories and owners that hold each hash, and so separates
widely copied examples from credentials that one owner alone holds. Owner-specific candidates become spans of kind
`owned`; base spans always stay, and each carries whether it looks live, which it does unless its value is plainly
common (more than COMMON owners).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import materialise, read

#: Pattern, group whose length counts, least length, in the order in which kinds are listed.
BASE = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Candidates of the method: whole runs of token characters, `least` long or more, with a digit, a lower-case and an upper-case letter.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = [*BASE, "owned"]
#: Repositories or owners beyond which a base span's value is a widely copied example; a credential that a few share is one still.
COMMON = 10

#: Code points of a text that redaction cuts together.
CHUNK = 1024


def pieces(text: Column, pattern: str, group: int, kind: str) -> Column:
    """A text cut at the leftmost non-overlapping matches: structs (kind, g, h, value), g code points before a match of h.

    The gaps and the matches alternate, so running sums of their lengths place the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    rows = F.zip_with(F.zip_with(gaps, found, lambda gap, hit: F.struct(F.length(gap).alias("g"), F.length(hit).alias("h"))), value, lambda x, v: F.struct(F.lit(kind).alias("kind"), x["g"].alias("g"), x["h"].alias("h"), v.alias("value")))
    none = F.array().cast("array<struct<kind:string,g:int,h:int,value:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)  # the cheap test in front spares most texts the cutting


def found_spans(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row for each base span and candidate: doc, text hash, repo, owner, kind, s, e, hash.

    Matches are rows, placed by sums over the earlier ones of their text, so the work follows their number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = {k: (pattern, group, least) for k, (pattern, group, least) in BASE.items()} | {"owned": (CANDIDATE, 0, 20)}
    cut = F.concat(*(pieces(text, pattern, group, kind) for kind, (pattern, group, _) in every.items()))
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(repo_col).alias("repo"),
        F.col(owner_col).alias("owner"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        cut.alias("cut"),
    ).filter(F.size("cut") > 0)
    hits = texts.select("doc_id", "repo", "owner", "text_hash", "row", F.posexplode("cut").alias("i", "x")).select("doc_id", "repo", "owner", "text_hash", "row", "i", "x.*")
    # the sums reach to the match before, so the last gap and match never count
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("e", F.sum(F.col("g") + F.col("h")).over(so_far).cast("int")).withColumn("s", F.col("e") - F.col("h"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    long = F.lit(False)
    for kind, (_, _, least) in every.items():
        long = long | ((F.col("kind") == kind) & (F.length("value") >= least))
    good = placed.filter(long & ((F.col("kind") != "owned") | mixed))
    return good.select("doc_id", "repo", "owner", "text_hash", "kind", "s", "e", F.sha2("value", 256).alias("secret"))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate hash, in how many distinct repositories and owners it stands (null counts as one of its own).

    Counted in two steps, so that a widely copied value is combined before each shuffle and never meets in one task.
    """
    place = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    pairs = found.select("secret", place("repo").alias("repo"), place("owner").alias("owner")).distinct()
    repos = pairs.select("secret", "repo").distinct().groupBy("secret").agg(F.count("*").alias("repos"))
    owners = pairs.select("secret", "owner").distinct().groupBy("secret").agg(F.count("*").alias("owners"))
    return repos.join(owners, "secret")


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    owner_col: str = "source",
    max_repos: int = 1,
    max_owners: int = 1,
    common: int = COMMON,
) -> DataFrame:
    """Spans of every document: doc_id, text_hash, spans (kind, s, e, live), at least one a row.

    live: a base span unless more than `common` repositories or owners hold the same value; a candidate of the method
    if at most `max_repos` repositories and `max_owners` owners do. Candidates stay only if they are live and no base
    span covers them. Null text counts as empty; documents without spans
    give no row; rows that repeat an id and text share a row; an id with several texts has a row for each.
    """
    found = materialise(found_spans(docs, id_col, text_col, repo_col, owner_col))  # small beside the texts, and read twice
    few = lambda repos, owners: (F.col("repos") <= repos) & (F.col("owners") <= owners)
    live = F.when(F.col("kind") == "owned", few(max_repos, max_owners)).otherwise(few(max(max_repos, common), max(max_owners, common)))
    seen = found.join(ownership(found), "secret").withColumn("live", live)
    order = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    kept = seen.filter((F.col("kind") != "owned") | F.col("live")).select("doc_id", "text_hash", "s", order.alias("o"), "e", "kind", "live").distinct()
    # a base span that starts before a candidate's end and ends behind its start covers some of it
    base = F.col("kind") != "owned"
    own = Window.partitionBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # frames that end here are linear
    reach = F.max(F.when(base, F.col("e"))).over(own.orderBy("s", "o"))
    ahead = F.min(F.when(base, F.col("s"))).over(own.orderBy(F.desc("s"), F.desc("o")))
    covered = F.coalesce(reach > F.col("s"), F.lit(False)) | F.coalesce(ahead < F.col("e"), F.lit(False))
    fresh = kept.withColumn("covered", covered).filter(base | ~F.col("covered"))
    grouped = fresh.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("s", "o", "e", "kind", "live"))).alias("every"))
    return grouped.select("doc_id", "text_hash", F.transform("every", lambda r: F.struct(r["kind"], r["s"], r["e"], r["live"])).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """`docs` with every live-looking span of `found` (from secret_scan) replaced by `mark`; all columns stay.

    Rows without such a span, null texts included, are as they were; columns of any name pass through.
    """
    live = found.select("doc_id", "text_hash", F.explode("spans").alias("r")).filter("r.live").select("doc_id", "text_hash", "r.s", "r.e")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    cuts = live.withColumn("back", F.coalesce(F.max("e").over(before), F.lit(0)))
    # stretches that stay end where a span begins; a span that overlaps the last joins it
    gap = F.when(F.col("s") >= F.col("back"), F.struct("back", "s"))
    live = cuts.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("e").alias("last"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # keeps the names of docs apart from those of found
    rows = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    joined = rows.join(live, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    joined = joined.withColumn("chunks", F.when(F.col("gaps").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """Code points a to b of the text, of which only the chunks that hold them are looked at."""
        first = F.floor(a / CHUNK).cast("int")
        near = F.array_join(F.slice("chunks", first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
        return F.substring(near, a - first * CHUNK + 1, b - a)

    kept = F.transform("gaps", lambda x: between(x["back"], x["s"]))
    length = F.length(text)
    clean = F.concat(F.array_join(kept, mark), F.lit(mark), between(F.col("last"), length))
    whole = F.when(F.col("gaps").isNull(), F.col("row")[text_col]).otherwise(clean)
    return joined.select(*((whole if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def digest(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`, with the counts and digests of the registered query."""
    write = lambda a: F.array_join(F.transform(a, lambda r: F.concat_ws(":", r["kind"], r["s"], r["e"])), ",")
    base = F.filter("spans", lambda r: r["kind"] != "owned")
    count = lambda kind: F.size(F.filter("spans", lambda r: r["kind"] == kind)).cast("long")
    known = found.select(
        F.col("doc_id").alias("_id"),
        "text_hash",
        *(count(k).alias(f"n_{k}") for k in BASE),
        write(base).alias("base"),
        write(F.col("spans")).alias("spans"),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"))
    joined = rows.join(known, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("_key") == F.col("text_hash")), "left")
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digest(docs, secret_scan(docs))


_SQL_BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}


def _sql_kind(i: int, kind: str, pattern: str, group: int, least: int, extra: str = "") -> str:
    return f"""
    SELECT n, {i} AS o, '{kind}' AS kind, g + h - length(m) AS s, g + h AS e, v FROM (
        SELECT n, m, v, list_sum(list_transform(gaps[:k], lambda x: length(x))) AS g, list_sum(list_transform(hits[:k], lambda x: length(x))) AS h
        FROM (SELECT n, hits, gaps, unnest(hits) AS m, unnest(vals) AS v, unnest(range(1, len(hits) + 1)) AS k
              FROM (SELECT n, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals,
                           string_split_regex(text, '{pattern}') AS gaps
                    FROM d WHERE regexp_matches(text, '{pattern}'))))
    WHERE length(v) >= {least}{extra}"""


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_sql_kind(i, k, *v) for i, (k, v) in enumerate(_SQL_BASE.items()))}),
wide AS ({_sql_kind(3, "owned", CANDIDATE, 0, 20, " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
own AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners FROM every JOIN d USING (n) GROUP BY v),
kept AS (
    SELECT n, o, kind, s, e FROM base
    UNION ALL
    SELECT w.n, w.o, w.kind, w.s, w.e FROM wide w JOIN own USING (v)
    WHERE owners <= 1 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = w.n AND b.s < w.e AND w.s < b.e)),
g AS (
    SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (kind <> 'owned') AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
    FROM kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""
