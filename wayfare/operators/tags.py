"""Filters of tagged map elements and of triples, for gazetteers that are at hand as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import materialise


def tag_is(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))


def tag_like(tags: Column, key: str, pattern: str, any_case: bool = False) -> Column:
    """Whether the pattern is found anywhere in a tag's value."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)).rlike(("(?i)" if any_case else "") + pattern), F.lit(False))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def recurse_down(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted elements (type, id, members) and, level by level, all that they are made of.

    elements: type, id, members array<struct<type, ref>>. An element with several parents is there once.
    """
    found = wanted.select("type", "id", "members")
    level = found
    while True:
        parts = level.select(F.explode("members").alias("m")).select(F.col("m.type").alias("type"), F.col("m.ref").alias("id")).distinct()
        level = materialise(elements.select("type", "id", "members").join(parts, ["type", "id"], "left_semi").join(found, ["type", "id"], "left_anti"))
        if level.isEmpty():
            return found
        found = materialise(found.unionByName(level).dropDuplicates(["type", "id"]))


def below(links: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth: all that reach one of the roots (node) by links (child, parent), the roots at 0.

    Further columns of the roots are carried: with a name for each root, all roots are followed at once, and a node
    below several has a row for each. Each round joins only what the last one found; a cycle ends it, as nothing is
    found twice.
    """
    carried = [c for c in roots.columns if c != "node"]
    found = materialise(roots.select(*carried, "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        level = found.filter(F.col("depth") == depth).select(*carried, F.col("node").alias("parent"))
        depth += 1
        new = links.join(level, "parent").select(*carried, F.col("child").alias("node")).distinct().join(found, [*carried, "node"], "left_anti").withColumn("depth", F.lit(depth))
        found = materialise(found.unionByName(new))
        if found.filter(F.col("depth") == depth).isEmpty():
            return found


def label(names: list[Column], key: Column) -> Column:
    """The first name that there is, else the key."""
    return F.coalesce(*names, key)


def objects(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    """subject and the object of a predicate's triples (subject, predicate, object), under a name."""
    return triples.filter(F.col("predicate") == predicate).select("subject", F.col("object").alias(name))


def pattern(triples: DataFrame, required: dict[str, str], optional: dict[str, str], fixed: dict[str, str]) -> DataFrame:
    """Subjects with all required predicates (predicate to column), the optional ones where there are any, and fixed objects.

    A basic graph pattern: several objects of a predicate give several rows.
    """
    out = None
    for predicate, value in fixed.items():
        own = objects(triples, predicate, "_o").filter(F.col("_o") == value).select("subject").distinct()
        out = own if out is None else out.join(own, "subject", "left_semi")
    for predicate, name in required.items():
        own = objects(triples, predicate, name)
        out = own if out is None else out.join(own, "subject")
    for predicate, name in optional.items():
        out = out.join(objects(triples, predicate, name), "subject", "left")
    return out


def members_of(triples: DataFrame, classes: list[str], is_a: str, part_of: str) -> DataFrame:
    """subject of everything that is one of the classes or of what is below them; once for each class that it fits (a bag)."""
    roots = triples.sparkSession.createDataFrame([(name, name) for name in dict.fromkeys(classes)], "root string, node string")
    links = triples.filter(F.col("predicate") == part_of).select(F.col("subject").alias("child"), F.col("object").alias("parent"))
    return objects(triples, is_a, "node").join(below(links, roots), "node").select("subject")
