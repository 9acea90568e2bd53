"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text that they hold; the best one gives a vote for its path of
generalised tags and classes. Spark counts the votes of each host and ranks its paths; every page is then extracted
again from the first of its host's paths that it has. A page that has none of them keeps its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import broadcast_if_light, materialise, read, slices, tidied
from wayfare.llm.url_filter import host_of

#: Voted paths of a host up to which its pages carry the ranked list; where a host has more, each page's own paths are
#: joined with the votes instead.
PATHS = 32

# HTML element names by role, and class or id words of what surrounds an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas audio video textarea select title".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body div main section td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
AROUND = set("nav footer aside form header menu dialog button head".split())
CLOSES = {"p": ("p", {""}), "li": ("li", {"ul", "ol", "menu"}), "tr": ("tr", {"table", "tbody", "thead", "tfoot"}), "td": ("td", {"tr"}), "th": ("th", {"tr"}), "dt": ("dt", {"dl"}), "dd": ("dd", {"dl"}), "option": ("option", {"select"})}
# Words that say nothing by themselves in the name of a part of a page.
NEUTRAL_WORDS = set(
    "area bar block body bottom box button buttons column container content floating form header icon icons inline inner item items left link links list "
    "main outer panel posts right row section side site slot small sticky text title top unit wrap wrapper".split()
)
AROUND_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion recommended related respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget widgets".split()
)



def surrounding_name(value: str) -> bool:
    """Whether a class or id value has a name made of surroundings words, with nothing but neutral words and numbers beside them.

    `cookie-notice` and `comment-list` are such, `notice-period` and `related-work` are not.
    """
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not AROUND_WORDS.isdisjoint(parts) and all(x in AROUND_WORDS or x in NEUTRAL_WORDS for x in parts):
            return True
    return False


TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|[^>]*(?:>|\Z))",
    re.S,
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Elements in page order (parent, tag, path key, label, whether surrounding) and blocks (element, text, heading)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    key: list[int] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    around: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, bool, int]] = field(default_factory=list)

    def path(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.label[i])
            i = self.parent[i]
        return ">".join(reversed(out))


def parse(source: str) -> Page:
    """Blocks of a page. A run of text in an inline element of the surroundings is no part of the block around it; a
    block that has no other text belongs to that element."""
    page, stack = Page(), []
    text: list[str] = []
    aside: list[tuple[int, str]] = []  # runs of inline surroundings in the open block
    inline: list[int] = []  # depths of the open ones
    linked = heading = 0
    chars_linked = 0
    places: dict[str, list[int]] = {"": []}
    pos, n = 0, len(source)

    def flush():
        nonlocal chars_linked
        said, depth = SPACE.sub(" ", "".join(text)).strip(), top("")
        if said:
            page.blocks.append((stack[depth] if depth >= 0 else -1, said, heading > 0, min(chars_linked, len(said))))
        elif aside and (said := SPACE.sub(" ", "".join(x for _, x in aside)).strip()):
            page.blocks.append((aside[0][0], said, heading > 0, 0))
        text.clear()
        aside.clear()
        chars_linked = 0

    def top(name: str) -> int:
        """Depth of the innermost open element of a name; "" stands for all blocks."""
        open_ = places.get(name)
        return open_[-1] if open_ else -1

    def close(depth: int):
        nonlocal linked, heading
        while len(stack) > depth:
            name = page.tag[stack[-1]]
            if name in BLOCKS:
                flush()
                places[""].pop()
            elif inline and inline[-1] == len(stack) - 1:
                inline.pop()
            places[name].pop()
            linked -= name == "a"
            heading -= name in HEADINGS
            stack.pop()

    def add(part: str):
        nonlocal chars_linked
        part = html.unescape(part)
        if inline and inline[-1] > top(""):
            aside.append((stack[inline[-1]], part))
            return
        text.append(part)
        if linked:
            chars_linked += len(part)

    while pos < n:
        m = TAG.search(source, pos)
        if not m:
            add(source[pos:])
            break
        if m.start() > pos:
            add(source[pos : m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if (depth := top(name)) >= 0:
                close(depth)
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name != "p" and (depth := top("p")) >= 0 and depth == top(""):  # a block ends an open paragraph right above it
                close(depth)
            if name in CLOSES:
                mark, stop = CLOSES[name]
                if (depth := top(mark)) >= 0 and depth >= max(map(top, stop)):
                    close(depth)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
            pos = end.end() if end else n
            continue
        if m[3].rstrip(">").endswith("/") and name not in BLOCKS:
            continue
        named, role = False, ""
        classes = ""
        if "=" in m[3]:
            for what, *values in NAMED.findall(m[3]):
                value = "".join(values).lower()
                if what.lower() == "role":
                    role = value
                else:
                    named = named or surrounding_name(value)
                    if what.lower() == "class":
                        classes = ".".join(sorted(re.sub(r"\d+", "#", value).split()))
        parent = stack[-1] if stack else -1
        label = f"{name}.{classes}" if classes else name
        page.parent.append(parent)
        page.tag.append(name)
        page.label.append(label)
        page.key.append(xxhash.xxh64_intdigest(label, page.key[parent] if parent >= 0 else 0))
        page.around.append(name in AROUND or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog") or (named and name not in ("html", "body", "article", "main") and name not in HEADINGS))
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            places[""].append(len(stack))
        elif page.around[-1]:
            inline.append(len(stack))
        stack.append(len(page.tag) - 1)
        linked += name == "a"
        heading += name in HEADINGS
    close(0)
    flush()
    return page


def weighed(page: Page) -> tuple[list[int], list[bool]]:
    """Characters of running text in each element, and which elements are outside of any article.

    An element that looks like surroundings but holds an article, or most of the page's text, is none.
    """
    n = len(page.tag)
    total, holds = [0] * n, [False] * n
    for at, said, _, in_links in page.blocks:
        if at >= 0:
            total[at] += len(said) - in_links
    for i in range(n - 1, -1, -1):
        up = page.parent[i]
        if up >= 0:
            total[up] += total[i]
            holds[up] |= holds[i] or page.tag[i] in ("article", "main")
    everything = sum(len(said) - in_links for _, said, _, in_links in page.blocks)
    out = [False] * n
    for i in range(n):
        up = page.parent[i]
        out[i] = (up >= 0 and out[up]) or (page.around[i] and (page.tag[i] == "head" or not (holds[i] or 2 * total[i] > everything)))
    score = [0] * n
    for at, said, _, in_links in page.blocks:
        if at >= 0 and not out[at]:
            score[at] += len(said) - in_links
    for i in range(n - 1, -1, -1):
        if page.parent[i] >= 0:
            score[page.parent[i]] += score[i]
    return score, out


def best(page: Page, score: list[int], out: list[bool]) -> int:
    """The container that holds the article: an article or main element with half of the text, else the innermost
    container with most of it; -1 if there is none."""
    able = [i for i in range(len(page.tag)) if page.tag[i] in CONTAINERS and not out[i] and score[i] > 0]
    if not able:
        return -1
    most = max(score[i] for i in able)
    for name in ("article", "main"):
        named = [i for i in able if page.tag[i] == name]
        if named and 2 * max(score[i] for i in named) >= most:
            return max(named, key=lambda i: (score[i], -i))
    return max((i for i in able if 10 * score[i] >= 8 * most), key=lambda i: i)


def inside(page: Page, roots: set[int]) -> list[bool]:
    found = [False] * len(page.tag)
    for i, up in enumerate(page.parent):
        found[i] = i in roots or (up >= 0 and found[up])
    return found


def text_of(page: Page, out: list[bool], roots: set[int] | None) -> str:
    """Blocks in page order. Of an article's own header only headings stay. roots None: the whole page."""
    if roots is None:
        return "\n".join(said for at, said, _, _ in page.blocks if at < 0 or not out[at])
    found, header = inside(page, roots), only_headers(page, out, roots)
    return "\n".join(said for at, said, heading, _ in page.blocks if at >= 0 and found[at] and (not out[at] or (heading and header[at])))


def only_headers(page: Page, out: list[bool], roots: set[int]) -> list[bool]:
    """Whether nothing but headers puts an element outside of the article."""
    good = [False] * len(page.tag)
    for i, up in enumerate(page.parent):
        if not out[i] or i in roots:
            good[i] = not out[i]
        elif not page.around[i] or page.tag[i] == "header":
            good[i] = up >= 0 and good[up]
    return good


def vote(source: str) -> tuple[int, str, int] | None:
    """Key, path and weight of the best container of a page."""
    page = parse(source)
    score, out = weighed(page)
    i = best(page, score, out)
    return None if i < 0 else (page.key[i], page.path(i), score[i])


def extract(source: str, keys: list[int]) -> str:
    """The text under the first of the keys that the page has; its own best container if it has none."""
    page = parse(source)
    score, out = weighed(page)
    for key in keys:
        roots = {i for i, k in enumerate(page.key) if k == key and not out[i] and score[i] > 0}
        if roots:
            return text_of(page, out, roots)
    i = best(page, score, out)
    return text_of(page, out, None if i < 0 else {i})


def votes(pages: DataFrame) -> DataFrame:
    """pages (host, html) to host, key, path, weight: one row for each page that has a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [(h, *v) for h, x in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True) if x and (v := vote(x))]
                cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array([_signed(k) for k in cols[1]], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["host", "key", "path", "weight"])

    return pages.mapInArrow(tidied(run), "host string, key long, path string, weight long")


def _signed(k: int) -> int:
    return k - (1 << 64) if k >= 1 << 63 else k


def counted_votes(pages: DataFrame) -> DataFrame:
    """host, key, path, n, weight: the votes for each path of a host."""
    return votes(pages).groupBy("host", "key", "path").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def winning_paths(counted: DataFrame) -> DataFrame:
    """host and keys: each host's paths by falling votes (then weight, then path)."""
    order = F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("weight"), "path", "key")
    return counted.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("x")).select("host", F.col("x.key").alias("keys"))


def own_paths(pages: DataFrame, counted: DataFrame) -> DataFrame:
    """The most voted path of each page: name (of host and html) and key, joined by (host, key) whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                names, keys, hosts = [], [], []
                for name, host, source in zip(*(part.column(c).to_pylist() for c in ("name", "host", "html")), strict=True):
                    page = parse(source or "")
                    score, out = weighed(page)
                    own = sorted({k for i, k in enumerate(page.key) if page.tag[i] in CONTAINERS and not out[i] and score[i] > 0})
                    keys += map(_signed, own)
                    names += [name] * len(own)
                    hosts += [host] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], ["name", "host", "key"])

    own = pages.select("name", "host", "html").mapInArrow(tidied(run), "name long, host string, key long").distinct()
    order = F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("weight"), "path", "key")
    return own.join(broadcast_if_light(counted), ["host", "key"]).groupBy("name").agg(F.min(order).alias("x")).select("name", F.array("x.key").alias("keys"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row.

    Null, empty and textless pages give an empty text; text outside of any element counts as the page's body. Pages
    without a host vote together. Of paths with equal votes the one with more text wins, then the first by name. A page is held whole, and parsed in time in proportion to its length. Rows that repeat
    give rows that repeat; an empty table gives none; further columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    counted = materialise(counted_votes(rows.select("host", "html")))
    wide = materialise(counted.groupBy("host").agg(F.count("*").alias("paths")).filter(F.col("paths") > PATHS).select("host"))
    many = not wide.isEmpty()
    narrow = counted.join(broadcast_if_light(wide), "host", "left_anti") if many else counted
    won = broadcast_if_light(materialise(winning_paths(narrow)))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(x, [k & (1 << 64) - 1 for k in keys or []]) if x else "" for x, keys in zip(part.column("html").to_pylist(), part.column("keys").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    told = (rows.join(broadcast_if_light(wide), "host", "left_anti") if many else rows).join(won, "host", "left").select("page_id", "url", "html", "keys")
    if many:
        large = rows.join(broadcast_if_light(wide), "host", "left_semi").withColumn("name", F.xxhash64("host", F.coalesce("html", F.lit(""))))
        own = materialise(own_paths(large, counted.join(broadcast_if_light(wide), "host", "left_semi")))
        told = told.union(large.join(broadcast_if_light(own), "name", "left").select("page_id", "url", "html", "keys"))
    return told.mapInArrow(tidied(run), f"page_id {kind}, url string, text string")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
