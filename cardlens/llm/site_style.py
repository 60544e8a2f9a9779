"""HTML extraction by site style trees (operator 9).

The DOMs of one host are merged into a style tree: a node is a path of element
labels (tag, classes, id, role), with the presentations (sequences of children)
and the contents (text blocks) that the host's pages show there.

* Pages whose text blocks outside labelled noise are the same are one page to
  all statistics, whatever number of copies the host has.
* Content importance of a node: the entropy of its texts over the host's pages,
  relative to that of ``pages`` different texts (of all, if there are fewer), so
  that it does not fall with the host's size.  A menu says the same on each page
  (0), an article never does (1).
* Presentation importance: the same entropy over its children sequences.
* Composite importance of a branch: ``(1 - g**l)`` of its presentation
  importance and ``g**l`` of the block-weighted content importance below it,
  ``l`` being the number of presentations (``g`` = 0.9).
* A text that recurs on more than ``recur`` of a host's pages is a notice, not
  content, whatever its node.  Inside an article or main element it must recur
  on more than ``recur`` of the host's articles, which are told apart by their
  longest text: what near copies of one article share is no notice.
* Labels carry knowledge that statistics over few pages lack: a node that is
  named as a menu, footer, advert, form or comment list has importance 0, and
  pages with an article or main element have their content there.  Inside those
  a class, id or role must name nothing but that: ``share-price`` is content.
* A path has 64 labels at most; what lies deeper counts to its ancestor there.

Branches below ``least`` that ``pages`` pages have are removed from each page of
the host, except inside an article or main element.  A host with under ``pages``
pages has no statistics and is judged by labels alone.

Pages are parsed once, to a written table with a row a page.  Statistics are
grouped sums over (host, path, text), then (host, path), summed before the
shuffle, so a host with a third of all pages is spread by its texts and paths.
What a host removes is one row, joined back to its pages; the adaptive skew
join splits the host's pages.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, broadcast_if_small, frugal
from .html import Page

G = 0.9
#: Words of labels that name what is not main text; fixed values.
NOISE = ("nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|footer|foot|sidebar|side|aside|ad|ads|advert|adverts|"
         "advertisement|banner|promo|sponsor|sponsored|cookie|cookies|consent|notice|notices|gdpr|popup|modal|newsletter|"
         "subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|disqus|replies|"
         "reply|form|search|toolbar|pagination|pager|widget|masthead|skip|alert|dialog|contentinfo|complementary|copyright")
NOISE_TAGS = frozenset("nav footer aside form select option button menu dialog search fieldset legend".split())
WORD = re.compile(rf"(?:^|[.#@_-])(?:{NOISE})(?=$|[.#@_-])")
HEADER = re.compile(r"(?:^|[.#@_-])header(?=$|[.#@_-])")
MAIN_TAGS = frozenset(("article", "main"))
MAIN = re.compile(r"@main(?=$|[.#@])|@article(?=$|[.#@])")


#: Words that only say what kind of a box a label names; fixed values.
BOX = frozenset("area articles bar block box button buttons container content entry group inner items icons item link links list main media more "
                "module outer page panel post posts reader region row section site story text thread top user users wrap wrapper".split())
NAMES = frozenset(NOISE.split("|"))
SIGN = re.compile(r"[.#@]([^.#@]*)")
HYPHEN = re.compile(r"[_-]+")


def _named(rest: str) -> bool:
    """Whether a whole class, id or role names noise: a word for it, and else
    words for boxes alone.  ``related-posts`` does, ``related-work`` does not."""
    for name in SIGN.findall(rest):
        words = [w for w in HYPHEN.split(name) if w]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BOX for w in words):
            return True
    return False


@lru_cache(10_000)
def step(where: str, tag: str, mark: str) -> str:
    """Place of an element from its parent's: ``noise``, ``main`` or ``other``.
    Outside the article a label with a noise word in it is noise; inside it must
    name nothing else, since articles have sections of all names."""
    if where == "noise":
        return where
    rest = mark[len(tag):]
    if tag in NOISE_TAGS or (where != "main" and (tag == "header" or HEADER.search(rest))):
        return "noise"
    if rest and tag not in ("html", "body", "article", "main") and (_named(rest) if where == "main" else WORD.search(rest)):
        return "noise"
    return "main" if tag in MAIN_TAGS or MAIN.search(rest) else where


def place(path: str) -> str:
    """Place of the labels along a path."""
    where = "other"
    for mark in path.split("/"):
        where = step(where, re.match(r"[a-z0-9:-]*", mark)[0], mark)
    return where


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _longest(blocks: list[dict]) -> int | None:
    """Hash of the longest text of a page's article, by which it is known."""
    return max(((len(b["text"]), b["h"]) for b in blocks if b["place"] == "main"), default=(0, None))[1]


def _marks(blocks: list[dict], nodes: list[dict]) -> dict:
    """What tells a page from others: ``same`` for copies, ``full`` for copies
    that are equal in noise and elements too, ``uid`` for each row (the table is
    written, so it stays)."""
    said = "\n".join(f"{b['path']} {b['h']}" for b in blocks if b["place"] != "noise")
    full = "\n".join(f"{b['path']} {b['h']}" for b in (*blocks, *nodes))
    return {"same": _key(said), "full": _key(full), "uid": int.from_bytes(os.urandom(8), "big", signed=True), "long": _longest(blocks)}


def parsed(batches):
    """(page_id, url, html) -> (page_id, url, host, blocks, nodes, marks)."""
    block = pa.list_(pa.struct([("path", pa.string()), ("place", pa.string()), ("h", pa.int64()), ("text", pa.string())]))
    node = pa.list_(pa.struct([("path", pa.string()), ("h", pa.int64())]))
    mark = pa.struct([(name, pa.int64()) for name in ("same", "full", "uid", "long")])
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            rows = batch.slice(k, 128)
            hosts, blocks, nodes = [], [], []
            for url, html in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                page = Page(html or "", step)
                hosts.append(host_of(url))
                blocks.append([{"path": p, "place": w, "h": _key(t), "text": t} for p, w, t in page.blocks])
                nodes.append([{"path": p, "h": _key(c)} for p, c in page.containers])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(hosts, pa.string()), pa.array(blocks, block), pa.array(nodes, node),
                 pa.array(map(_marks, blocks, nodes), mark)],
                names=["page_id", "url", "host", "blocks", "nodes", "marks"])


def _entropies(rows: DataFrame, enough: int) -> DataFrame:
    """(host, path, h) -> (host, path, n, kinds, importance): entropy of h at
    each node over that of ``enough`` kinds, or of n if there are fewer, and 1
    at most; 1 where only one was seen."""
    each = rows.groupBy("host", "path", "h").agg(F.count("*").alias("c"))
    node = each.groupBy("host", "path").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"),
                                            F.sum(F.col("c") * F.log(F.col("c"))).alias("clogc"))
    return node.select("host", "path", "n", "kinds", F.when(F.col("n") <= 1, 1.0).otherwise(F.least(
        F.lit(1.0), (F.log("n") - F.col("clogc") / F.col("n")) / F.least(F.log("n"), F.lit(math.log(max(enough, 2)))))).alias("importance"))


def style_tree(pages: DataFrame, enough: int = 8) -> DataFrame:
    """(host, path, importance, pages): composite importance of each branch,
    and the number of pages that have it."""
    content = _entropies(pages.select("host", F.explode("blocks").alias("b")).select("host", "b.path", "b.h"), enough)
    shown = _entropies(pages.select("host", F.explode("nodes").alias("b")).select("host", "b.path", "b.h"), enough)
    paths = F.array_distinct(F.concat(*(F.transform(c, lambda b: b["path"]) for c in ("blocks", "nodes"))))
    support = pages.select("host", F.explode(paths).alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages"))
    up = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    below = (content.select("host", F.explode(up).alias("path"), "n", "importance").groupBy("host", "path")
             .agg((F.sum(F.col("n") * F.col("importance")) / F.sum("n")).alias("content")))
    mixed = below.join(shown.select("host", "path", "kinds", F.col("importance").alias("shape")), ["host", "path"], "left")
    share = F.pow(F.lit(G), F.coalesce("kinds", F.lit(0)))
    return mixed.join(support, ["host", "path"]).select("host", "path", F.when(F.col("shape").isNull(), F.col("content")).otherwise(
        (1 - share) * F.greatest("shape", "content") + share * F.col("content")).alias("importance"), "pages")


def distinct_pages(trees: DataFrame, tables: Tables) -> DataFrame:
    """(host, marks, blocks, nodes), without texts: one page of those of a host
    that are copies of each other."""
    keys = trees.select("host", "marks.same", "marks.full", "marks.uid")
    first = (keys.groupBy("host", "same").agg(F.min(F.struct("full", "uid"))["uid"].alias("first"), F.count("*").alias("copies"))
             .where("copies > 1").drop("copies"))
    again = tables.write(keys.join(first, ["host", "same"]).where("uid <> first").select("uid"), "again")
    light = trees.select("host", "marks", "blocks.path", "blocks.h", "blocks.place", "nodes")
    return (light.join(broadcast_if_small(again, again.count() * 8), F.expr("marks.uid = uid"), "left_anti")
            .select("host", "marks", F.arrays_zip("path", "h", "place").alias("blocks"), "nodes"))


def recurring(pages: DataFrame, size: DataFrame, recur: float, needed: int, tables: Tables) -> DataFrame:
    """(host, b): the notices (path, h) of each host, of its distinct pages."""
    said = (pages.select("host", "marks.long", F.explode(F.array_distinct("blocks")).alias("e")).where("e.place <> 'noise'")
            .select("host", "long", F.col("e.place").eqNullSafe("main").alias("main"), F.struct("e.path", "e.h").alias("b")))
    # an article is known by its longest text; pages with the same one count once, so that this text itself is no notice
    articles = (pages.where("marks.long is not null").groupBy("host", "marks.long").agg(F.count("*").alias("c"))
                .groupBy("host").agg(F.count("*").alias("articles")).where(F.col("articles") >= needed))
    among = F.when(F.col("main"), F.col("articles")).otherwise(F.col("pages"))
    often = tables.write(said.groupBy("host", "b", "main").agg(F.count("*").alias("c")).join(size, "host").join(articles, "host", "left")
                         .where(F.col("c") > recur * among).select("host", "b", "main", "articles"), "often")
    asked = often.where("main")
    inside = (said.where("main").drop("main").join(broadcast_if_small(asked, asked.count() * 256), ["host", "b"])
              .groupBy("host", "b", "long", "articles").agg(F.count("*").alias("c"))
              .groupBy("host", "b", "articles").agg(F.count("*").alias("c")).where(F.col("c") > recur * F.col("articles")))
    return often.where("not main").select("host", "b").unionByName(inside.select("host", "b"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      least: float = 0.2, recur: float = 0.5, pages_needed: int = 8) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    A null or empty html, and a page without main text, has the empty text.  A
    null or broken url puts the page on the host ''.  Null ids and repeated rows
    are rows of their own; extra columns are ignored; an empty table gives no
    rows.  ``least``, ``recur`` and ``pages_needed`` are as in the module text."""
    tables = Tables(pages.sparkSession, "style")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    trees = tables.write(rows.mapInArrow(
        frugal(parsed), "page_id long, url string, host string, "
                "blocks array<struct<path:string,place:string,h:long,text:string>>, nodes array<struct<path:string,h:long>>, "
                "marks struct<same:long,full:long,uid:long,long:long>"), "pages")
    once = distinct_pages(trees, tables)
    size = once.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= pages_needed)
    poor = (style_tree(once, pages_needed).where((F.col("importance") < least) & (F.col("pages") >= pages_needed)).groupBy("host")
            .agg(F.collect_list("path").alias("poor")))
    notices = recurring(once, size, recur, pages_needed, tables).groupBy("host").agg(F.collect_list("b").alias("notices"))
    removed = tables.write(poor.join(notices, "host", "full").select("host", "poor", "notices"), "removed")
    tables.drop("again", "often")
    kept = F.expr("""filter(blocks, b -> b.place <> 'noise'
      and (b.place = 'main' or not exists(coalesce(poor, array()), p -> b.path = p or startswith(b.path, p || '/')))
      and not array_contains(coalesce(notices, array()), struct(b.path as path, b.h as h)))""")
    main = F.expr("exists(blocks, b -> b.place = 'main')")
    chosen = F.when(main, F.filter("kept", lambda b: b["place"] == "main")).otherwise(F.col("kept"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return (trees.drop("nodes", "marks").join(removed, "host", "left").withColumn("kept", kept)
            .select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long")))
