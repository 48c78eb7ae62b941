"""Main text of web pages by site template removal.

A page is walked once per pass with a stack of open elements. Pass one hashes the element
subtrees (tag, text and child hashes) outside the article; Spark counts on how many pages
of a host each occurs. Pass two deletes subtrees that recur on many pages of their host,
and what its tag, role or class says is no main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments). What holds an article or is main is
no template itself. The text of the articles is kept; that of main where the articles have
less than half as much; that of the body where a page has neither. Paragraphs inside an
article that recur (a licence line) belong to it and stay.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import cut, prepare

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b(?!\s*=)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select option datalist textarea dialog menu title audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu sidebar footer masthead "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations comment comments disqus respond replies pagination pager widget toolbar login".split()
)
_HEADER_MARKS = frozenset({"header"})
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open element of the values is closed by the key, unless one of the third lies between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("article aside body div footer header main nav section table td th li blockquote form".split())


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & _MARKS or (not in_article and words & _HEADER_MARKS):
                return True
    return False


class _Open:
    __slots__ = ("tag", "dropped", "article", "main", "holds", "parts", "text")

    def __init__(self, tag, dropped, article, main):
        self.tag, self.dropped, self.article, self.main, self.holds, self.parts, self.text = tag, dropped, article, main, False, [], []


def walk(page: str, templates=frozenset(), host_key: bytes = b"", hashing: bool = True) -> tuple[set[int], str]:
    """Hashes of the page's subtrees outside articles; its main text without templates."""
    stack = [_Open("", False, False, False)]
    hashes: set[int] = set()
    articles: list[str] = []
    mains: list[str] = []

    def close():
        node = stack.pop()
        above = stack[-1]
        block = node.tag not in _INLINE
        # an article or main itself, and what is around one
        node.holds = node.holds or (node.article and not above.article) or (node.main and not above.main)
        above.holds = above.holds or node.holds
        if hashing and not above.article and (node.parts or node.text):
            digest = blake2b(host_key + node.tag.encode() + b"\0" + b"\0".join(node.parts), digest_size=8).digest()
            above.parts.append(digest)
            if block and node.parts:
                key = int.from_bytes(digest, "little", signed=True)
                hashes.add(key)
                if key in templates and not node.article and not node.holds:
                    node.text = []
        if node.text and not node.dropped:
            text = "".join(node.text)
            if node.article and not above.article:
                articles.append(text)
            if node.main and not above.main:
                mains.append(text)
            above.text.append(f" {text} " if block else text)
        elif block:
            above.text.append(" ")

    def add(text: str):
        node = stack[-1]
        text = html.unescape(text)
        if not node.dropped:
            node.text.append(text)
        if hashing and not node.article and (words := text.split()):
            node.parts.append(" ".join(words).encode("utf-8", "surrogatepass"))

    at, lower = 0, None
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if end:
            end = end.lower()
            if end == "br":
                add(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == end:
                    while len(stack) > i:
                        close()
                    break
        elif tag:
            if at == len(page) and page[-1] != ">":
                break  # the page ends inside a tag
            tag = tag.lower()
            if tag in _VOID:
                if tag not in _INLINE:
                    add(" ")
                continue
            shut, wall = ({"p"}, _SCOPE) if tag in _ENDS_P else _CLOSES.get(tag, ((), ()))
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in shut:
                        while len(stack) > i:
                            close()
                    elif stack[i].tag in wall:
                        break
            above = stack[-1]
            dropped = above.dropped or _unwanted(tag, attributes, above.article)
            role = 'role="main"' in attributes
            stack.append(_Open(tag, dropped, above.article or (tag == "article" and not dropped), above.main or ((tag == "main" or role) and not dropped)))
            if tag in _RAW:
                if lower is None:
                    lower = page.lower() if page.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), page)
                stop = lower.find(f"</{tag}", at)
                stop = len(page) if stop < 0 else stop
                if tag not in ("script", "style"):
                    add(page[at:stop])
                at = stop
    while len(stack) > 1:
        close()
    article, main, body = (" ".join(" ".join(x).split()) for x in (articles, mains, ["".join(stack[0].text)]))
    kept = main if 2 * len(article) < len(main) else article or body
    return hashes, kept


def _host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, least_share: float = 0.02, broadcast_limit: int = 1 << 20) -> DataFrame:
    """id, url and text of each page.

    A subtree is a template if it is on at least least_pages pages and least_share of the
    pages of its host. Templates are broadcast up to broadcast_limit hashes, and joined to
    the pages beyond that. A null or empty page has an empty text; pages without a host in
    their url share one. Rows with equal or null ids are pages of their own. Other columns
    are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), _host(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def subtrees(frames):
        for frame in frames:
            found = [sorted(walk(page, host_key=host.encode("utf-8", "surrogatepass"))[0]) for host, page in zip(frame["host"], frame["html"], strict=True)]
            yield pd.DataFrame({"host": frame["host"], "trees": found})

    trees = rows.select("host", "html").mapInPandas(subtrees, "host string, trees array<long>")
    # a host's pages are counted as one more tree, null, so that one pass does for both
    counts = trees.select("host", F.explode(F.concat("trees", F.array(F.lit(None).cast("long")))).alias("tree")).groupBy("host", "tree").agg(F.count("*").alias("pages"))
    counts = cut(counts.where(F.col("tree").isNull() | (F.col("pages") >= least_pages)))
    hosts = counts.where("tree is null").select("host", F.col("pages").alias("of"))
    templates = counts.where("tree is not null").join(hosts, "host").where(F.col("pages") >= least_share * F.col("of")).select("tree").distinct()
    few = templates.limit(broadcast_limit + 1).count() <= broadcast_limit

    def texts(frames):
        known = frozenset(sent.value.tolist()) if few else None
        for frame in frames:
            own = [known] * len(frame) if few else [frozenset(x) if x is not None else frozenset() for x in frame["trees"]]
            frame["text"] = [walk(page, t, host.encode("utf-8", "surrogatepass"))[1] for host, page, t in zip(frame["host"], frame["html"], own, strict=True)]
            yield frame[["id", "url", "text"]]

    if few:
        sent = spark.sparkContext.broadcast(np.array([r[0] for r in templates.toLocalIterator()], np.int64))
        given = rows
    else:
        keyed = rows.withColumn("mark", F.xxhash64("host", "html"))  # equal pages of a host have equal subtrees

        def marked(frames):
            for frame in frames:
                frame["trees"] = [sorted(walk(page, host_key=host.encode("utf-8", "surrogatepass"))[0]) for host, page in zip(frame["host"], frame.pop("html"), strict=True)]
                yield frame[["mark", "trees"]]

        of = keyed.select("mark", "host", "html").mapInPandas(marked, "mark long, trees array<long>").select("mark", F.explode("trees").alias("tree")).distinct()
        of = of.join(templates, "tree").groupBy("mark").agg(F.collect_list("tree").alias("trees"))
        given = keyed.join(of, "mark", "left")
    kind = f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string"
    return given.select("id", "url", "host", "html", *(["trees"] * (not few))).mapInPandas(texts, kind).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
