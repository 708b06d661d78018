"""HTML pages: clean text and listings by selectors, on a small tree built with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireloom.functions.ids import posting_id
from hireloom.schema import DESCRIPTION_LIMIT

# Elements and selectors of page chrome, and selectors of the main part in their order.
CHROME_TAGS = ("script", "style", "noscript", "template", "svg", "header", "footer", "nav", "aside", "form", "iframe")
CHROME = (
    ".header", "#header", ".footer", "#footer", ".nav", "#nav", ".navbar", ".navigation", ".menu", ".sidebar", "#sidebar", ".side", ".aside", ".breadcrumbs", "#breadcrumbs", ".modal", ".popup", "#modal", ".overlay",
    ".ad", ".ads", ".advert", "#ad", ".cookie", "#cookie", ".social", ".social-media", ".social-links", "#social", ".share", "#share", ".widget", "#widget", ".lang-selector", ".language", "#language-selector",
)
MAIN = ("main", "article", "[role=main]", "#main", "#content", ".job-description", ".posting", "[itemprop=description]")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of the same kind.
_SIBLINGS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_LIMITS = {"ul", "ol", "table", "dl", "select", "div", "section", "body"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    hidden: bool = False

    def walk(self) -> Iterator[Node]:
        """The nodes below this one in document order, without those hidden and what is below them."""
        todo = [self]
        while todo:
            n = todo.pop()
            if n is not self:
                yield n
            if not n.hidden:
                todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.hidden]

    def texts(self) -> list[str]:
        out, todo = [], [self]
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                todo += [] if c.hidden else [*reversed(c.children)]
            elif c.strip():
                out.append(c.strip())
        return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = _SIBLINGS.get(tag)
        if closes:
            n = self.at
            while n.parent and n.tag not in _LIMITS:
                if n.tag in closes:
                    self.at = n.parent
                    break
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html_text: str) -> Node:
    builder = _Builder()
    builder.feed(html_text)
    builder.close()
    return builder.root


_PART = re.compile(r"([A-Za-z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:\s*=\s*[\"']?([^\"'\]]*)[\"']?)?\]")


def _fits(node: Node, simple: str) -> bool:
    for tag, cls, ident, name, value in _PART.findall(simple):
        if tag and tag not in ("*", node.tag):
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if name and (name not in node.attrs or (value and node.attrs[name] != value)):
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether a node fits a selector of tags, classes, ids and attributes, with descendants and alternatives."""
    for chain in selector.split(","):
        steps = chain.split()
        if not steps or not _fits(node, steps[-1]):
            continue
        up, left = node.parent, steps[:-1]
        while left and up:
            if _fits(up, left[-1]):
                left = left[:-1]
            up = up.parent
        if not left:
            return True
    return False


def select(root: Node, selector: str) -> list[Node]:
    return [n for n in root.walk() if matches(n, selector)]


_CHROME_IDS, _CHROME_CLASSES = (frozenset(c[1:] for c in CHROME if c[0] == sign) for sign in "#.")
_BLANKS, _GAPS = re.compile(r"[ \t\r\f\v]+"), re.compile(r"\n\n\n+")


def _is_chrome(n: Node) -> bool:
    return n.tag in CHROME_TAGS or n.attrs.get("id") in _CHROME_IDS or not _CHROME_CLASSES.isdisjoint(n.attrs.get("class", "").split())


def clean_text(html_text: str | None, limit: int = DESCRIPTION_LIMIT) -> str:
    """Text of a page without its chrome, one text node a line; of the first main part where there is one. Never raises."""
    try:
        root = parse(html_text or "")
        for n in root.walk():  # what is hidden here isn't walked into
            n.hidden = _is_chrome(n)
        shown = [*root.walk()]
        mains = ([n for n in shown if matches(n, s)] for s in MAIN)
        part = next((found[0] for found in mains if found), root)
        return _GAPS.sub("\n\n", _BLANKS.sub(" ", "\n".join(part.texts()))).strip()[:limit]
    except Exception:
        return ""


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    return pages.map(clean_text)


def listing(pages: DataFrame, selectors: dict[str, str] | None) -> DataFrame:
    """Postings of landed listing pages (company, url, html) by the selectors job_item, title, link and location; rows without a title go.

    Without ``selectors`` each page brings its own as ``config``, a map; a page without job_item has no postings.
    """
    if selectors is not None:
        pages = pages.withColumn("config", F.create_map(*[F.lit(x) for kv in selectors.items() for x in kv]))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for company, base, text, own in zip(pdf["company"], pdf["url"], pdf["html"], pdf["config"]):
                own = dict(own or {})
                found = lambda item, name, default=None, own=own: next(iter(select(item, own.get(name) or default)), None) if own.get(name) or default else None
                for pos, item in enumerate(select(parse(text or ""), own["job_item"]) if own.get("job_item") else ()):
                    link, title, place = found(item, "link", "a"), found(item, "title"), found(item, "location")
                    words = lambda n: "".join(n.texts()) if n else ""
                    name = words(title) or words(link)
                    if name:
                        out.append((company, pos, name, words(place), urljoin(base or "", link.attrs["href"]) if link and "href" in link.attrs else ""))
            yield pd.DataFrame(out, columns=["company", "pos", "title", "location", "url"])

    found = pages.select("company", "url", "html", "config").mapInPandas(rows, "company string, pos int, title string, location string, url string")
    ident = posting_id(F.col("company"), F.lit(""), F.col("url"), F.col("title"), F.col("location"))
    return found.select(ident.alias("id"), "company", "title", "location", "url", F.lit("").alias("description"), F.lit("").alias("posted_at"), F.lit(1).alias("source_tier"), "pos")
