"""Articles and plain text from HTML and items from RSS, with the standard library's parsers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Elements that hold no article text, places of an article's body in order of
#: precedence, classes that name a summary, the least length of a paragraph, captions.
STRIPPED = ["script", "style", "nav", "footer", "header", "aside", "figure", "form", "iframe", "noscript", "svg", "button"]
SELECTORS = ["article", ".fck_detail", ".singular-content", ".article-content", ".detail-content", ".content-detail", ".post-content", ".entry-content", "[itemprop='articleBody']", "main"]
SUMMARY_CLASS = re.compile(r"(sapo|description|lead)", re.I)
SHORTEST_PARAGRAPH = 25
CAPTION = re.compile(r"^(Ảnh|Video|Nguồn|Theo|Từ khóa):")
#: Fixed values of the plainer extraction.
PLAIN_STRIPPED = ["script", "style", "nav", "footer", "header", "aside", "figure"]
PLAIN_CLASS = re.compile(r"(fck_detail|singular-content|article-content|detail-content)")
PLAIN_SHORTEST = 20
#: Elements without content, by the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    """An element with its attributes, and its children: elements and texts."""

    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self, without: frozenset[str] = frozenset()) -> Iterator[Node | str]:
        """All below, in document order, without the elements of some tags."""
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            if isinstance(child, Node):
                if child.tag in without:
                    continue
                waiting += child.children[::-1]
            yield child

    def first(self, holds: Callable[[Node], bool], without: frozenset[str] = frozenset()) -> Node | None:
        return next((n for n in self.walk(without) if isinstance(n, Node) and holds(n)), None)

    def text(self, between: str, without: frozenset[str] = frozenset()) -> str:
        return between.join(s for n in self.walk(without) if isinstance(n, str) and (s := n.strip()))

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        own = self.open[-1].children
        if own and isinstance(own[-1], str):
            data = own.pop() + data
        own.append(data)


class _Texts(HTMLParser):
    """Texts, each from one piece of markup to the next."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found = [""]

    def handle_data(self, data):
        self.found[-1] += data

    def markup(self, *_):
        self.found.append("")

    handle_starttag = handle_endtag = handle_comment = handle_decl = handle_pi = unknown_decl = markup


def strip_html(text: str) -> str:
    """The text between tags, parted by blanks, character references resolved; comments go, the text
    of scripts stays. Text without any angle bracket is left alone."""
    if "<" not in text and ">" not in text:
        return text
    parser = _Texts()
    parser.feed(text)
    parser.close()
    return " ".join(t for t in parser.found if t)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _selected(selector: str) -> Callable[[Node], bool]:
    if selector.startswith("."):
        return lambda n: selector[1:] in n.classes()
    if selector.startswith("["):
        name, value = selector[1:-1].split("=")
        return lambda n: n.attributes.get(name) == value.strip("'")
    return lambda n: n.tag == selector


def _meta(root: Node, key: str, value: str) -> str:
    found = root.first(lambda n: n.tag == "meta" and n.attributes.get(key) == value)
    return ((found.attributes.get("content") or "") if found else "").strip()


def parse_article(html: str | None, fallback_title: str = "", fallback_summary: str = "") -> dict:
    """title, summary and content (title, summary and paragraphs, parted by blank lines) of a page; the
    fallbacks where the page has none."""
    root = tree(html or "")
    heading = root.first(lambda n: n.tag == "h1") or root.first(lambda n: n.tag == "title")
    title = (heading.text("") if heading else "") or _meta(root, "property", "og:title") or fallback_title
    named = root.first(lambda n: any(SUMMARY_CLASS.search(c) for c in n.classes()))
    # the first of two descriptions counts, even if it is empty
    described = root.first(lambda n: n.tag == "meta" and n.attributes.get("property") == "og:description")
    summary = _meta(root, "property", "og:description") if described else _meta(root, "name", "description")
    summary = summary or (named.text("") if named else "") or fallback_summary
    without = frozenset(STRIPPED)
    body = next((n for s in SELECTORS if (n := root.first(_selected(s), without))), None) or root.first(lambda n: n.tag == "body", without) or root
    paragraphs = [p.text(" ", without) for p in body.walk(without) if isinstance(p, Node) and p.tag == "p"]
    paragraphs = [p for p in paragraphs if len(p) > SHORTEST_PARAGRAPH and not CAPTION.search(p)]
    parts = [title, summary if summary != title else "", "\n\n".join(paragraphs)]
    return {"title": title, "summary": summary, "content": "\n\n".join(p for p in parts if p)}


def parse_body(html: str | None) -> str:
    """The paragraphs of an article, by plainer rules, a line each."""
    root, without = tree(html or ""), frozenset(PLAIN_STRIPPED)
    body = root.first(lambda n: n.tag == "article", without) or root.first(lambda n: any(PLAIN_CLASS.search(c) for c in n.classes()), without) or root.first(lambda n: n.tag == "body", without)
    found = [p.text("", without) for p in (body.walk(without) if body else ()) if isinstance(p, Node) and p.tag == "p"]
    return "\n".join(p for p in found if len(p) > PLAIN_SHORTEST)


#: Texts of an Arrow batch that are Python objects at once.
PARSED_AT_ONCE = 64


def _each(texts: pa.Array, change: Callable, kind: pa.DataType) -> pa.Array:
    """change(text) of each text, a few at a time, so a batch of many pages is held as Arrow only."""
    parts = [pa.array([change(t) for t in texts.slice(a, PARSED_AT_ONCE).to_pylist()], kind) for a in range(0, len(texts), PARSED_AT_ONCE)]
    return pa.concat_arrays([pa.array([], kind), *parts])


def articles(pages: DataFrame) -> DataFrame:
    """page_id, title, summary, content, token_count"""
    names = ("title", "summary", "content")
    kind = pa.struct([(c, pa.string()) for c in names])

    @F.arrow_udf("title string, summary string, content string")
    def parse(html: pa.Array) -> pa.Array:
        return _each(html, parse_article, kind)

    parsed = pages.select("page_id", parse("html").alias("a")).select("page_id", *[T.cleaned_lines(F.col(f"a.{c}")).alias(c) for c in names])
    return parsed.withColumn("token_count", T.token_count(F.col("content")))


def bodies(pages: DataFrame) -> DataFrame:
    """page_id, body by the plainer rules"""

    @F.arrow_udf("string")
    def parse(html: pa.Array) -> pa.Array:
        return _each(html, parse_body, pa.string())

    return pages.select("page_id", parse("html").alias("body"))


def parse_rss(xml: str | None, titled: bool = False) -> list[dict]:
    """Items with a link (or at least a title, if titled); a bare & is taken as text; malformed input
    has no items."""
    try:
        root = ElementTree.fromstring(re.sub(r"&(?!#?\w+;)", "&amp;", xml or ""))
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter("item"):
        got = {k: (item.findtext(k) or "").strip() for k in ("title", "link", "description", "guid", "pubDate")}
        got["description"] = " ".join(re.sub(r"<[^>]*>", " ", got["description"]).split())
        if got["link"] or (titled and got["title"]):
            out.append(got)
    return out


def rss_items(feeds: DataFrame, titled: bool = False) -> DataFrame:
    """feed_url and the items of each feed (feed_url, xml)."""

    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("title", "link", "description", "guid", "pubDate")]))

    @F.arrow_udf("array<struct<title: string, link: string, description: string, guid: string, pubDate: string>>")
    def parse(xml: pa.Array) -> pa.Array:
        return _each(xml, lambda x: parse_rss(x, titled), kind)

    return feeds.select("feed_url", F.explode(parse("xml")).alias("item")).select("feed_url", "item.*")
