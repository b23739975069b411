"""Pages as sequences of leaf blocks: text between block borders, with what is above it in the tree.

One pass over the markup, linear in its length whatever is left open in it: comments, declarations, raw
text and what is in the head are skipped, character references resolved, white space turned into one
blank. A start tag that begins a block ends the paragraph, item or cell before it, as the HTML standard
has it. A tag without an end in the page is dropped with the rest of the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those of which nothing is shown.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
UNSEEN = frozenset("head template noscript svg math object audio video canvas datalist".split())
#: Elements within a line; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that part no text, though they are not within a line.
QUIET = INLINE | frozenset("script style title template noscript link meta base".split())
#: What a start tag ends: the elements closed, up to the elements that hold them.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Elements that a new block does not close a paragraph beyond.
HOLDS_PARAGRAPHS = ("td", "th", "caption", "button", "marquee", "object", "template")

MARKUP = re.compile(
    r"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
)
#: The same with tags that end at the next angle bracket, for pages with open quotes.
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>[^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Features of this many elements next above a block, and of the outermost, are kept.
NEAREST, OUTERMOST = 16, 8


@dataclass(slots=True)
class Block:
    """A leaf. path: words for the elements above it, outermost first; linked: its characters in links."""

    text: str
    path: tuple[str, ...]
    linked: int


@lru_cache(maxsize=50_000)
def element_words(tag: str, more: str) -> tuple[str, ...]:
    """What describes an element: its tag, and the words in its class, id, role and itemprop."""
    words = [f"<{tag}>"]
    for m in ATTRIBUTE.finditer(more):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            words += [w.removesuffix("s") if len(w) > 3 else w for w in (p.lower() for p in PART.findall(unescape(value)[:400]))]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
            words.append("(hidden)")
    return tuple(dict.fromkeys(words))[:12]


class _Page:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.texts: list[str] = []
        self.linked = self.unseen = 0
        self.path: tuple[str, ...] | None = None

    def flush(self) -> None:
        if self.texts:
            if text := " ".join(unescape("".join(self.texts)).split()):
                self.blocks.append(Block(text, self.path or (), min(self.linked, len(text))))
            self.texts, self.linked, self.path = [], 0, None

    def text(self, raw: str) -> None:
        if self.unseen or not raw:
            return
        self.texts.append(raw)
        if not raw.isspace():
            if self.path is None:
                self.path = self.open[-1][1] if self.open else ()
            if self.places.get("a"):
                self.linked += len(raw)

    def cut(self, place: int) -> None:
        """Closes the elements from a place on."""
        if any(tag not in QUIET for tag, _ in self.open[place:]):
            self.flush()
        for tag, _ in self.open[place:]:
            self.places[tag].pop()
            self.unseen -= tag in UNSEEN
        del self.open[place:]

    def last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def start(self, tag: str, more: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag not in QUIET:
            self.flush()
            if tag == "body" and "head" in self.places and self.places["head"]:
                self.cut(self.places["head"][-1])
            if (p := self.last(("p",))) > self.last(HOLDS_PARAGRAPHS):
                self.cut(p)
            closed, holders = CLOSES.get(tag, ((), ()))
            if closed and (at := min((p[-1] for t in closed if (p := self.places.get(t)) and p[-1] > self.last(holders)), default=-1)) >= 0:
                self.cut(at)
        elif tag == "a" and self.places.get("a"):
            self.end("a")
        if tag in VOID or more.endswith("/") and tag in ("svg", "math"):
            return
        words = element_words(tag, more)
        above = self.open[-1][1] if self.open else ()
        path = above + words
        if len(path) > NEAREST + OUTERMOST + 12:
            path = path[:OUTERMOST] + path[-NEAREST:]
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, path))
        self.unseen += tag in UNSEEN

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.places.get(tag):
            self.text(" ") if tag == "br" else self.flush()
        elif self.places.get(tag):
            place = self.places[tag][-1]
            if tag in INLINE and any(t not in INLINE for t, _ in self.open[place:]):
                return  # an inline element left open around blocks ends with them
            self.cut(place)


def leaf_blocks(html: str | None) -> list[Block]:
    """A page's blocks in its order."""
    html = (html or "").replace("\0", " ")
    last = html.rfind(">") + 1
    if open_tag := re.compile(r"<[a-zA-Z/!?]").search(html, last):
        html = html[: open_tag.start()]
    page, at, plain = _Page(), 0, False
    lower = None
    while (found := html.find("<", at)) >= 0:
        m = None if plain and html[found + 1 : found + 2] not in "!?" else MARKUP.match(html, found)
        if m is None and (m := PLAIN_TAG.match(html, found)):
            plain = True
        if m is None:  # a bare sign
            page.text(html[at : found + 1])
            at = found + 1
            continue
        page.text(html[at:found])
        at = m.end()
        tag = (m.groupdict().get("tag") or "").lower()
        if not tag:
            continue
        if m["end"]:
            page.end(tag)
            continue
        page.start(tag, m["more"])
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            close = lower.find(f"</{tag}", at)
            at = len(html) if close < 0 else close
    page.text(html[at:])
    page.flush()
    return page.blocks
