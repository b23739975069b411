"""Main text of pages: a bidirectional LSTM labels every leaf block with the whole page as context.

A block is read as three parts: hashed words of the elements above it (tags, parts of classes and ids),
hashed words of its text, and a few numbers. Both word tables are learned with the network, all of it in
numpy, at one float32 pass of the sequence each way.

Nobody has labelled the pages. The network learns from a bounded sample of them: a block inside an article
or main element, and outside the elements that hold no article, is main text. The blocks of these pages are
also arranged anew under many other layouts (`arranged`): classes instead of elements, tables, bare bodies,
menus, notices, adverts, forms, sidebars and readers' comments before, within and after the article. There a
block's label is known by construction, so that neither one site's elements nor its words are all there is
to learn from. Words are left out at random while it learns.

MAX_PAGES pages are sampled by a hash of page_id among those of MAX_PAGE_CHARACTERS at most. Every page is
labelled whole, whatever its length. Null, empty and blank pages have an empty text, rows that repeat are
pages of their own, other columns are not read. An empty table gives an empty one; a sample without any
text gives a model that calls everything main text.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, leaf_blocks

MAX_PAGES, MAX_PAGE_CHARACTERS = 400, 60_000
#: Sizes of the hashed tables and of their vectors, numbers of a block, units each way.
PATHS, WORDS, WIDTH, NUMBERS, UNITS = 4096, 4096, 16, 9, 24
INPUTS = 2 * WIDTH + NUMBERS
EPOCHS, PAGES_AT_ONCE, STEP = 14, 32, 0.01
#: The part of a step that the words' table takes: most words are rare, and a full one would learn each by heart.
WORD_STEP = 0.1
#: Blocks of pages labelled at once, padded.
CELLS = 40_000

#: Elements that hold article text, and those that hold none of it inside them.
HOLDERS = ("<article>", "<main>")
OTHERS = ("<nav>", "<header>", "<footer>", "<aside>", "<form>", "<button>", "<select>", "<label>", "(hidden)")
#: What classes and ids are made of, by what they name.
NAMES = {
    "article": "article post entry content story body text page blog news detail".split(),
    "menu": "nav menu navbar navigation breadcrumb topnav links tabs toolbar".split(),
    "header": "header masthead top banner branding logo head".split(),
    "footer": "footer foot bottom copyright legal colophon credits imprint".split(),
    "sidebar": "sidebar aside side widget related rail recommended popular teaser trending more".split(),
    "notice": "cookie notice consent gdpr alert message popup modal warning info disclaimer".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adbox".split(),
    "form": "form search login signup contact subscribe newsletter register".split(),
    "comments": "comment comments discussion replies respond thread reader disqus feedback responses".split(),
    "share": "share social tools follow like buttons".split(),
}
NEUTRAL = "site main page global left right box wrapper container list item block area inner section row col wrap".split()
TAGS = {
    "menu": ["<nav>", "<div>", "<ul>", "<div>", "<table>"],
    "header": ["<header>", "<div>", "<header>", "<table>"],
    "footer": ["<footer>", "<div>", "<footer>", "<section>"],
    "sidebar": ["<aside>", "<div>", "<aside>", "<section>", "<td>"],
    "notice": ["<div>", "<section>", "<aside>", "<p>"],
    "advert": ["<div>", "<aside>", "<section>", "<ins>"],
    "form": ["<form>", "<form>", "<div>"],
    "comments": ["<div>", "<section>", "<ol>", "<ul>", "<article>"],
    "share": ["<div>", "<ul>", "<nav>"],
}
#: Short texts of such blocks.
PHRASES = {
    "menu": "Home|About us|News|Contact|Products|Sports|Politics|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Noticias|Next|Previous|Blog|Archive",
    "header": "The Daily Page|Welcome|Skip to content|Your source of news|Search|Menu|Log in",
    "footer": "All rights reserved.|Privacy policy|Terms of use|Impressum|Mentions légales|Aviso legal|Powered by open software|Back to top|Copyright 2024",
    "sidebar": "Related articles|Most read|Recommended for you|Tags|Archives|Mehr zum Thema|À lire aussi|Más leídas|Popular posts|You may also like",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies.|Diese Website verwendet Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies.|Please enable scripts to view this page.|Subscribers only",
    "advert": "Advertisement|Anzeige|Publicité|Publicidad|Sponsored content|Buy now and save 50%|Limited offer|Click here for a free trial",
    "form": "Your email|Subscribe to our newsletter|Send|Name|Password|Sign up|Search|Message|Absenden|Envoyer|Enviar",
    "comments": "Comments|3 comments|Reply|Leave a comment|Kommentare|Commentaires|Comentarios|Posted by anna on May 3|Great article, thanks!|I do not agree at all.|Report|Log in to reply",
    "share": "Share|Tweet|Share on social media|Print|Email this|Teilen|Partager|Compartir|Follow us",
}


class _Hashed(dict):
    """Words' places in a table of a size, kept until there are too many."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        place = self[word] = zlib.crc32(word.encode()) % self.size
        return place


PATH_PLACES, WORD_PLACES = _Hashed(PATHS), _Hashed(WORDS)


@lru_cache(maxsize=50_000)
def _path_places(path: tuple[str, ...]) -> list[int]:
    """Places of a path's words; those next above the block have places of their own beside."""
    return [PATH_PLACES[w] for w in path] + [PATH_PLACES["near:" + w] for w in path[-3:]]


@dataclass
class Features:
    """A page's blocks as numbers: hashed words of all blocks in one row, with how many each has."""

    paths: np.ndarray
    path_counts: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    numbers: np.ndarray


def features(blocks: list[Block]) -> Features:
    paths = [_path_places(b.path) for b in blocks]
    split = [b.text.lower().split() for b in blocks]
    words = [list(map(WORD_PLACES.__getitem__, w)) for w in split]
    rows = []
    for b, w in zip(blocks, split):
        text = b.text
        count, last = text.count, text[-1]
        signs = count(".") + count(",") + count(";") + count(":") + count("!") + count("?")
        rows.append((len(w), len(text), b.linked, signs, sum(map(count, "0123456789")), last in ".!?\"'\u00bb\u201d\u2026", text[0].isupper()))
    n, chars, linked, signs, digits, ends, begins = np.array(rows, np.float32).reshape(-1, 7).T
    place = np.arange(len(rows), dtype=np.float32) / max(len(rows), 1)
    numbers = np.stack([np.log1p(n) / 4, np.log1p(chars) / 6, linked / chars, signs / n, digits / chars, ends, begins, place, np.full_like(place, np.log1p(len(rows)) / 5)], axis=1)
    flat = lambda x: np.fromiter(chain.from_iterable(x), np.int32)
    sizes = lambda x: np.fromiter(map(len, x), np.int32, len(x))
    return Features(flat(paths), sizes(paths), flat(words), sizes(words), numbers)


def _mean(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each block's rows of a table."""
    means = np.zeros((len(counts), table.shape[1]), table.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        means[some] = np.add.reduceat(table[ids], (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
    return means


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights: paths and words (tables), for each way f and b the gates' w, u and bias, and the output."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {"paths": r.normal(0, 0.3, (PATHS, WIDTH)), "words": r.normal(0, 0.1, (WORDS, WIDTH))}
        for way in "fb":
            self.w |= {f"{way}w": r.normal(0, INPUTS**-0.5, (INPUTS, 4 * UNITS)), f"{way}u": r.normal(0, UNITS**-0.5, (UNITS, 4 * UNITS)), f"{way}c": np.repeat([0.0, 1.0, 0.0, 0.0], UNITS)}
        self.w |= {"out": r.normal(0, UNITS**-0.5, 2 * UNITS), "bias": np.zeros(1)}
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([_mean(self.w["paths"], f.paths, f.path_counts), _mean(self.w["words"], f.words, f.word_counts), f.numbers], axis=1)

    def _pass(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of one way over x (steps, pages, inputs), the backward one from the end; with keep also
        what its gradient needs."""
        u, steps = self.w[way + "u"], range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        z = x @ self.w[way + "w"] + self.w[way + "c"]
        h = c = np.zeros((x.shape[1], UNITS), x.dtype)
        states, kept = np.zeros((*x.shape[:2], UNITS), x.dtype), []
        for t in steps:
            m = mask[t][:, None]
            g = z[t] + h @ u
            gates = _sigmoid(g[:, : 3 * UNITS])
            i, f, o = (gates[:, k * UNITS : (k + 1) * UNITS] for k in range(3))
            a = np.tanh(g[:, 3 * UNITS :])
            new = f * c + i * a
            tanh = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, a, tanh))
            c, h = m * new + (1 - m) * c, m * (o * tanh) + (1 - m) * h
            states[t] = h
        return states, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([self._pass(way, x, mask)[0] for way in "fb"], axis=2) @ self.w["out"] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss over blocks, the gradient for each weight but the tables, and that of x."""
        passes = {way: self._pass(way, x, mask, keep=True) for way in "fb"}
        both = np.concatenate([passes[way][0] for way in "fb"], axis=2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        total = mask.sum()
        loss = float(-(mask * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / total)
        back = mask * (p - y) / total
        grads = {"out": np.tensordot(back, both, 2), "bias": back.sum(keepdims=True).reshape(1)}
        dx = np.zeros_like(x)
        for place, way in enumerate("fb"):
            u, dstates = self.w[way + "u"], back[..., None] * self.w["out"][place * UNITS : (place + 1) * UNITS]
            du = np.zeros_like(u)
            dz = np.zeros((*x.shape[:2], 4 * UNITS), x.dtype)
            dh = dc = np.zeros((x.shape[1], UNITS), x.dtype)
            for t, h, c, i, f, o, a, tanh in reversed(passes[way][1]):
                m = mask[t][:, None]
                dh = dh + dstates[t]
                dnew = m * (dc + dh * o * (1 - tanh * tanh))
                dg = np.concatenate([dnew * a * i * (1 - i), dnew * c * f * (1 - f), m * dh * tanh * o * (1 - o), dnew * i * (1 - a * a)], axis=1)
                dz[t] = dg
                du += h.T @ dg
                dh, dc = dg @ u.T + (1 - m) * dh, dnew * f + (1 - m) * dc
            grads |= {way + "u": du, way + "w": np.tensordot(x, dz, ([0, 1], [0, 1])), way + "c": dz.sum((0, 1))}
            dx += dz @ self.w[way + "w"].T
        return loss, grads, dx

    def train(self, pages: list[Features], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 0) -> float:
        """Adam over batches of pages of like length; gives the last epoch's mean loss."""
        r = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in self.w.items()}
        order = sorted(range(len(pages)), key=lambda k: len(labels[k]))
        batches = [order[i : i + PAGES_AT_ONCE] for i in range(0, len(order), PAGES_AT_ONCE)]
        k = 0
        for epoch in range(epochs):
            losses = []
            for b in r.permutation(len(batches)):
                part = [thinned(pages[i], r) for i in batches[b]]
                x, mask, cells = padded([self.inputs(f) for f in part])
                y = np.zeros(mask.shape, np.float32)
                y[cells] = np.concatenate([labels[i] for i in batches[b]])
                loss, grads, dx = self.gradients(x, mask, y)
                losses.append(loss)
                d = dx[cells]
                for name, at in (("paths", 0), ("words", WIDTH)):
                    ids, counts = (np.concatenate([getattr(f, a) for f in part]) for a in (name, name[:-1] + "_counts"))
                    share = np.repeat(d[:, at : at + WIDTH] / np.maximum(counts, 1)[:, None], counts, axis=0)
                    grads[name] = np.stack([np.bincount(ids, share[:, c], minlength=len(self.w[name])) for c in range(WIDTH)], axis=1).astype(np.float32)
                k += 1
                step = STEP * min(1, 4 * (1 - epoch / epochs))
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[name] -= step * (WORD_STEP if name == "words" else 1) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-7)
            last = float(np.mean(losses))
        return last

    def main_blocks(self, pages: list[Features]) -> list[np.ndarray]:
        """For each page which blocks are main text."""
        out: list[np.ndarray | None] = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].numbers))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]].numbers) <= CELLS:
                end += 1
            part = [pages[i] for i in order[at:end]]
            x, mask, (steps, page) = padded([self.inputs(f) for f in part])
            main = self.logits(x, mask)[steps, page] >= 0 if len(steps) else np.zeros(0, bool)
            for i, own in zip(order[at:end], np.split(main, np.cumsum([len(f.numbers) for f in part])[:-1])):
                out[i] = own
            at = end
        return out


def padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Inputs of several pages as (steps, pages, inputs), the mask of real steps, and where they lie, page by page."""
    sizes = np.array([len(x) for x in inputs])
    page = np.repeat(np.arange(len(inputs)), sizes)
    steps = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0, int)
    x = np.zeros((sizes.max(initial=0), len(inputs), INPUTS), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    x[steps, page] = np.concatenate(inputs) if len(inputs) else 0
    mask[steps, page] = 1
    return x, mask, (steps, page)


def thinned(f: Features, r: np.random.Generator) -> Features:
    """A page without some of its words: all words of four blocks of ten, some path words of all; a
    third of the pages have nothing but paths."""
    keep = r.random(len(f.paths)) > 0.15
    owner = np.repeat(np.arange(len(f.path_counts)), f.path_counts)
    bare = r.random() < 0.33
    blocks = np.repeat(r.random(len(f.word_counts)) > (1 if bare else 0.4), f.word_counts) & (r.random(len(f.words)) > 0.2)
    words_owner = np.repeat(np.arange(len(f.word_counts)), f.word_counts)
    return Features(f.paths[keep], np.bincount(owner[keep], minlength=len(f.path_counts)), f.words[blocks], np.bincount(words_owner[blocks], minlength=len(f.word_counts)), f.numbers * (not bare))


def known_labels(blocks: list[Block]) -> np.ndarray | None:
    """By the elements that say so; None where a page has no such element."""
    held = np.array([any(h in b.path for h in HOLDERS) for b in blocks], bool)
    if not held.any():
        return None
    return held & np.array([not any(o in b.path for o in OTHERS) for b in blocks], bool)


def _name(r: random.Random, role: str) -> list[str]:
    words = [r.choice(NAMES[role])] + ([r.choice(NAMES[role])] if r.random() < 0.3 else []) + ([r.choice(NEUTRAL)] if r.random() < 0.5 else [])
    r.shuffle(words)
    return list(dict.fromkeys(w.removesuffix("s") if len(w) > 3 else w for w in words))


def _other(r: random.Random, role: str, above: tuple[str, ...], prose: list[str]) -> list[Block]:
    """Some blocks of a role that is not the article."""
    tag = r.choice(TAGS[role])
    named = tag in ("<div>", "<section>", "<table>", "<td>", "<p>", "<ins>", "<ol>", "<ul>", "<article>") or r.random() < 0.5
    path = above + (tag, *(_name(r, role) if named else ()))
    if r.random() < 0.3:
        path += ("<div>", *([r.choice(NEUTRAL)] if r.random() < 0.5 else []))
    phrases = PHRASES[role].split("|")
    out = []
    if role in ("menu", "share", "footer", "header", "form"):
        for _ in range(r.randint(1, 8)):
            text, link = r.choice(phrases) if r.random() < 0.6 else " ".join(r.choice(prose).split()[: r.randint(1, 3)]), r.random() < 0.7
            inner = {"menu": ("<ul>", "<li>"), "share": ("<li>",), "footer": ("<p>",), "header": ("<div>",), "form": (r.choice(["<label>", "<button>", "<p>", "<option>"]),)}[role]
            out.append(Block(text, path + (inner if r.random() < 0.7 else ()) + (("<a>",) if link else ()), len(text) if link else 0))
        if role == "footer" and r.random() < 0.6:
            out.append(Block("© " + " ".join(r.choice(prose).split()[: r.randint(3, 15)]), path, 0))
    elif role == "comments":
        out.append(Block(r.choice(phrases[:6]), path + (r.choice(["<h2>", "<h3>", "<div>"]),), 0))
        for _ in range(r.randint(1, 5)):
            one = path + (r.choice(["<li>", "<div>", "<article>", "<p>"]), *(_name(r, "comments") if r.random() < 0.6 else ()))
            if r.random() < 0.6:
                out.append(Block(r.choice(phrases), one + (r.choice(["<span>", "<b>", "<cite>", "<div>"]),), 0))
            out.append(Block(r.choice(prose) if r.random() < 0.8 else r.choice(phrases), one + (("<p>",) if r.random() < 0.7 else ()), 0))
    else:
        if r.random() < 0.5:
            out.append(Block(r.choice(phrases), path + (r.choice(["<h3>", "<h4>", "<p>", "<strong>"]),), 0))
        for _ in range(r.randint(1, 4)):
            text, link = r.choice(prose) if r.random() < 0.7 else r.choice(phrases), role == "sidebar" and r.random() < 0.6
            text = text if r.random() < 0.4 else " ".join(text.split()[: r.randint(3, 20)])
            out.append(Block(text, path + (r.choice([("<p>",), (), ("<li>",)])) + (("<a>",) if link else ()), len(text) if link else 0))
    return out


def arranged(r: random.Random, article: list[str], prose: list[str]) -> tuple[list[Block], np.ndarray]:
    """An article's blocks in a layout made up from NAMES, TAGS and PHRASES, with other blocks of all
    roles around and in it; which of them are the article's."""
    top = ("<html>", "<body>")
    if r.random() < 0.5:
        top += ("<div>", *r.sample(NEUTRAL, r.randint(0, 2)))
    bare = r.random() < 0.12
    kind = r.random()
    if bare:
        own = top
    elif kind < 0.35:
        own = top + (r.choice(HOLDERS), *(_name(r, "article") if r.random() < 0.5 else ()))
    elif kind < 0.8:
        own = top + (r.choice(["<div>", "<div>", "<section>", "<td>"]), *_name(r, "article"))
    else:
        own = top + (r.choice(["<div>", "<td>", "<section>"]), *r.sample(NEUTRAL, r.randint(0, 1)))
    if not bare and r.random() < 0.3:
        own += ("<div>", *(_name(r, "article") if r.random() < 0.5 else ()))
    blocks: list[tuple[Block, bool]] = []

    def add(roles: list[str], chance: float, above: tuple[str, ...]) -> None:
        for role in roles:
            if r.random() < chance:
                blocks.extend((b, False) for b in _other(r, role, above, prose))

    if not bare and kind < 0.8:  # in a place that is told by its name, words that are common elsewhere
        article = [t if r.random() > 0.12 else r.choice([r.choice(r.choice(list(PHRASES.values())).split("|")), " ".join(t.split()[: r.randint(1, 3)])]) for t in article]
    crowd = 0.0 if bare and r.random() < 0.5 else r.choice([0.3, 0.6, 0.9])
    add(r.sample(["notice", "header", "menu", "advert", "form", "sidebar"], 6), crowd * 0.7, top)
    for k, text in enumerate(article):
        tag = r.choice([("<h1>",), ("<h2>",), ("<header>", "<h1>")]) if k == 0 and len(text) < 120 and r.random() < 0.8 else r.choice([("<p>",)] * 8 + [("<h2>",), ("<ul>", "<li>"), ("<blockquote>", "<p>"), ("<p>", "<b>"), ("<div>",), ("<pre>",), ()])
        blocks.append((Block(text, own + tag, 0 if r.random() < 0.8 else len(text) // r.randint(3, 12)), True))
        if not bare and r.random() < 0.08:
            add([r.choice(["advert", "share", "sidebar", "notice", "form"])], 1, own)
    add(["share"], crowd * 0.4, own)
    add(["comments"], crowd * 0.5, r.choice([own, top]))
    add(r.sample(["sidebar", "form", "advert", "notice", "menu"], 5), crowd * 0.5, top)
    add(["footer"], crowd, top)
    return [b for b, _ in blocks], np.array([x for _, x in blocks], bool)


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_characters: int = MAX_PAGE_CHARACTERS, epochs: int = EPOCHS) -> Labeller:
    """Learns from max_pages pages (page_id, html) of max_characters each at most, on the driver."""
    own = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64(F.col("page_id").cast("string")).alias("a"), F.xxhash64("html").alias("b"))
    own = own.filter(F.length("html").between(1, max_characters))
    # pages' hashes are ordered alone, so that no task or driver gets more than max_pages pages
    few = own.select("a", "b").distinct().orderBy("a", "b").limit(max_pages)
    chosen = own.join(F.broadcast(few), ["a", "b"]).groupBy("a", "b").agg(F.first("html").alias("html"))
    read = [leaf_blocks(x.html) for x in sorted(chosen.collect(), key=lambda x: (x.a, x.b))]
    read = [b for b in read if b]
    model = Labeller()
    if not read:
        model.w["out"][:], model.w["bias"][:] = 0, 10
        return model
    r = random.Random(7)
    examples = [(b, y) for b in read if (y := known_labels(b)) is not None]
    articles = [[b.text for b, main in zip(own, y) if main] for own, y in examples if y.any()] or [[b.text for b in own] for own in read]
    prose = [b.text for own in read for b in own if len(b.text.split()) >= 5] or [b.text for own in read for b in own]
    examples += [arranged(r, r.choice(articles)[: r.randint(1, 25)], prose) for _ in range(3 * max_pages)]
    model.train([features(b) for b, _ in examples], [y.astype(np.float32) for _, y in examples], epochs)
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """Each page's main text, its blocks parted by a blank."""
    read = [leaf_blocks(h) for h in pages]
    main = model.main_blocks([features(b) for b in read])
    return [" ".join(b.text for b, keep in zip(own, y) if keep) for own, y in zip(read, main)]


def extracted(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            html, at = table.column("html"), 0
            while at < len(html):  # a few megabytes at once
                end, characters = at, 0
                texts = []
                while end < len(html) and (end == at or characters < 4 << 20):
                    texts.append(html[end].as_py())
                    characters += len(texts[-1] or "")
                    end += 1
                own = main_texts(model, texts)
                part = table.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(own, pa.string()), pa.array(map(len, own), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at = end

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
