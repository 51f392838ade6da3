"""Main text of web pages: a bidirectional LSTM labels each page's leaf blocks in their order."""

from __future__ import annotations

import functools
import hashlib
import html
import io
import re
import zlib
from collections import Counter
from pathlib import Path as Path_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch, shared_dir

from .common import col, fresh, lower_batches
from .text import slices, words

TAG = re.compile(r"<!--|<(?:/?[a-zA-Z][^\s>/]*)(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+>|<[!?/][^>]*>")
NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")
#: Elements without an end, whose content is no markup, whose content is never text, and that don't end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Graphics, formulas and embedded objects: what they say is text of the block they stand in.
EMBEDDED = frozenset("audio canvas object picture svg video g text tspan math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split())
#: Block elements whose start ends an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SECTIONS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Buckets of the tag path and of the words, other numbers of a block, hidden units of each direction.
PATHS, WORDS, REST, HIDDEN = 512, 32, 6, 24
#: Blocks whose dense numbers stand in memory at a time, over all pages of a group; longer pages go by in such parts.
AT_ONCE = 1 << 14


@functools.lru_cache(1 << 16)
def _places(token: str) -> tuple[int, int, int, int]:
    """Two signed buckets of a path's token."""
    h = zlib.crc32(token.encode())
    return h % PATHS, 1 if h & 0x80000000 else -1, (h >> 8) % PATHS, 1 if h & 0x40000000 else -1


class Path:
    """Open elements with their signed hashed counts: each tag and class, id or role word counts once, however often it is open."""

    def __init__(self):
        self.stack: list[tuple[str, ...]] = []
        self.held: Counter[str] = Counter()
        self.vector = np.zeros(PATHS, np.int32)
        self.seen: dict[bytes, np.ndarray] = {}

    def _add(self, token: str, by: int) -> None:
        i, x, j, y = _places(token)
        self.vector[i] += by * x
        self.vector[j] += by * y

    def push(self, words: tuple[str, ...]) -> None:
        self.stack.append(words)
        for w in words:
            self.held[w] += 1
            if self.held[w] == 1:
                self._add(w, 1)

    def pop(self) -> str:
        words = self.stack.pop()
        for w in words:
            self.held[w] -= 1
            if not self.held[w]:
                self._add(w, -1)
        return words[0]

    def now(self) -> np.ndarray:
        """The counts, and the innermost two tags once more with their place; blocks of one path share one array of bytes (no count goes beyond 127)."""
        out = self.vector.copy()
        for k, words in enumerate(reversed(self.stack[-2:])):
            i, x, j, y = _places(f"{k}:{words[0]}")
            out[i] += x
            out[j] += y
        key = np.clip(out, -127, 127).astype(np.int8).tobytes()
        return self.seen.setdefault(key, np.frombuffer(key, np.int8))


def blocks(page: str) -> list[tuple[str, np.ndarray, int, int]]:
    """(text, path vector, characters in links, tags) of each leaf block in page order, white space single and references decoded.

    The path has every open element with its class, id and role words, at any depth. Comments,
    scripts, styles and the like hold no blocks, but noscript does, as it shows where scripts don't run; an element that is never closed ends with
    its parent, an unmatched end tag is ignored.
    """
    out: list[tuple[str, np.ndarray, int, int]] = []
    path = Path()
    parts: list[str] = []
    held: Counter[str] = Counter()  # open elements by name
    linked = tags = at = depth = 0

    def flush() -> None:
        nonlocal linked, tags
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, path.now(), linked, tags))
            parts.clear()
        linked = tags = 0

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += depth * (m.start() - at)
        tag, at = m.group(), m.end()
        if tag == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        name = NAME.match(tag)
        if name is None:
            continue
        name = name[1].lower()
        if tag[1] != "/":
            if name in RAW or name == "xmp":
                if not tag.endswith("/>"):
                    low = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
                    if name == "xmp":  # shown as it stands
                        parts.append(html.escape(page[at : low.start() if low else len(page)]))
                    end = -1 if low is None else page.find(">", low.start())
                    at = len(page) if end < 0 else end + 1
                continue
            if name in INLINE or name in EMBEDDED:
                tags += 1
                depth = 1 if name == "a" else depth
                continue
            flush()
            if name in VOID:
                continue
            close = CLOSES.get(name)
            if path.stack and (path.stack[-1][0] in close if close else name in SECTIONS and path.stack[-1][0] == "p"):
                held[path.pop()] -= 1
            marks = {w for g in MARK.findall(tag) for w in PART.findall(" ".join(g).lower())} if "=" in tag else set()
            path.push((name, *sorted(marks - {name})))
            held[name] += 1
        elif name in INLINE or name in EMBEDDED:
            depth = 0 if name == "a" else depth
            continue
        else:
            flush()
            while held[name]:
                last = path.pop()
                held[last] -= 1
                if last == name:
                    break
        depth = 0
    flush()
    return out


class Rows:
    """A page's blocks in numbers: each different path once and its place for each block, the other numbers for each block."""

    def __init__(self, page: list[tuple[str, np.ndarray, int, int]]):
        places: dict[int, int] = {}
        self.index = np.array([places.setdefault(id(path), len(places)) for _, path, *_ in page], np.int32)
        self.paths = np.zeros((len(places), PATHS), np.int8)
        for _, path, *_ in page:  # an array again and again, but no list of them
            self.paths[places[id(path)]] = path
        self.others = np.zeros((len(page), WORDS + REST), np.float32)
        texts = [text for text, *_ in page]
        n, count = np.array([len(t) for t in texts]), np.zeros(len(texts))
        for part in slices(texts):
            hashes, bounds = words(texts[part])
            count[part] = np.diff(bounds)
            owner = np.repeat(np.arange(part.stop - part.start), np.diff(bounds))
            place = owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64)
            sign = 1.0 - 2.0 * ((hashes >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
            v = np.bincount(place, sign, (part.stop - part.start) * WORDS).reshape(-1, WORDS)
            self.others[part, :WORDS] = 0.5 * v / np.maximum(1.0, np.sqrt((v * v).sum(axis=1, keepdims=True)))
        rest = self.others[:, WORDS:]
        if texts:
            rest[:, 0], rest[:, 1] = np.log1p(n) / 8, np.log1p(count) / 6
            rest[:, 2] = 3 * np.minimum(1, np.array([linked for *_, linked, _ in page]) / n)
            rest[:, 3] = np.minimum(1, np.array([tags for *_, tags in page]) / np.maximum(1, count))
            rest[:, 4] = [t[-1] in ".!?:;…" for t in texts]
            rest[:, 5] = np.arange(1, len(texts) + 1) / len(texts)

    def __len__(self) -> int:
        return len(self.index)

    def dense(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """(blocks, PATHS + WORDS + REST) of the blocks first to last: their paths, the directions of their hashed words, and sizes."""
        part = slice(first, last)
        return np.hstack([self.paths[self.index[part]].astype(np.float32), self.others[part]])


def features(pages: list[list[tuple[str, np.ndarray, int, int]]]) -> list[Rows]:
    """The numbers of each page's blocks."""
    return [Rows(page) for page in pages]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """A bidirectional LSTM with a logistic output for each block; numpy only."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = PATHS + WORDS + REST, HIDDEN
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * h)).astype(np.float32)
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p[f"c{way}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), h)
        self.p["o"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def run(self, way: str, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray], keep: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Hidden units (pages, blocks, HIDDEN) of one direction from ``state`` on, and the state behind them."""
        gates, (h, c) = x @ self.p[f"x{way}"] + self.p[f"c{way}"], state
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for k in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            z = gates[:, k] + h @ self.p[f"h{way}"]
            i, f, o = (sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            was, h_was, m = c, h, mask[:, k, None]
            c = m * (f * c + i * g) + (1 - m) * c
            h = m * (o * np.tanh(c)) + (1 - m) * h
            out[:, k] = h
            if keep is not None:
                keep.append((way, k, i, f, o, g, was, c, h_was, m))
        return out, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits (pages, blocks) of x (pages, blocks, d); ``keep`` gets what ``backward`` needs."""
        zero = np.zeros((len(x), HIDDEN), np.float32)
        h = np.concatenate([self.run(way, x, mask, (zero, zero), keep)[0] for way in "fb"], axis=2)
        if keep is not None:
            keep.append(h)
        return h @ self.p["o"] + self.p["ob"]

    def logits(self, pages: list[Rows], at_once: int = AT_ONCE) -> np.ndarray:
        """As ``forward``, over parts of at most ``at_once`` blocks (one block of each page at least), the state carried on from one to the next."""
        longest, step = max(map(len, pages)), max(1, at_once // len(pages))
        out = np.zeros((len(pages), longest), np.float32) + self.p["ob"]
        for way, own in (("f", self.p["o"][:HIDDEN]), ("b", self.p["o"][HIDDEN:])):
            state = (np.zeros((len(pages), HIDDEN), np.float32),) * 2
            for at in range(0, longest, step)[:: 1 if way == "f" else -1]:
                x, mask = padded([page.dense(at, at + step) for page in pages])
                h, state = self.run(way, x, mask, state)
                out[:, at : at + step] += h @ own
        return out

    def backward(self, x: np.ndarray, error: np.ndarray, keep: list) -> dict[str, np.ndarray]:
        """Gradients for the error (pages, blocks) of the logits."""
        h = keep.pop()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["ob"] = np.einsum("nt,nth->h", error, h), error.sum(keepdims=True).reshape(1)
        dh_all = error[:, :, None] * self.p["o"]
        dz_all = {way: np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32) for way in "fb"}
        at_way, dh, dc = None, None, None
        for way, k, i, f, o, g, was, c, h_was, m in reversed(keep):
            if way != at_way:
                at_way, dh, dc = way, np.zeros_like(c), np.zeros_like(c)
            part = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, 2 * HIDDEN)
            dh = dh + dh_all[:, k, part]
            th = np.tanh(c)
            own = dh * m
            dc_in = dc * m + own * o * (1 - th * th)
            dz = np.concatenate([dc_in * g * i * (1 - i), dc_in * was * f * (1 - f), own * th * o * (1 - o), dc_in * i * (1 - g * g)], axis=1)
            dz_all[way][:, k] = dz
            grad[f"h{way}"] += h_was.T @ dz
            dh = dh * (1 - m) + dz @ self.p[f"h{way}"].T
            dc = dc_in * f + dc * (1 - m)
        flat = x.reshape(-1, x.shape[2])
        for way in "fb":
            dz = dz_all[way].reshape(-1, 4 * HIDDEN)
            grad[f"x{way}"], grad[f"c{way}"] = flat.T @ dz, dz.sum(axis=0)
        return grad

    def fit(self, pages: list[tuple[Rows, np.ndarray]], *, epochs: int = 10, batch: int = 64, rate: float = 0.014, seed: int = 5) -> None:
        """Adam on the mean log loss of all blocks."""
        rng = np.random.default_rng(seed)
        m, v, step = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]) + rng.random() * 8)
            groups = [order[k : k + batch] for k in range(0, len(order), batch)]
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[k][0] for k in groups[g]])
                y, _ = padded([pages[k][1][:, None] for k in groups[g]])
                keep: list = []
                p = sigmoid(self.forward(x, mask, keep))
                grad = self.backward(x, ((p - y[:, :, 0]) * mask / mask.sum()).astype(np.float32), keep)
                step += 1
                size = np.sqrt(sum(float((q * q).sum()) for q in grad.values()))
                for k, q in grad.items():
                    q = q / max(1.0, size)
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.99 * v[k] + 0.01 * q * q
                    self.p[k] -= (rate * (1 - epoch / epochs / 1.2) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[Rows]) -> list[np.ndarray]:
        """For each page which blocks are main text; short pages go together, long ones alone."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, group = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])), []
        for k in [*order, None]:
            if group and (k is None or len(pages[k]) * (len(group) + 1) > AT_ONCE):
                logits = self.logits([pages[j] for j in group])
                for row, j in enumerate(group):
                    out[j] = logits[row, : len(pages[j])] > 0
                group = []
            if k is not None:
                group.append(k)
        return out


def padded(pages: list[np.ndarray | Rows]) -> tuple[np.ndarray, np.ndarray]:
    """(pages, blocks, numbers), zero behind a page's end, and where there are blocks."""
    pages = [page.dense() if isinstance(page, Rows) else page for page in pages]
    x = np.zeros((len(pages), max(map(len, pages)), pages[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, page in enumerate(pages):
        x[k, : len(page)], mask[k, : len(page)] = page, 1
    return x, mask


#: Marks main text in made pages.
TRUE = "\ue000"


class Maker:
    """Makes pages with known main text in many layouts, to train on: any words, so that markup, order, density and cue words decide.

    On a part of the pages classes and ids are dropped, on another they are made-up words, so that names are a hint, not a need.
    ``held`` takes names and layouts that training never sees, to test on.
    """

    ROOMS = [*["article", "main"] * 3, "article class='post'", "div class='content'", "div id='content'", "div class='article-body'", "div class='post-content'", "section class='entry-content'", "div class='story'", "div class='main-text'", "main id='main'"]
    HELD_ROOMS = ["div class='prose'", "section class='rich-text'", "div id='maincol'", "div class='td-body'"]
    HELD_JUNK = {"nav": ["div class='megadrop'", "ul id='crumbs'"], "head": ["div id='brandbar'"], "foot": ["div id='colophon'", "section class='legal'"], "side": ["div class='rail'", "div id='more-stories'"], "ad": ["div class='dfp-slot'", "div class='partner-offer'"], "note": ["div class='privacy-bar'", "div class='signup-box'"], "form": ["form class='lookup'"], "say": ["div class='thread'", "div id='responses'"], "share": ["div class='sharing'"]}
    JUNK = {
        "nav": ["nav", "nav class='menu'", "div class='menu'", "div id='navigation'", "div class='navbar'", "div class='breadcrumbs'", "ul class='nav'", "div class='pagination'", "div role='navigation'", "div class='toc-links'"],
        "head": ["header", "div class='header'", "div id='header'", "div class='site-header'", "div class='masthead'", "div class='topbar'", "div role='banner'"],
        "foot": ["footer", "div class='footer'", "div id='footer'", "div class='site-footer'", "div class='copyright'", "div role='contentinfo'"],
        "side": ["aside", "div class='sidebar'", "div id='sidebar'", "aside class='related'", "div class='related'", "section class='related-posts'", "div class='widget'", "div class='trending'", "div role='complementary'"],
        "ad": ["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div class='sponsored'", "div class='promo'", "div id='ad-top'", "div class='banner'", "p class='ad'", "aside class='ad'"],
        "note": ["div class='cookie'", "div class='cookie-notice'", "div class='notice'", "div id='consent'", "div class='alert'", "div class='popup'", "div class='newsletter'", "div class='subscribe'", "p class='notice'", "div class='modal'", "div class='gdpr'", "div class='disclaimer'", "div class='paywall'"],
        "form": ["form", "form class='search'", "form class='login'", "form id='signup'", "form action='/subscribe'"],
        "say": ["div class='comments'", "section id='comments'", "div class='comment'", "ul class='comments'", "div id='disqus'", "ol class='comment-list'", "div class='replies'", "section class='reader-comments'", "article class='comment'", "div class='discussion'"],
        "share": ["div class='share'", "div class='social'", "ul class='share-links'", "div class='tags'", "div class='toolbar'"],
    }
    CUES = {"nav": "Home Menu News Contact", "head": "Welcome Home Login", "foot": "© 2020 Copyright All rights reserved Privacy Terms conditions apply Imprint", "side": "Related Popular Most read", "ad": "Advertisement Sponsored Buy now Sale", "note": "We use cookies Accept Subscribe newsletter enable JavaScript", "form": "Search Email Password Submit", "say": "Comments Reply says wrote ago", "share": "Share Tweet Print"}
    #: Headings over the parts beside an article.
    HEADINGS = {"side": ["Popular", "Most read", "Related", "Trending", "More stories", "Latest"], "say": ["Comments", "{n} comments", "{n} responses", "Leave a reply", "Discussion", "{n} Comments so far"], "foot": ["About", "Contact", "Follow us"], "nav": ["Menu", "Sections"], "form": ["Search", "Log in"], "note": ["Subscribe"], "share": ["Share this"]}

    def __init__(self, seed: int = 11, held: bool = False):
        self.r, self.held, self.names = np.random.default_rng(seed), held, "given"
        self.rooms, self.kinds = (self.HELD_ROOMS, self.HELD_JUNK) if held else (self.ROOMS, self.JUNK)

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def open(self, tag: str) -> str:
        """The start tag's content as this page names things."""
        name = tag.split()[0]
        if self.names == "none" and tag in ("article class='comment'", "aside class='ad'", "p class='ad'", "p class='notice'"):
            return "div"  # nothing else would tell it from an article's own
        if self.names == "none" or " " not in tag:
            return name
        return tag if self.names == "given" else f"{name} class='{self.pick(['', 'c-', 'x_'])}{self.words(1).strip('.!').lower()}'"

    def words(self, n: int) -> str:
        syllables = "ka lo mi ter ing an de sch eau ción en the un st ra ou".split()
        made = ["".join(self.pick(syllables) for _ in range(int(self.r.integers(1, 5)))) for _ in range(n)]
        text = " ".join(made).capitalize()
        end = self.r.random()
        return text.upper() + "!!" if end < 0.07 else text + ("." if end < 0.8 else "")

    def line(self, mark: str, low: int, high: int) -> str:
        n = int(np.exp(self.r.uniform(np.log(low), np.log(high + 1))))
        text = self.words(max(1, n))
        if mark and self.names == "given" and self.r.random() < 0.06:  # an article may say what frames say
            text = " ".join(self.pick(list(self.CUES.values())).split()[: int(self.r.integers(1, 5))]) + self.pick([".", "", f" {text}"])
        return mark + (f"<b>{text}</b>" if self.r.random() < 0.05 else f"{text} <a href='#'>{self.words(2)}</a>" if self.r.random() < 0.08 else text)

    def junk(self, kind: str) -> str:
        tag, out = self.pick(self.kinds[kind]), []
        name = self.open(tag).split()[0]
        often = 0.5 if self.names == "given" else 1.0
        cue = lambda: " ".join(self.r.permutation(self.CUES[kind].split())[:3]) if self.r.random() < often else ""
        n = int(self.r.integers(1, 8 if kind in ("nav", "side", "say", "form") else 3))
        for _ in range(n):
            text = f"{cue() if kind != 'say' or self.r.random() < 0.5 else ''} {self.line('', 1, 4 if kind == 'nav' else 90 if kind == 'say' else 30)}"
            if kind in ("nav", "share") or (kind in ("side", "foot") and self.r.random() < 0.5):
                out.append(self.pick([f"<li><a href='/x'>{text}</a></li>", f"<a href='/x'>{text}</a><br>"]))
            elif kind == "form":
                out.append(self.pick([f"<label>{text}</label><input name='q'>", f"<p>{text}</p>", f"<select><option>{text}<option>{text}</select>", f"<button>{text}</button>"]))
            else:
                out.append(self.pick([f"<p>{text}</p>", f"<div>{text}</div>", text, f"<span>{text}</span>", f"<h3>{text}</h3>"] + ([f"<div class='comment'><p>{text}</p></div>", f"<li>{text}</li>"] if kind == "say" else [])))
        if kind in self.HEADINGS and name not in ("ul", "ol", "p") and self.r.random() < 0.4:
            h = self.pick(["h2", "h3", "h4", "div", "p", "b"])
            out.insert(0, f"<{h}>{self.pick(self.HEADINGS[kind]).format(n=int(self.r.integers(1, 200)))}</{h}>" + "<br>" * (h == "b"))
        inner = "".join(out)
        if kind == "note" and self.r.random() < 0.15:
            return f"<noscript>{inner}</noscript>"
        if name not in ("ul", "ol") and "<li>" in inner and self.r.random() < 0.7:
            inner = f"<ul>{inner}</ul>"
        if self.r.random() < 0.15:
            inner = f"<div>{inner}</div>"
        if self.r.random() < 0.02:
            inner = "<div>" * 70 + inner + "</div>" * 70
        return f"<{self.open(tag) if name == tag.split()[0] else name}>{inner}</{name}>"

    def room(self) -> str:
        """The main text: in a room of its own, or on some pages straight in the body, a font or a centre."""
        tag, out = self.pick([x for x in self.rooms if self.names == "given" or x[:3] in ("div", "sec")]), []
        wrap = self.pick(["p"] * 8 + ["div", "section", "td"])  # what holds a paragraph on this page
        if self.r.random() < 0.1:
            tag, wrap = self.pick([("", "p"), ("", "p"), ("font size='2'", "br"), ("center", "p"), ("center", "br"), ("", "br")])
        if self.r.random() < 0.8:
            out.append(f"<h1>{self.line(TRUE, 1, 12)}</h1>")
        for _ in range(int(np.exp(self.r.uniform(0, 3.2)))):
            kind, text = self.r.random(), lambda: self.line(TRUE, 1, 120)
            if wrap == "br" and kind < 0.8:
                out.append(f"{text()}{self.pick(['<br>', '<br><br>', '<br/><br/>'])}")
            elif kind < 0.59:
                out.append(f"<{wrap}>{text()}</{wrap}>")
            elif kind < 0.62:
                out.append(self.pick([f"<figure><img src='x'><figcaption>{self.line(TRUE, 1, 25)}</figcaption></figure>", f"<noscript><p>{text()}</p></noscript>", f"<noscript>{text()}</noscript>"]))
            elif kind < 0.72:
                out.append(self.pick([f"<p>{text()}<br>{text()}<br><br>{text()}</p>", f"<p>{text()}<p>{text()}", f"<p><b>{text()}<p>{text()}</p>", f"{text()}<br>{text()}"]))
            elif kind < 0.78:
                out.append(f"<h2>{self.line(TRUE, 1, 8)}</h2><p>{text()}</p>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{self.line(TRUE, 1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{text()}</blockquote>")
            elif kind < 0.89:
                out.append("<table><tr>" + "".join(f"<td>{self.line(TRUE, 1, 5)}" for _ in range(4)) + "</table>")
            elif kind < 0.91:
                out.append(f"<pre>{text()}</pre>")
            elif kind < 0.94:
                out.append(f"<div>{text()}</div>")
            elif self.names == "given":
                out.append(self.junk(self.pick(["ad", "ad", "share", "note", "side", "form"])))
        if self.r.random() < 0.1:
            out.append(self.junk("say"))
        inner = "".join(out)
        if not tag:
            return inner
        for _ in range(int(self.r.integers(0, 3))):
            box = self.open(f"div class='{self.pick(['inner', 'text', 'body', 'row', 'col', 'block'])}'")
            inner = f"<{box}>{inner}</div>"
        if self.r.random() < 0.02:
            inner = "<div>" * 70 + inner + "</div>" * 70
        return f"<{self.open(tag)}>{inner}</{tag.split()[0]}>"

    def page(self) -> str:
        kind = self.r.random()
        self.names = "given" if self.held or kind < 0.64 else "none" if kind < 0.8 else "made"
        some = lambda kinds, p: [self.junk(k) for k in kinds if self.r.random() < p]
        often = self.r.random() > 0.06  # else there is nothing but the article
        before = some(["note", "head", "nav", "ad", "nav", "side", "form"], 0.45 * often)
        after = some(["share", "ad", "say", "side", "form", "nav", "note", "foot"], 0.4 * often)
        room = self.room() if self.r.random() < 0.97 or not often else ""
        body = "".join([*(before[k] for k in self.r.permutation(len(before))), room, *after])
        if self.r.random() < (0.3 if self.held else 0.06):  # a table holds the columns
            body = "<table><tr>" + "".join(f"<td>{x}</td>" for x in ["".join(before), room, "".join(after)]) + "</tr></table>"
        for _ in range(int(self.r.integers(0, 2))):
            body = f"<div{self.pick(['', ' class=wrapper', ' id=page', ' class=container'])}>{body}</div>"
        return f"<html><head><title>{self.words(4)}</title></head><body>{body}</body></html>"

    def example(self) -> tuple[Rows, np.ndarray]:
        found = blocks(self.page())
        label = np.array([TRUE in t for t, *_ in found], np.float32)
        clean = [(t.replace(TRUE, "").strip() or "-", *rest) for t, *rest in found]
        return features([clean])[0], label


@functools.cache
def trained(pages: int = 2800, seed: int = 11) -> Labeller:
    """A labeller fitted on so many made pages; the same for the same arguments."""
    maker, model = Maker(seed), Labeller()
    model.fit([e for e in (maker.example() for _ in range(pages)) if len(e[1])])
    return model


def stored(spark: SparkSession, pages: int = 2800, seed: int = 11) -> Labeller:
    """``trained``, from the shared folder if another run left it there under the same code and arguments.

    Weights are written under a name of their own and renamed when they are complete, so no session reads half of them.
    """
    key = hashlib.sha256(Path_(__file__).read_bytes() + repr((pages, seed)).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/html-labeller-{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    model = Labeller()
    if fs.exists(done):
        model.p = dict(np.load(io.BytesIO(spark.read.parquet(path).first().weights)))
    else:
        model = trained(pages, seed)
        np.savez(data := io.BytesIO(), **model.p)
        own = scratch(spark, "html-labeller-writing")
        spark.createDataFrame([(bytearray(data.getvalue()),)], "weights binary").coalesce(1).write.parquet(own)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if fs.exists(hadoop(path)) or not fs.rename(hadoop(own), hadoop(path)):
            fs.delete(hadoop(own), True)  # another session was faster, with the same weights
    return model


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """The main text of each page: its blocks so labelled, in page order, joined by spaces."""
    if not pages:
        return []
    found = [blocks(p) for p in pages]
    chosen = model.label(features(found))
    return [" ".join(t for (t, *_), y in zip(f, c, strict=True) if y) for f, c in zip(found, chosen, strict=True)]


def extract(pages: DataFrame, model: Labeller, *, html_col: str = "html") -> DataFrame:
    """``pages`` with a column ``main_text`` (with underscores before it if there is one).

    The whole page is parsed into leaf blocks, and the network labels each one in the context of all others. Null
    html, or a page without text, gives an empty text. Null ids and repeated rows are pages like others. A very long page is one row: its
    task holds the page, the text and WORDS + REST numbers of each block, and PATHS bytes for each different tag path; the network's own numbers stand for
    AT_ONCE blocks at a time. What noscript holds counts as shown; scripts, styles, templates, frames and text areas do not. Other columns pass through; an empty table gives an empty result.
    """
    lower_batches(pages.sparkSession, rows=500)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # the network's weights: some 100 kB

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series(main_texts(["" if x is None else x for x in column], shared.value))

    return pages.withColumn(fresh(pages, "main_text"), text(col(html_col)))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), stored(spark))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
