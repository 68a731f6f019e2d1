"""Main text of web pages: gradient-boosted trees over DOM nodes.

A page becomes a tree of elements.  Boosted regression trees score every
element by subtree density, attribute words, depth and sibling statistics.
Decoding is hierarchical: going up the tree, an element's subtree is worth its
own score and its best children's, or nothing if it is dropped; so no text is
kept whose ancestor is dropped.

The trees are trained on a bounded sample, the ``sample`` pages of least hash.
Each is used as it is, its main text being what its article or main element (or,
without one, the element with most unlinked paragraphs) holds beside blocks of
the kinds to be dropped, and ``VARIANTS`` times rebuilt: the same blocks as
paragraphs, headings, lists, tables and quotes under other wrappers, with or
without telling names, among menus, notices, adverts, forms, teasers and comments
made of other pages' words, so that the truth is known and no tag or name decides.

Nulls: a null or empty page has an empty text; a null key is kept.  Text in
scripts, styles, templates and the head is never read.  Broken markup is read as
browsers read it: an unfinished last tag is dropped, a paragraph ends where a
block begins, a quote opens a value only after an equals sign.  Repeated pages
give equal texts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

SAMPLE, VARIANTS, TREES, DEPTH, RATE, BINS = 100, 3, 30, 5, 0.3, 32
#: Elements that are read before they are judged together, and elements whose features are held at a time.
NODES, SLICE = 20_000, 8_192

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_RAW = re.compile(r"script|style|textarea|title|xmp|iframe|noembed|noframes", re.I)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNREAD = {"script", "style", "template", "noscript", "head", "title", "textarea", "svg", "iframe", "select", "option", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
_TAGS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "a", "button", "table", "blockquote", "figure", "pre", "td")
#: Words of class, id and role attributes, by what they tell.
_ATTRIBUTE_WORDS = (
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"),
    ("nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "toolbar"),
    ("footer", "foot", "copyright"),
    ("header", "masthead", "topbar"),
    ("side", "sidebar", "aside", "widget", "related", "recommended", "complementary"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus"),
    ("notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "newsletter", "subscribe"),
    ("form", "search", "login", "signup"),
    ("article", "content", "main", "post", "entry", "story", "body", "text"),
)
_PATH_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "table", "ul", "blockquote")
_GROUP_OF = {w: 1 << g for g, words in enumerate(_ATTRIBUTE_WORDS) for w in words}
_SENTENCE = re.compile(r"[.,;:!?]")
_DROPPED_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}


class Node:
    __slots__ = ("tag", "words", "parent", "children", "depth", "letters", "linked", "nodes", "paragraphs", "place", "marks", "own", "begin", "groups", "path", "attributes")

    def __init__(self, tag: str, words: frozenset, parent: Node | None, attributes: str = ""):
        self.attributes = attributes
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list = []  # elements, and texts as str
        self.depth = parent.depth + 1 if parent else 0
        self.letters = self.linked = self.paragraphs = self.marks = self.own = self.begin = 0
        self.groups = 0  # bits of _ATTRIBUTE_WORDS on the element
        for w in words:
            self.groups |= _GROUP_OF.get(w, 0)
        self.path = (parent.path if parent else 0) | (1 << _PATH_TAGS.index(tag) if tag in _PATH_TAGS else 0)
        self.nodes, self.place = 1, len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in page order."""
    root = Node("#root", frozenset(), None)
    here, order, at = root, [root], 0
    unread = 0  # where text starts to count after raw text
    for m in _TOKEN.finditer(html):
        if m.start() < unread:
            continue
        if m.start() > max(at, unread):
            here.children.append(html[max(at, unread) : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if m.end() == len(html) and html[-1] != ">":
            break
        tag = m[2].lower()
        if m[1]:
            node = here
            while node.parent is not None and node.tag != tag:
                if node.tag in ("article", "main", "body", "td", "aside", "nav") and tag in _INLINE | {"p", "li"}:
                    node = root  # an end tag doesn't close what it doesn't own
                    break
                node = node.parent
            if node.parent is not None:
                here = node.parent
            continue
        if tag not in _INLINE:
            node = here
            while node.parent is not None and (node.tag in _INLINE or node.tag == "p"):
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        if tag in _CLOSES and here.tag in _CLOSES[tag]:
            here = here.parent or root
        words = frozenset(w for g in _ATTRIBUTE.finditer(m[3]) for w in re.split(r"[^a-z]+", (g[2] or g[3] or g[4] or "").lower()) if w) if m[3] else frozenset()
        node = Node(tag, words, here, m[3])
        order.append(node)
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if _RAW.fullmatch(tag):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, m.end())
            at = unread = end.end() if end else len(html)
            continue
        here = node
    tail = html[max(at, unread) :]
    if tail and not re.match(r"</?[a-zA-Z]", tail):
        here.children.append(tail.split("<")[0] if re.search(r"<[/a-zA-Z!]?[^>]*\Z", tail) else tail)
    for node in reversed(order):
        if node.tag in _UNREAD:
            node.children = []
        for c in node.children:
            if isinstance(c, str):
                node.own += len(c.strip())
                node.marks += len(_SENTENCE.findall(c))
        node.letters += node.own
        if node.tag == "a":
            node.linked = node.letters
        if node.tag in ("p", "blockquote", "pre"):
            node.paragraphs += 1
        if node.parent:
            up = node.parent
            up.letters, up.linked, up.nodes, up.paragraphs = up.letters + node.letters, up.linked + node.linked, up.nodes + node.nodes, up.paragraphs + node.paragraphs
            up.marks += node.marks
    for node in order:  # letters of the page before each element
        at = node.begin
        for c in node.children:
            if isinstance(c, str):
                at += len(c.strip())
            else:
                c.begin, at = at, at + c.letters
    return root, order


def feature_rows(order: list[Node]) -> Iterator[list]:
    """The features of each element, in page order."""
    page = max(1, order[0].letters)
    above: dict[int, int] = {}  # attribute groups of ancestors
    beside: dict[int, tuple[list[Node], Counter[str], dict[int, int]]] = {}  # for each parent, its child elements
    none: tuple = ([], Counter(), {})
    for node in order:
        up = node.parent
        inner = [c for c in node.children if isinstance(c, Node)]
        beside[id(node)] = inner, Counter(c.tag for c in inner), {id(c): k for k, c in enumerate(inner)}
        over = above[id(up)] | up.groups if up else 0
        above[id(node)] = over
        peers, tags, nth = beside[id(up)] if up else none
        k = nth.get(id(node), 0)
        letters = max(1, node.letters)
        yield [
            node.depth, node.letters, node.linked / letters, node.letters / node.nodes, node.paragraphs, node.nodes, node.own,
            100 * node.marks / letters, node.letters / page, node.begin / page, (node.begin + node.letters) / page,
            node.place, len(peers), tags[node.tag], node.letters / max(1, up.letters) if up else 1.0, up.linked / max(1, up.letters) if up else 0.0,
            peers[k - 1].letters if k else -1, peers[k + 1].letters if k + 1 < len(peers) else -1, (up.letters - up.own) / max(1, len(peers)) if up else 0, up.paragraphs if up else 0,
            _TAGS.index(up.tag) if up and up.tag in _TAGS else -1, *(node.tag == t for t in _TAGS),
            *(node.groups >> g & 1 for g in range(len(_ATTRIBUTE_WORDS))), *(over >> g & 1 for g in range(len(_ATTRIBUTE_WORDS))), *(node.path >> t & 1 for t in range(len(_PATH_TAGS))),
        ]


def features(order: list[Node]) -> np.ndarray:
    """A row for each element."""
    return np.array(list(feature_rows(order)), dtype=np.float64)


def scores(model: Trees, pages: list[list[Node]]) -> list[np.ndarray]:
    """Log-odds of each element of some pages; the features of ``SLICE`` elements are held at a time."""
    rows, parts = chain.from_iterable(map(feature_rows, pages)), []
    while some := list(islice(rows, SLICE)):
        parts.append(model.log_odds(np.array(some, dtype=np.float64)))
    return np.split(np.concatenate(parts), np.cumsum([len(order) for order in pages])[:-1])


class Trees:
    """Gradient boosting for log-odds, with splits at quantiles."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)])
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        raw = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree: list[tuple] = []
            self._grow(tree, binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            raw += self._leaf(tree, binned)
        return self

    def _grow(self, tree: list[tuple], x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        me = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0, 0, 0, RATE * total_g / (total_h + 1)))
        best = (1e-6, -1, 0)
        if depth and len(rows) > 1:
            for f in range(x.shape[1]):
                b = x[rows, f]
                size = len(self.edges[f]) + 1
                left_g, left_h = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
                if len(left_g):
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            left = self._grow(tree, x, g, h, rows[goes], depth - 1)
            right = self._grow(tree, x, g, h, rows[~goes], depth - 1)
            tree[me] = (best[1], best[2], left, right, 0.0)
        return me

    @staticmethod
    def _leaf(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        f, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            inner = f[at] >= 0
            goes = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return value[at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = np.empty(x.shape, dtype=np.int16)
        for k, e in enumerate(self.edges):
            binned[:, k] = np.searchsorted(e, x[:, k], side="left")
        return self.start + sum(self._leaf(t, binned) for t in self.trees)


def kept(order: list[Node], scores: np.ndarray) -> set[int]:
    """Elements whose text is kept: an element only with all its ancestors."""
    best = {}
    for node, s in zip(reversed(order), scores[::-1].tolist(), strict=True):
        # Weight by the text that the decision is about, so that a large block can be dropped with all it holds.
        best[id(node)] = s * (1 + node.letters**0.5) + sum(max(0.0, best[id(c)]) for c in node.children if isinstance(c, Node))
    keep: set[int] = set()
    for node in order:
        if (node.parent is None or id(node.parent) in keep) and (best[id(node)] > 0 or node.parent is None):
            keep.add(id(node))
    return keep


def blocks_of(root: Node, keep: set[int]) -> list[str]:
    """The kept text, block by block."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif id(item) in keep:
            if item.tag not in _INLINE:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
        elif item.tag not in _INLINE:
            close()
    close()
    return out


def labels(order: list[Node]) -> np.ndarray:
    """1 for elements that hold main text, in a page as it is."""
    bad = sum(1 << g for g in range(8))
    mains = [n for n in order if n.tag in ("article", "main")]
    if not mains:
        value = {id(n): 0 for n in order}
        for n in order:
            if n.parent and n.tag in ("p", "pre", "blockquote") and not n.groups & bad:
                value[id(n.parent)] += n.letters - 2 * n.linked
        mains = [max(order, key=lambda n: value[id(n)])] if max(value.values()) >= 200 else []
    good, state, chosen = np.zeros(len(order)), {}, {id(n) for n in mains}
    for i, node in enumerate(order):
        up = state.get(id(node.parent), (False, False))
        dropped = up[1] or node.tag in _DROPPED_TAGS or bool(node.groups & bad)
        state[id(node)] = (up[0] or id(node) in chosen, dropped)
        good[i] = state[id(node)][0] and not dropped and node.letters > 0
    return _upward(order, good)


def _upward(order: list[Node], good: np.ndarray) -> np.ndarray:
    """Elements that hold a good one are good."""
    index = {id(n): i for i, n in enumerate(order)}
    for i in range(len(order) - 1, 0, -1):
        if good[i]:
            good[index[id(order[i].parent)]] = 1
    return good


#: Marks main text in rebuilt pages; no page that is read has it as an attribute's name.
_TRUE = "data-true"
_NAMED = ("post-body", "content", "entry", "story", "article-text", "main", "page-text", "b7f", "x1 y2", "wrap", "col-8", "container", "")


def rebuilt(blocks: list[str], others: list[str], rng: random.Random) -> str:
    """A page with these blocks as its main text (elements marked as such) among blocks made of other pages' words."""
    pick, draw = rng.choice, rng.randint
    words = " ".join(others).split() or ["word"]

    def some(low: int, high: int) -> str:
        at = draw(0, max(0, len(words) - high))
        return escape(" ".join(words[at : at + draw(low, high)]))

    paragraph = lambda: f"<p>{some(15, 90)}</p>"
    link = lambda low=1, high=3: f'<a href="/{draw(1, 999)}">{some(low, high)}</a>'
    named = lambda *names: pick((f'class="{pick(names)}"', f'id="{pick(names)}"', f"class={pick(names)}"))
    links = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    menu = lambda: pick((f"<nav>{links(draw(1, 9))}</nav>", f"<div {named('menu', 'nav', 'breadcrumb')}>{links(draw(1, 9))}</div>", f"<div {named('menu', 'toolbar')}>{' '.join(link() for _ in range(draw(1, 9)))}</div>", f"<div>{links(draw(5, 12))}</div>"))
    header = lambda: pick((f"<header>{link()} {some(1, 5)}</header>", f"<div {named('masthead', 'header', 'topbar')}>{link()}<p>{some(2, 8)}</p></div>"))
    footer = lambda: pick((f"<footer>&copy; {some(3, 20)}</footer>", f"<div {named('footer', 'copyright')}><p>{some(3, 25)}</p>{link()}</div>", f"<footer>{paragraph()}{links(3)}</footer>"))
    side = lambda: pick((f"<aside><h3>{some(1, 3)}</h3>{links(draw(2, 6))}</aside>", f"<div {named('sidebar', 'related', 'widget', 'recommended')}><h3>{some(1, 3)}</h3>{paragraph()}{link()}</div>", f"<aside>{paragraph()}</aside>"))
    notice = lambda: pick((f"<div {named('cookie', 'consent', 'notice', 'alert', 'popup', 'newsletter')}><p>{some(5, 40)} {link()}</p></div>", f'<div role="alert"><p>{some(4, 20)}</p></div>'))
    advert = lambda: f"<div {named('ad', 'advert', 'sponsored', 'promo', 'banner')}>{pick((some(3, 20), paragraph()))}</div>"
    form = lambda: pick((f'<form action="/s"><label>{some(1, 2)}</label><input name="q"><button>{some(1, 2)}</button></form>', f"<div {named('login', 'signup', 'search')}><form><p>{some(3, 12)}</p><input></form></div>"))
    teaser = lambda: f"<div{pick(('', ' class=teaser', ' class=b9'))}><h3>{link(2, 6)}</h3><p>{some(5, 25)} {link()}</p></div>"
    remark = lambda: "".join(f"<{(t := pick(('div', 'li')))} {named('comment', 'reply')}><b>{some(1, 2)}</b>{''.join(paragraph() for _ in range(draw(1, 2)))}</{t}>" for _ in range(draw(1, 4)))
    comments = lambda: pick((f"<div {named('comments', 'discussion', 'replies')}>{remark()}</div>", f"<section {named('comments', 'disqus')}>{''.join(paragraph() for _ in range(draw(1, 4)))}</section>"))
    outside = lambda kinds, most: "".join(pick(kinds)() for _ in range(draw(0, most)))

    def shown(text: str, k: int) -> str:
        if rng.random() < 0.2:  # short headings, cells and lines of code
            text = " ".join(text.split()[: draw(1, 4)]) or text
        t = escape(text)
        if k == 0 and len(text) < 200:
            return f"<h1 {_TRUE}>{t}</h1>"
        if len(text) < 60 and rng.random() < 0.5:
            return f"<{(h := pick(('h2', 'h3')))} {_TRUE}>{t}</{h}>"
        half = t.split()
        a, b = " ".join(half[: len(half) // 2]), " ".join(half[len(half) // 2 :])
        return pick((
            f"<p {_TRUE}>{t}</p>", f"<p {_TRUE}>{t}</p>", f"<p {_TRUE}>{t}</p>", f"<p {_TRUE}>{t}</p>", f"<p {_TRUE}>{a} <a href='/x'>{b[:20]}</a>{b[20:]}</p>", f"<div {_TRUE}>{t}</div>", f"<blockquote {_TRUE}><p {_TRUE}>{t}</p></blockquote>", f"<pre {_TRUE}>{t}</pre>",
            f"<ul><li {_TRUE}>{a}</li><li {_TRUE}>{b}</li></ul>", f"<table><tr><td {_TRUE}>{a}</td><td {_TRUE}>{b}</td></tr></table>", f"<table><tr><th {_TRUE}>{' '.join(half[:2])}</th><td {_TRUE}>{' '.join(half[2:])}</td></tr></table>", f"<h2 {_TRUE}>{' '.join(half[:4])}</h2><p {_TRUE}>{' '.join(half[4:])}</p>",
        ))

    inside = [shown(t, k) for k, t in enumerate(blocks)]
    for _ in range(draw(0, 2)):
        inside.insert(draw(0, len(inside)), pick((advert, side, notice, comments, form, menu))())
    if rng.random() < 0.3:
        inside.append(comments())
    tag = pick(("article", "article", "main", "div", "div", "section", "td"))
    held = f"<{tag} {named(*_NAMED)}>{''.join(inside)}</{tag}>"
    if tag == "td":
        held = f"<table><tr><td>{links(draw(2, 6))}</td>{held}</tr></table>"
    for _ in range(draw(0, 2)):
        held = f"<{(t := pick(('div', 'main', 'section')))} {named(*_NAMED)}>{held}</{t}>"
    before, after = outside((menu, header, notice, advert, form, side, teaser), 4), outside((footer, comments, side, advert, teaser, teaser, menu, form, notice), 5)
    return f"<!DOCTYPE html><html><head><title>{some(1, 5)}</title></head><body>{before}{held}{after}{pick((footer(), ''))}</body></html>"


def truth(html: str) -> tuple[str, list[str]]:
    """A rebuilt page without its marks, and its main text block by block."""
    root, order = parse(html)
    keep = {id(n) for n in order if n.tag != "#root" and _TRUE in n.attributes}
    good = np.array([float(id(n) in keep) for n in order])
    good = _upward(order, good)
    return html.replace(f" {_TRUE}", ""), blocks_of(root, {id(n) for n, g in zip(order, good, strict=True) if g or _inside(n, keep)})


def _inside(node: Node, keep: set[int]) -> bool:
    while node is not None:
        if id(node) in keep:
            return True
        node = node.parent
    return False


def train(pages: list[str]) -> Trees:
    x, y, texts = [], [], []
    for html in pages:
        root, order = parse(html)
        good = labels(order)
        x.append(features(order))
        y.append(good)
        texts.append(blocks_of(root, {id(n) for n, g in zip(order, good, strict=True) if g}))
    rng = random.Random(20240117)
    texts = [t for t in texts if t] or [["Some words of a page that is read.", "It has two paragraphs, and this is the second."]]
    for k, blocks in enumerate(texts * max(VARIANTS, 60 // len(texts))):
        # Other lengths of articles, and other pages' words around them.
        blocks = [b[:20_000] for b in blocks]
        cut = blocks if k % 2 else blocks[: rng.randint(1, 4)]
        cut = [c for b in cut for c in ([b] if len(b) < 400 or rng.random() < 0.5 else [b[: len(b) // 2], b[len(b) // 2 :]])]
        _, order = parse(rebuilt(cut, texts[(k * 7 + 1) % len(texts)], rng))
        keep = {id(n) for n in order if _TRUE in n.attributes}
        good = np.array([float(_inside(n, keep) and n.letters > 0) for n in order])
        x.append(features(order))
        y.append(_upward(order, good))
    return Trees().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(keys, text): each page's main text, its blocks joined by an empty line."""
    of = common.least_hashes(pages.select(html).where(F.length(html) < 200_000), html, sample)
    model = pages.sparkSession.sparkContext.broadcast(train([r[0] for r in of.collect() if r[0]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, nodes = 0, [], 0
            for i, h in enumerate(batch.column(len(keys))):
                held.append(parse(h.as_py() or ""))
                nodes += len(held[-1][1])
                if nodes < NODES and i + 1 < len(batch):
                    continue
                found = scores(model.value, [order for _, order in held])
                texts = ["\n\n".join(blocks_of(root, kept(order, s))) for (root, order), s in zip(held, found, strict=True)]
                rows = batch.slice(at, len(held))
                yield pa.record_batch([*(rows.column(k) for k in range(len(keys))), pa.array(texts, pa.string())], names=[*keys, "text"])
                at, held, nodes = i + 1, [], 0

    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInArrow(run, f"{schema}, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark, 200)
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
