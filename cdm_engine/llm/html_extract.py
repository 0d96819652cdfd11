"""Main-text extraction with a tree-structured graphical model (operator 3).

A page becomes a tree of block elements with its text blocks as leaves. Every node is content or not.
The model has a potential for the root, one for each parent-child pair of states (by the child's tag; text
blocks are one kind), and one for each node's features given its state (of an element: words of class, id and role, how much of the
page's text it has, how much of that is links, where it begins, whether it has the heading; of a
text block: length, share of links, end of sentence, the element around it). Sum-product messages, first upward from the leaves, then downward from
the root, give each node's exact content marginal; text blocks of at least ``threshold`` are kept.

The potentials are smoothed relative frequencies of labelled pages: those of ``labelled_pages``, labelled by hand, each
counted ``LABELLED_TIMES`` times, and those that ``training_pages`` makes from a small grammar of page parts (a label is the attribute ``data-main`` of elements,
inherited downwards, never read as a feature); ``train`` takes any labelled pages of that form. Many of the generated elements have made-up
class names, which count as the one word ``?``, and so do words that were never seen: the model learns what to make of names that say nothing.

White space inside a block becomes one space; character references are decoded; scripts, styles, head,
comments, form controls and hidden elements are no text at all. Defined cases: null and empty html give an empty text;
broken markup is closed as browsers do it for blocks (an open paragraph ends where a block begins; a tag without an end takes the
rest of the page; a dropped element without an end ends with the block around it); very long
pages and deep trees take linear time and no recursion.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages
from ._text import tidied

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("template svg select button head object math canvas audio video".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body dd dt li thead tbody tfoot tr td th caption summary".split())
#: An element of the key's kind ends open elements of these kinds, up to one of the bounds.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
BOUNDS = frozenset("ul ol menu dl table".split())
P_BOUNDS = BOUNDS | {"article", "section", "main", "body", "div", "td", "li"}

# Each begins where it is asked to and never steps back, so that a page is read once.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+>")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"(?<![\w-])(class|id|role|style|data-main)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)", re.I)
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[a-z]+")


def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


_RAW_END = {name: _ends(name) for name in RAW}


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closes, name, attributes) of each tag; comments and declarations have the name ''. What is
    inside raw elements is part of their tag."""
    at, size = 0, len(source)
    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= size:
            return
        closes = source[at + 1] == "/"
        m = _NAME.match(source, at + 1 + closes)
        if m:
            name, rest = m[0].lower(), _REST.match(source, m.end())
            end = rest.end() if rest else size
            attributes = source[m.end() : end - 1]
            if rest and name in _RAW_END and not closes:
                close = _RAW_END[name].search(source, end)
                end = close.end() if close else size
        elif source.startswith("<!--", at):
            found = None if source.startswith(("<!-->", "<!--->"), at) else _COMMENT_END.search(source, at + 4)
            end = found.end() if found else source.index(">", at) + 1 if source.startswith(("<!-->", "<!--->"), at) else size
            name, attributes = "", ""
        elif source[at + 1] in "!?" or closes:
            end = source.find(">", at) + 1 or size
            name, attributes = "", ""
        else:
            at += 1
            continue
        yield at, end, closes, name, attributes
        at = end


class Page:
    """parent, kind, features and (for training) labels of a page's nodes; ``texts`` of the leaves."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.kind: list[str] = ["root"]
        self.words: list[list[str]] = [[]]
        self.label: list[bool] = [False]
        self.hidden: list[bool] = [False]
        self.texts: dict[int, str] = {}
        self.linked: dict[int, float] = {}
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
        self.parts: list[tuple[str, bool]] = []
        self._parse(source)
        self.features = self._features()

    def _flush(self) -> None:
        top = self.stack[-1][1]
        if self.parts and not self.hidden[top]:
            decoded = [(references.unescape(t), link) for t, link in self.parts]
            text = " ".join("".join(t for t, _ in decoded).split())
            if text:
                size = sum(len(t) for t, _ in decoded)
                self.texts[len(self.parent)] = text
                self.linked[len(self.parent)] = sum(len(t) for t, link in decoded if link) / size
                self._add(top, "text", [], self.label[top], False)
        self.parts.clear()

    def _add(self, parent: int, kind: str, words: list[str], label: bool, hidden: bool) -> None:
        self.parent.append(parent)
        self.kind.append(kind)
        self.words.append(words)
        self.label.append(label)
        self.hidden.append(hidden)

    def _cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.open[self.stack.pop()[0]].pop()

    def _last(self, names: Iterable[str]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _end(self, names: tuple[str, ...], bounds: frozenset[str]) -> None:
        """Ends open elements of these names that no bound hides: of p the last, of others all."""
        bound = self._last(bounds)
        while (k := self._last(names)) > bound:
            self._cut(k)
            if names[0] == "p":
                return

    def _begin(self, name: str, attributes: str, hidden: bool) -> None:
        if name in CLOSES_P:
            self._end(("p",), P_BOUNDS)
        if name in SIBLINGS:
            self._end(SIBLINGS[name], BOUNDS)
        top = self.stack[-1][1]
        words, label = [], self.label[top]
        if "=" in attributes:
            for key, value in _NAMES.findall(attributes):
                if key.lower() == "data-main":
                    label = value.strip("\"'") == "1"
                elif key.lower() != "style":
                    words += _WORD.findall(value.lower())
        self._add(top, name, words, label, hidden or self.hidden[top])
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, len(self.parent) - 1))

    @staticmethod
    def _unseen(attributes: str) -> bool:
        if "hidden" not in (low := attributes.lower()) and "none" not in low:
            return False
        styles = [v for k, v in _NAMES.findall(attributes) if k.lower() == "style"]
        return bool(_HIDDEN.search(_QUOTED.sub('""', attributes))) or any(_UNSEEN.search(v) for v in styles)

    def _parse(self, source: str) -> None:
        at, link = 0, False
        skip, depth, inner = "", 0, Counter()  # inside a dropped element: its name, how many of it, blocks opened there
        for begin, end, closes, name, attributes in tags(source):
            if begin > at and not skip:
                self.parts.append((source[at:begin], link))
            at = end
            if skip:
                if closes and name in BLOCKS and not inner[name] and self.open.get(name):
                    skip = ""  # a block around the dropped element ends, and this with it
                else:
                    if name == skip:
                        depth += -1 if closes else not attributes.endswith("/")
                    elif name in BLOCKS and name not in VOID:
                        inner[name] += -1 if closes else 1
                    if not depth or (skip == "head" and name == "body"):
                        skip = ""
                    if skip or name != "body":
                        continue
            if not name:
                continue
            if closes:
                if name == "a":
                    link = False
                elif self.open.get(name):
                    self._flush()
                    link = False
                    self._cut(self.open[name][-1])
            elif name in RAW:
                self.parts.append((" ", False))
            elif name in VOID and name not in BLOCKS:
                self.parts.append((" ", False))
            elif name in DROPPED or (name not in BLOCKS and self._unseen(attributes)):
                if not attributes.endswith("/"):
                    skip, depth = name, 1
                    inner.clear()
                self.parts.append((" ", False))
            elif name in BLOCKS:
                self._flush()
                link = False
                if name == "hr":
                    self._end(("p",), BOUNDS)
                elif name not in ("html", "body") or not self.open.get(name):
                    self._begin(name, attributes, self._unseen(attributes))
            elif name == "a":
                link = True
        if at < len(source) and not skip:
            self.parts.append((source[at:], link))
        self._flush()

    def _features(self) -> list[list[str]]:
        n = len(self.parent)
        size, linked, heading, first = [0] * n, [0.0] * n, [k == "h1" for k in self.kind], [0] * n
        total = 0
        for i in range(n):  # nodes stand in page order
            first[i] = total
            if i in self.texts:
                size[i] = len(self.texts[i])
                linked[i] = size[i] * self.linked[i]
                total += size[i]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            size[up] += size[i]
            linked[up] += linked[i]
            heading[up] = heading[up] or heading[i]
        out = []
        for i in range(n):
            links = math.ceil(3 * min(linked[i] / size[i], 1.0)) if size[i] else 0
            if i in self.texts:
                text = self.texts[i]
                out.append([f"size={min(int(math.log2(len(text) + 1)), 9)}", f"links={links}", f"stop={text[-1] in '.!?:'}", f"in={self.kind[self.parent[i]]}"])
            elif not i:
                out.append([])
            else:
                part = size[i] / total if total else 0.0
                place = first[i] / total if total else 0.0
                own = [f"word={w}" for w in self.words[i]] or ["word="]
                out.append([*own, f"part={sum(part >= x for x in (0.02, 0.1, 0.3, 0.7))}", f"linked={links}", f"place={sum(place >= x for x in (0.02, 0.3, 0.7, 0.95))}", f"heading={heading[i]}"])
        return out


#: Powers of the potentials, by kind of feature: as features aren't independent of each other, their frequencies alone claim too
#: much. Chosen one after the other for the fewest wrong blocks of 200 generated pages that nothing is counted on.
WEIGHTS = {"word": 1.4, "part": 0.25, "linked": 0.75, "place": 0.25, "heading": 1.4, "size": 0.25, "links": 1.0, "stop": 0.25, "in": 0.5, "pair": 1.4}
#: Kinds of features that text blocks have.
LEAF = ("size", "links", "stop", "in")


class Model:
    """Log potentials, and exact marginals by two passes of sum-product messages."""

    def __init__(self, root: list[float], pair: dict[str, list[list[float]]], feature: dict[str, tuple[float, float]]):
        self.root, self.pair, self.feature = root, pair, feature

    def state(self) -> tuple:
        return self.root, self.pair, self.feature

    def known(self, features: list[str]) -> list[str]:
        """Those that the model has; all unseen words of an element together are the word ``?``."""
        known = [f for f in features if f in self.feature]
        return known + ["word=?"] * (not any(f.startswith("word=") for f in known) and any(f.startswith("word=") for f in features) and "word=?" in self.feature)

    def marginals(self, page: Page) -> list[float]:
        n = len(page.parent)
        unary = []
        for features in page.features:
            a = b = 0.0
            for f in self.known(features):
                w = self.feature[f]
                a, b = a + w[0], b + w[1]
            unary.append((a, b))
        below = [list(u) for u in unary]  # unary and the messages from the children
        below[0] = [below[0][0] + self.root[0], below[0][1] + self.root[1]]
        message = [(0.0, 0.0)] * n
        any_kind = self.pair["element"]
        kind = [self.pair.get(k, any_kind) for k in page.kind]
        for i in range(n - 1, 0, -1):
            (a, b), p = below[i], kind[i]
            up = (_sum(p[0][0] + a, p[0][1] + b), _sum(p[1][0] + a, p[1][1] + b))
            message[i] = up
            own = below[page.parent[i]]
            own[0] += up[0]
            own[1] += up[1]
        belief = [(0.0, 0.0)] * n
        belief[0] = tuple(below[0])
        for i in range(1, n):
            above, p, up = belief[page.parent[i]], kind[i], message[i]
            a, b = above[0] - up[0], above[1] - up[1]
            own = (below[i][0] + _sum(a + p[0][0], b + p[1][0]), below[i][1] + _sum(a + p[0][1], b + p[1][1]))
            total = _sum(*own)
            belief[i] = (own[0] - total, own[1] - total)
        return [math.exp(min(b[1] - _sum(*b), 0.0)) for b in belief]


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Potentials from labelled pages. An element's own label is that of most of its text."""
    root: Counter = Counter()
    pair: dict[str, Counter] = {"element": Counter()}
    feature: dict[bool, Counter] = {True: Counter(), False: Counter()}
    nodes: Counter = Counter()
    for source in pages:
        page = Page(source)
        weight = [[0, 0] for _ in page.parent]
        for i in range(len(page.parent) - 1, -1, -1):
            if i in page.texts:
                weight[i][page.label[i]] += len(page.texts[i])
            if i:
                up = weight[page.parent[i]]
                up[0] += weight[i][0]
                up[1] += weight[i][1]
        state = [w[1] > w[0] for w in weight]
        root[state[0]] += 1
        for i, features in enumerate(page.features):
            leaf = i in page.texts
            if i:
                for kind in (page.kind[i],) if leaf else (page.kind[i], "element"):
                    pair.setdefault(kind, Counter())[state[page.parent[i]], state[i]] += 1
            nodes[leaf, state[i]] += 1
            for f in {_known_word(f) for f in features}:
                feature[state[i]][f] += 1
    leafy = {f: f.split("=")[0] in LEAF for s in feature.values() for f in s}
    weight = lambda f: WEIGHTS[f.split("=")[0]]
    log = lambda k, n: math.log((k + smooth) / (n + 2 * smooth))
    return Model(
        [log(root[s], root.total()) for s in (False, True)],
        {k: [[WEIGHTS["pair"] * log(c[a, b], c[a, False] + c[a, True]) for b in (False, True)] for a in (False, True)] for k, c in pair.items()},
        {f: tuple(weight(f) * log(feature[s][f], nodes[leaf, s]) for s in (False, True)) for f, leaf in leafy.items()},
    )


# ---- labelled pages ---------------------------------------------------------------------------

#: Made-up names in labelled pages begin so.
_MADE_UP = "zq"


def _known_word(feature: str) -> str:
    return "word=?" if feature.startswith(f"word={_MADE_UP}") else feature


# Names that pages on the web commonly give their parts.
_WRAPPERS = ("article", "main", "section class=article", "div class=post-content", "div id=content", "div class=entry", "div class=story-body", "div role=main", "article class=post", "div class=article-body", "div itemprop=articleBody", "div class=text", "td id=main")
_OUTER = ("body", "body", "div class=page", "div id=wrapper", "div class=container", "div class=layout", "div id=root")
_PARTS = {
    "menu": ("nav", "nav class=menu", "div class=nav", "div id=menu", "ul class=navigation", "div class=breadcrumb", "div role=navigation", "ol class=breadcrumbs", "div class=pagination", "div class=toc"),
    "header": ("header", "div id=header", "div class=masthead", "div class=top-bar", "header class=site-header", "div role=banner", "div class=branding", "div class=hero-banner"),
    "footer": ("footer", "div id=footer", "div class=site-footer", "div class=copyright", "div role=contentinfo", "div class=legal", "div class=colophon"),
    "side": ("aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class=widget", "div class=recommended", "div role=complementary", "div class=more-stories", "section class=read-next", "div class=trending", "div class=popular", "div class=author-bio"),
    "advert": ("div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "aside class=ad", "p class=ad", "div id=banner", "div class=dfp-slot", "ins class=adsbygoogle", "div class=outbrain", "div class=taboola", "div class=commercial"),
    "notice": ("div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div class=alert", "div class=consent", "div class=popup", "p class=notice", "div role=alert", "div class=paywall", "div id=gdpr", "div class=modal", "dialog", "div class=disclaimer", "div role=dialog"),
    "form": ("form", "form class=search", "div class=newsletter", "form class=subscribe", "div class=login", "fieldset", "div class=signup", "div role=search"),
    "comments": ("section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class=replies", "div class=discussion", "div id=disqus_thread", "div id=respond", "div class=reviews"),
    "share": ("div class=share", "ul class=social", "div class=tags", "div class=byline-links", "div class=sharing", "div class=follow-us"),
}


def _element(spec: str, inner: str, label: str = "") -> str:
    name, *rest = spec.split()
    attributes = "".join(f' {r.split("=")[0]}="{r.split("=")[1]}"' for r in rest)
    return f"<{name}{attributes}{label}>{inner}</{name}>"


def training_pages(n: int = 1200, seed: int = 11, nameless: float = 0.25) -> list[str]:
    """Labelled pages: content and every kind of surroundings in many forms, this share of them without a name that says something."""
    r = random.Random(seed)

    def words(low: int, high: int, stop: str = ".") -> str:
        k = max(low, int(math.exp(r.uniform(math.log(low), math.log(high)))))
        return " ".join("".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(k)).capitalize() + stop

    def made_up(spec: str, share: float) -> str:
        """The element with a name that says nothing, or without one."""
        name = spec.split()[0]
        if r.random() >= share * nameless / 0.25:
            return spec
        if name in ("nav", "footer", "aside", "header", "article", "main", "form", "dialog", "fieldset") and r.random() < 0.5:
            name = "div"
        return f"{name} class={_MADE_UP}{''.join(r.choice('abcdef') for _ in range(5))}" if r.random() < 0.8 else name

    def plain(name: str) -> str:
        """An element of the main text: sometimes with a name, which says nothing."""
        return f'<{name} class="{_MADE_UP}{r.randint(0, 9)}">' if r.random() < 0.15 else f"<{name}>"

    def content() -> str:
        kind = r.random()
        if kind < 0.72:
            return f"{plain('p')}{'<b>' * (r.random() < 0.1)}{words(1, 150)}" + (f' <a href="/x">{words(1, 4, "")}</a> {words(1, 20)}' if r.random() < 0.15 else "") + "</p>" * (r.random() < 0.9)
        if kind < 0.80:
            return f"<h{r.randint(2, 4)}>{words(1, 8, r.choice(('', '?')))}</h2>"
        if kind < 0.86:
            name = r.choice(("ul", "ol"))
            return plain(name) + "".join(f"<li>{words(1, 25, r.choice(('', '.')))}</li>" for _ in range(r.randint(2, 6))) + f"</{name}>"
        if kind < 0.90:
            return f"{plain('blockquote')}<p>{words(5, 50)}</p></blockquote>"
        if kind < 0.93:
            return f"{plain('figure')}<img src=x><figcaption>{words(2, 14)}</figcaption></figure>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 3, '')}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.98:
            return f"<div>{words(3, 120)}</div>" if r.random() < 0.5 else f"{plain('div')}<p>{words(5, 120)}</p><p>{words(5, 120)}</p></div>"
        return f"<pre>{words(3, 40, '')}</pre>" if kind < 0.99 else f"{plain('div')}{words(2, 9, '')}</div>"

    def title(n: int) -> str:
        level = r.choice((2, 3, 3, 4))
        return f"<h{level}>{words(1, n, '')}</h{level}>"

    def other(kind: str) -> str:
        links = lambda: "".join(f'<li><a href="/a">{words(1, 4, "")}</a></li>' for _ in range(r.randint(2, 9)))
        if kind in ("menu", "share"):
            inner = f"<ul>{links()}</ul>" if r.random() < 0.8 else " ".join(f"<a href=b>{words(1, 2, '')}</a>" for _ in range(5))
        elif kind == "comments":
            inner = title(3) + "".join(_element(made_up("div class=comment", 0.3), f"<span>{words(1, 2, '')}</span><p>{words(1, 60)}</p>") for _ in range(r.randint(1, 6)))
        elif kind == "side":
            inner = title(4) + (f"<ul>{links()}</ul>" if r.random() < 0.6 else f"<p>{words(3, 60)}</p>" if r.random() < 0.6 else f'<a href="/a">{words(2, 9, "")}</a> <a href="/b">{words(2, 9, "")}</a>')
        elif kind == "form":
            inner = title(4) * (r.random() < 0.4) + f"<label>{words(1, 4, '')}</label><input name=q><p>{words(2, 15)}</p>" + (f"<fieldset>{words(1, 5, '')}</fieldset>" if r.random() < 0.2 else "")
        elif kind == "header":
            inner = f"<a href=/>{words(1, 3, '')}</a><p>{words(2, 8)}</p>" + (f"<h1>{words(1, 3, '')}</h1>" if r.random() < 0.2 else "")
        else:
            inner = words(2, 30) if r.random() < 0.6 else f"<p>{words(2, 40)}</p>"
        return _element(made_up(r.choice(_PARTS[kind]), 0.25), inner, ' data-main="0"')

    pages = []
    for _ in range(n):
        body = [f"<h1>{words(2, 12, r.choice(('', '.')))}</h1>"] * (r.random() < 0.9) + [content() for _ in range(max(1, int(math.exp(r.uniform(0, 3.2)))))]
        for kind in ("advert", "share", "notice", "form", "side", "comments"):
            if r.random() < 0.2:
                body.insert(r.randint(1, len(body)), other(kind))
        if r.random() < 0.08:  # nothing around the main text
            main = "".join(x if "data-main" in x[: x.index(">")] else x.replace(">", ' data-main="1">', 1) for x in body)
        else:
            main = _element(made_up(r.choice(_WRAPPERS), 0.25), "".join(body), ' data-main="1"')
        before = [other(k) for k in ("header", "menu", "notice", "advert", "form", "side") if r.random() < 0.5]
        after = [other(k) for k in ("comments", "side", "share", "form", "advert", "notice") if r.random() < 0.4] + [other("footer")] * (r.random() < 0.85)
        r.shuffle(before)
        r.shuffle(after)
        pages.append(f"<!DOCTYPE html><html><head><title>t</title></head><body>{_element(made_up(r.choice(_OUTER).replace('body', 'div'), 0.3), ''.join((*before, main, *after)))}</body></html>")
    return pages


#: A page labelled by hand counts as so many of the generated ones (5, 10 and 20 do equally well on left-out ones).
LABELLED_TIMES = 10


@cache
def default_model() -> Model:
    return train(training_pages() + labelled_pages.PAGES * LABELLED_TIMES)


def main_blocks(source: str, model: Model, threshold: float = 0.5) -> tuple[list[str], int]:
    """(text blocks of the main text in page order, number of all text blocks)."""
    page = Page(source)
    if not page.texts:
        return [], 0
    p = model.marginals(page)
    return [t for i, t in page.texts.items() if p[i] >= threshold], len(page.texts)


def extract(pages: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every page."""
    state = (model or default_model()).state()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*state)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [main_blocks(h or "", own, threshold) for h in part.column(2).to_pylist()]
                texts = ["\n\n".join(kept) for kept, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([n for _, n in found], pa.int64()),
                        pa.array([len(kept) for kept, _ in found], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
