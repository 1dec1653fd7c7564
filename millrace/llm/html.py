"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into block-level elements (text-level elements such as ``a`` or ``b`` belong
to the block around them).  Each element gets features of its subtree (how much text, how
dense, how much of it in links, in paragraphs, how many controls), of its attribute tokens and
its ancestors', of its depth and of its siblings; boosted trees give the probability that it
is main text.  Decoding is hierarchical: going up from the leaves, each element is kept whole,
dropped whole or left to its children, whichever is likeliest, so an element is never kept
inside a dropped one, nor dropped inside one that is kept whole.

The trees are trained here, on pages that ``training_pages`` writes with known main text.

Parts of forms that ask (labels, buttons) are left out wherever they stand.  Formulas (MathML) and
what an ``object`` holds are text of the block around them; an ``annotation`` repeats its formula
and is left out.

Text: character references are decoded, white space within a block becomes one space, blocks
are joined by a line feed in page order.  A block is an uninterrupted run of text in one
block-level element.  ``br`` counts as white space.

Edge cases: a null or empty page has an empty text; markup that is cut off is read as far
as it goes; unclosed elements end with their parent or where a following element implies it;
repeated rows give equal rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import ready, table

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_OUT_OF_HEAD = re.compile(r"</head[^>]*>|(?=<body\b)", re.I)

# Element names of the HTML standard by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg head title iframe canvas audio video annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd link map mark meta meter nobr object output progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
FORMULA = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
CONTROLS = frozenset("input button select textarea option fieldset label".split())
PROMPTS = frozenset("button label legend option".split())  # parts of forms wherever they stand: their own text is never main text
CLOSED_BY_BLOCK = PROMPTS | {"p"}
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ALSO_CLOSES = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}
KINDS = {k: i for i, names in enumerate(["p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tr td th", "div section", "article main", "nav header footer aside form"], 1) for k in names.split()}


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "depth", "chars", "links", "points", "own", "inner", "paragraph", "controls", "before", "index")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...], before: int) -> None:
        self.tag, self.parent, self.tokens, self.before = tag, parent, tokens, before
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.links = self.points = self.own = self.inner = self.paragraph = self.controls = 0


@lru_cache(maxsize=1 << 16)
def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[0][:6].lower(), m[1] or m[2] or m[3] or ""
        if name.startswith("hidden"):
            out.append("hidden")
        elif name.startswith("style"):
            if "display" in value.lower() and "none" in value.lower():
                out.append("hidden")
        else:
            out += _TOKEN.findall(value.lower())
    return tuple(out)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block-level elements in page order, the root first, and blocks of text with the element each is in."""
    root = Node("#root", None, ("#root",), 0)
    nodes, blocks, open_, run = [root], [], root, []
    hidden: str | None = None
    deep = links = total = 0
    opened: Counter[str] = Counter()  # open elements by tag, so that an end tag without one costs no search

    def close(node: Node) -> None:
        """End ``node`` and all that is open in it."""
        nonlocal open_
        while open_ is not node.parent:
            opened[open_.tag] -= 1
            open_ = open_.parent

    def close_run() -> None:
        nonlocal total
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((open_, text))
                open_.own += len(text)
                open_.points += sum(map(text.count, ".,;:!?"))
                total += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        begin = m.start() if m else end
        if begin > at and hidden is None:
            text = page[at:begin]
            if "&" in text:
                text = html.unescape(text)
            run.append(text)
            if links:
                open_.links += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if hidden is not None:
                if tag == hidden:
                    deep -= 1
                    if not deep:
                        hidden = None
                continue
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in FORMULA:
                if opened[tag]:
                    node = open_
                    while node.tag != tag:
                        node = node.parent
                    close_run()
                    close(node)
                    links = 0
                elif tag == "p":
                    close_run()
        elif m[2]:
            tag = m[2].lower()
            if hidden is not None:
                if tag == hidden and tag not in RAW and not m[3].endswith("/"):
                    deep += 1
                continue
            if tag in HIDDEN or tag == "textarea" or tag == "select":
                if m[3].endswith("/") and tag not in RAW:
                    continue
                if tag in ("textarea", "select"):
                    open_.controls += 1
                if tag in RAW:
                    stop = _end_of(tag).search(page, at)
                    at = stop.end() if stop else end
                else:
                    hidden, deep = tag, 1
                    if tag == "head":  # a head may lack its end: the body ends it
                        stop = _OUT_OF_HEAD.search(page, at)
                        hidden, deep = None, 0
                        at = stop.end() if stop else _end_of_head(page, at)
                continue
            if tag in CONTROLS:
                open_.controls += 1
            if tag == "br":
                run.append(" ")
            if tag in INLINE or tag in FORMULA:
                if tag == "a":
                    links = 1
                continue
            close_run()
            links = 0
            if tag in CLOSED_BY_SAME:
                node, limits, also = open_, CLOSED_BY_SAME[tag], ALSO_CLOSES.get(tag, tag)
                if opened[tag] or opened[also]:
                    while node is not root and node.tag not in (tag, also) and node.tag not in limits:
                        node = node.parent
                    if node.tag in (tag, also):
                        close(node)
            elif open_.tag in CLOSED_BY_BLOCK:
                close(open_)
            if tag in VOID:
                continue
            if tag in ("html", "body"):
                continue
            tokens = _tokens if len(m[3]) < 2000 else _tokens.__wrapped__  # long ones aren't remembered
            node = Node(tag, open_, tokens(tag, m[3].lower()), total)
            open_.children.append(node)
            nodes.append(node)
            if not m[3].endswith("/"):
                open_ = node
                opened[tag] += 1
    close_run()
    for i, node in enumerate(nodes):
        node.index = i
    for node in reversed(nodes):
        node.chars += node.own
        if node.tag in ("p", "blockquote", "pre"):
            node.paragraph = node.chars
        up = node.parent
        if up:
            up.chars += node.chars
            up.links += node.links
            up.points += node.points
            up.paragraph += node.paragraph
            up.controls += node.controls
            up.inner += node.inner + 1
    return nodes, blocks


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I)


def _end_of_head(page: str, at: int) -> int:
    """Where a head without end tag and body ends: before the first element that can't be in it."""
    while m := _TAG.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag and tag not in ("meta", "link", "base", "title", "script", "style", "noscript", "template"):
            return m.start()
        if tag in RAW:
            stop = _end_of(tag).search(page, at)
            if not stop:
                break
            at = stop.end()
    return len(page)


N_FEATURES = 22


def features(nodes: list[Node], odds: dict[str, float]) -> list[tuple[float, ...]]:
    """A row for each element."""
    total = max(1, nodes[0].chars)
    log = math.log1p
    low, high = [0.0] * len(nodes), [0.0] * len(nodes)
    places, sames = [0.5] * len(nodes), [1.0] * len(nodes)
    for node in nodes:
        n, tags = len(node.children), Counter(c.tag for c in node.children)
        if n > 1:
            for k, c in enumerate(node.children):
                places[c.index], sames[c.index] = k / n, tags[c.tag] / n
    out = []
    for node in nodes:
        scores = [odds.get(t, 0.0) for t in node.tokens]
        up = node.parent
        worst, best = min(scores), max(scores)
        if up:
            low[node.index], high[node.index] = min(low[up.index], worst), max(high[up.index], best)
            n, place, same = len(up.children), places[node.index], sames[node.index]
            share, around = node.chars / max(1, up.chars), (up.chars - up.own) / n
            above_low, above_high = low[up.index], high[up.index]
        else:
            n, place, same, share, around, above_low, above_high = 1, 0.5, 1.0, 1.0, node.chars, 0.0, 0.0
        chars = max(1, node.chars)
        out.append(
            (
                node.depth, log(node.chars), node.links / chars, node.chars / total, log(node.inner), node.chars / (1 + node.inner), log(node.own), worst, best, sum(scores),
                above_low, above_high, place, log(n), same, share, log(around), node.points / chars, node.paragraph / chars, node.before / total, KINDS.get(node.tag, 0), min(3, node.controls),
            )
        )
    return out


# --- boosted trees ------------------------------------------------------------------------

ROUNDS, DEPTH, RATE, BINS = 50, 4, 0.25, 48


@dataclass
class Trees:
    """Complete trees: of each, the feature and threshold of every inner node and the value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss, with histograms of quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    inner = 2**DEPTH - 1
    trees: tuple[list, list, list] = ([], [], [])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, 0)
            if len(own) > 20:
                gs, hs = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                    if len(gl):
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, e[k], k)
            feature[node], threshold[node] = best[1], best[2]
            at[own] = 2 * node + 1 + (binned[own, best[1]] > best[3] if np.isfinite(best[2]) else 0)
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        margin += value[leaf]
        for own, new in zip(trees, (feature, threshold, value), strict=True):
            own.append(new)
    return Trees(*[np.array(t) for t in trees], base)


# --- training pages -----------------------------------------------------------------------


def _words(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        w = "".join(rng.choice(("ba", "lo", "mer", "ti", "son", "ur", "a", "ek", "vi", "né", "or")) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", "", "", "", ",", "."]))
    return (" ".join(out)).capitalize() + rng.choice([".", ".", ".", "", "!"])


def _link(rng: random.Random, n: int = 2) -> str:
    return f'<a href="/{rng.randint(1, 999)}">{_words(rng, rng.randint(1, n))}</a>'


_JUNK_NAMES = {
    "ad": "ad ads advert advertisement sponsored promo banner adsbygoogle sponsor",
    "side": "sidebar side related widget recommended popular trending rail teaser",
    "note": "notice cookie consent alert gdpr popup modal newsletter subscribe signup message warning",
    "comments": "comments comment replies discussion responses disqus thread reply",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs topbar links tabs pagination pager",
    "top": "header masthead top branding logo hero",
    "foot": "footer foot bottom copyright legal colophon",
    "form": "form search login contact subscribe-form",
    "share": "share social sharing tags meta byline author buttons toolbar",
}
_GOOD_NAMES = "content article post entry story main body text post-content entry-content article-body story-body page"


def _named(rng: random.Random, kind: str) -> str:
    names = _JUNK_NAMES[kind].split()
    own = rng.choice(names) + rng.choice(["", "", "-box", "-wrap", " block", "s", " col"])
    return rng.choice([f'class="{own}"', f'class="{own}"', f'id="{own.replace(" ", "-")}"', f"class={own.split()[0]}"])


def _junk(rng: random.Random, kind: str) -> str:
    """A piece of page that is no main text."""
    name = _named(rng, kind) if rng.random() < 0.85 else ""
    close = (lambda tag: f"</{tag}>") if rng.random() < 0.97 else (lambda tag: "")
    items = lambda n, long=3: "".join(f"<li>{_link(rng, long)}" + rng.choice(["</li>", "</li>", ""]) for _ in range(n))
    if kind == "menu":
        tag = rng.choice(["nav", "nav", "nav", "div", "ul"])
        inner = items(rng.randint(2, 12)) if tag == "ul" else rng.choice([f"<ul>{items(rng.randint(2, 12))}</ul>", " | ".join(_link(rng) for _ in range(rng.randint(2, 9)))])
        return f"<{tag} {name if tag != 'nav' or rng.random() < 0.4 else ''}>{inner}</{tag}>"
    if kind == "top":
        tag = rng.choice(["header", "div"])
        return f"<{tag} {name}><h1>{_words(rng, 3)}</h1>{rng.choice(['', '<p>' + _words(rng, rng.randint(4, 12)) + '</p>'])}{rng.choice(['', _junk(rng, 'menu')])}{close(tag)}" if rng.random() < 0.5 else f"<{tag} {name}>{_link(rng)} {_words(rng, 5)}</{tag}>"
    if kind == "foot":
        tag = rng.choice(["footer", "footer", "div"])
        name = "" if tag == "footer" and rng.random() < 0.7 else _named(rng, "foot")
        return f"<{tag} {name}>{rng.choice(['&copy; ', 'Copyright ', ''])}{_words(rng, rng.randint(3, 30))}{rng.choice(['', '<p>' + _words(rng, 20) + '</p>', '<ul>' + items(4) + '</ul>'])}</{tag}>"
    if kind == "comments":
        tag = rng.choice(["div", "section", "ol", "ul"])
        sub = "li" if tag in ("ol", "ul") else "div"
        inner = "".join(f'<{sub} class="{rng.choice(["comment", "reply", "response", "comment-item"])}"><p>{_words(rng, rng.randint(5, 60))}</p></{sub}>' if rng.random() < 0.7 else f"<p>{_words(rng, rng.randint(5, 60))}</p>" for _ in range(rng.randint(1, 6)))
        return f"<{tag} {_named(rng, 'comments')}>{rng.choice(['', '<h3>' + _words(rng, 2) + '</h3>'])}{inner}</{tag}>"
    if kind == "form":
        return f"<form {rng.choice(['', 'class=form', 'id=search'])}><label>{_words(rng, rng.randint(1, 8))}</label><input name=q><button>{_words(rng, 1)}</button>{rng.choice(['', '<p>' + _words(rng, rng.randint(4, 25)) + '</p>'])}</form>"
    if kind == "side":
        tag = rng.choice(["aside", "aside", "div", "section"])
        name = "" if tag == "aside" and rng.random() < 0.6 else _named(rng, "side")
        body = rng.choice([f"<ul>{items(rng.randint(2, 8), 8)}</ul>", f"<p>{_words(rng, rng.randint(5, 60))}</p>" * rng.randint(1, 2), _words(rng, rng.randint(5, 40))])
        return f"<{tag} {name}>{rng.choice(['', '<h2>' + _words(rng, 3) + '</h2>', '<h3>' + _words(rng, 2) + '</h3>'])}{body}</{tag}>"
    tag = rng.choice(["div", "div", "div", "section", "p", "ul" if kind == "share" else "div"])
    name = name or _named(rng, kind)
    inner = items(rng.randint(2, 5)) if tag == "ul" else rng.choice([_words(rng, rng.randint(3, 40)), _words(rng, rng.randint(3, 14)) + " " + _link(rng)] + ([] if tag == "p" else ["<p>" + _words(rng, rng.randint(4, 50)) + "</p>"]))
    return f"<{tag} {name}>{inner}</{tag}>"


def _main(rng: random.Random) -> str:
    """Main text, within marks that tell it from the rest."""
    parts = [f"<h1>{_words(rng, rng.randint(2, 12))}</h1>"] if rng.random() < 0.8 else []
    shut = rng.random() < 0.6
    for _ in range(rng.randint(1, 14)):
        r = rng.random()
        if r < 0.66:
            n = rng.choice([3, 10, 25, 60, 140])
            text = _words(rng, rng.randint(2, n))
            if rng.random() < 0.2:
                text += " " + _link(rng, 5) + " " + _words(rng, rng.randint(1, n))
            parts.append(f"<p>{text}" + ("</p>" if shut or rng.random() < 0.5 else ""))
        elif r < 0.74:
            parts.append(f"<p><b>{_words(rng, rng.randint(3, 20))}<br>")
        elif r < 0.80:
            tag = rng.choice(["h2", "h3"])
            parts.append(f"<{tag}>{_words(rng, rng.randint(1, 7))}</{tag}>")
        elif r < 0.87:
            tag = rng.choice(["ul", "ol"])
            parts.append(f"<{tag}>" + "".join(f"<li>{_words(rng, rng.randint(2, 25))}" + ("</li>" if shut else "") for _ in range(rng.randint(2, 7))) + f"</{tag}>")
        elif r < 0.91:
            parts.append(f"<blockquote>{_words(rng, rng.randint(5, 40))}</blockquote>")
        elif r < 0.94:
            parts.append("<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
        elif r < 0.97:
            parts.append(f"<pre>{_words(rng, rng.randint(5, 30))}</pre>")
        else:
            parts.append(f"<div>{_words(rng, rng.randint(10, 50))}</div>")
    mark = [f"\x01{x}\x02" for x in parts]
    for kind in ("ad", "share", "side", "form", "note", "comments"):
        if rng.random() < 0.12:
            mark.insert(len(mark) if kind == "comments" else rng.randint(0, len(mark)), _junk(rng, kind))
    return "".join(mark)


def training_page(rng: random.Random) -> str:
    """A page; what stands between the characters 1 and 2 is main text."""
    main = _main(rng)
    how = rng.random()
    if how < 0.45:
        main = f"<article{rng.choice(['', '', ' class=post', ' id=main'])}>{main}</article>"
    elif how < 0.6:
        main = f"<main>{main}</main>"
    elif how < 0.9:
        main = f'<div {rng.choice(["class", "id"])}="{rng.choice(_GOOD_NAMES.split())}">{main}</div>'
    else:
        main = f"<div>{main}</div>" if rng.random() < 0.6 else main
    if rng.random() < 0.25:
        main = f"<main>{main}</main>" if "<main>" not in main else f"<div class=\"wrapper\">{main}</div>"
    before = [k for k in ("top", "menu", "note", "ad", "form", "side") if rng.random() < (0.75 if k == "menu" else 0.3)]
    after = [k for k in ("comments", "share", "side", "ad", "form", "note", "foot") if rng.random() < (0.75 if k == "foot" else 0.25)]
    rng.shuffle(before)
    body = "".join(_junk(rng, k) for k in before) + main + "".join(_junk(rng, k) for k in after)
    if rng.random() < 0.3:
        body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["wrapper", "container", "page", "site", "layout"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_words(rng, 4)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"


TRAINING_PAGES = 1200


@dataclass
class Extractor:
    trees: Trees
    odds: dict[str, float]


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, seed: int = 20240711) -> Extractor:
    """Trees and token odds from generated pages; the same in every process."""
    rng = random.Random(seed)
    parsed, labels = [], []
    for _ in range(pages):
        nodes, blocks = parse(training_page(rng))
        good, inside = {}, False
        # Marks are characters of the text: what lies between them is main text.
        for node, text in blocks:
            own = inside
            for ch in text:
                if ch == "\x01":
                    inside = own = True
                elif ch == "\x02":
                    inside = False
            a, b = good.get(node.index, (0, 0))
            good[node.index] = (a + own * len(text), b + len(text))
        sums = [[*good.get(n.index, (0, 0))] for n in nodes]
        for n in reversed(nodes):
            if n.parent:
                for k in (0, 1):
                    sums[n.parent.index][k] += sums[n.index][k]
        parsed.append(nodes)
        labels.append([None if not b or 0.1 < a / b < 0.9 and n.children else a / b > 0.5 for n, (a, b) in zip(nodes, sums, strict=True)])
    seen: dict[str, list[float]] = {}
    for nodes, ys in zip(parsed, labels, strict=True):
        for node, y in zip(nodes, ys, strict=True):
            if y is not None:
                for t in set(node.tokens):
                    n = seen.setdefault(t, [0.0, 0.0])
                    n[y] += 1
    odds = {t: math.log((b + 1) / (a + 1)) for t, (a, b) in seen.items() if a + b >= 5}
    x = np.array([row for nodes, ys in zip(parsed, labels, strict=True) for row, y in zip(features(nodes, odds), ys, strict=True) if y is not None])
    y = np.array([v for ys in labels for v in ys if v is not None], float)
    return Extractor(boosted(x, y), odds)


# --- decoding -----------------------------------------------------------------------------

LEFT_TO_CHILDREN = math.log(0.25)


def decoded(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """Whether the text directly in each element is kept."""
    yes = [-math.log1p(math.exp(-min(30.0, max(-30.0, m)))) if n.chars else 0.0 for n, m in zip(nodes, margin.tolist(), strict=True)]
    no = [-math.log1p(math.exp(min(30.0, max(-30.0, m)))) if n.chars else 0.0 for n, m in zip(nodes, margin.tolist(), strict=True)]
    whole_in, whole_out, best = list(yes), list(no), [0.0] * len(nodes)
    mixed = [0.0] * len(nodes)
    for node in reversed(nodes):
        i = node.index
        if node.children:
            for c in node.children:
                whole_in[i] += whole_in[c.index]
                whole_out[i] += whole_out[c.index]
                mixed[i] += best[c.index]
            mixed[i] += LEFT_TO_CHILDREN + max(yes[i], no[i])
            best[i] = max(whole_in[i], whole_out[i], mixed[i])
        else:
            best[i] = max(yes[i], no[i])
    keep = [False] * len(nodes)
    state: list[bool | None] = [None] * len(nodes)
    for node in nodes:
        i = node.index
        decided = state[node.parent.index] if node.parent else None
        if decided is None:
            if not node.children:
                decided = yes[i] > no[i]
            elif mixed[i] < max(whole_in[i], whole_out[i]):
                decided = whole_in[i] > whole_out[i]
        state[i] = decided
        keep[i] = node.tag not in PROMPTS and (yes[i] > no[i] if decided is None else decided)
    return keep


def extract(pages: list, model: Extractor) -> list[str]:
    """Main texts of pages, whose elements go through the trees together."""
    parsed = [parse(p or "") for p in pages]
    rows = [row for nodes, _ in parsed for row in features(nodes, model.odds)]
    margin = model.trees.margin(np.array(rows, float).reshape(-1, N_FEATURES))
    out, at = [], 0
    for nodes, blocks in parsed:
        keep = decoded(nodes, margin[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(text for node, text in blocks if keep[node.index]))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) to page_id, url, text and n_chars."""
    ready(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(trained()))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for frame in frames:
            bodies = frame.column(2).to_pylist()
            for a in range(0, len(bodies), 256):
                texts = extract(bodies[a : a + 256], model)
                own = frame.slice(a, 256)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
