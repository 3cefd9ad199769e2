"""Main-text extraction by a tree-structured graphical model.

A page is parsed into its tree of block elements (inline elements belong to the block around them). Every node is content
or not. Unary potentials come from sparse features of the node (tag, words of its class, id and role, text length, link
density), pairwise ones, between a parent and its child, from the kinds of their tags. Messages are passed from the leaves up and from the root
down (sum-product, exact on a tree), over all nodes of many pages at once, depth by depth; a node's marginal decides
on the text blocks that it owns. The weights are fitted to the likelihood of labelled pages, by gradient, with the same
messages giving the expected counts. The labelled pages come from a generator in this module: page layouts of many
kinds whose content is known.

Defined cases: null or empty html gives the empty text and 0; text outside any element belongs to the root; unclosed and
stray tags are accepted; repeated pages give a row each; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import bisect
import math
import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Out, rows_of

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Elements whose content is no markup, and those of them (and others) whose text is never shown.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul video audio math template".split()
)
#: A start tag of the key closes an open element of the value, unless an element of SCOPE stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("table ul ol dl select body html article section div main aside td th blockquote".split())
#: Words in class, id and role, by group.
WORDS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc topbar links skip",
    "foot": "footer foot bottom copyright legal colophon contentinfo",
    "head": "header masthead head logo brand top",
    "side": "sidebar side aside rail widget widgets related recommended more trending popular complementary teaser",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay banner dialog privacy paywall message",
    "form": "form search newsletter subscribe signup login register contact input",
    "comment": "comment comments discussion disqus replies reply respond responses reader forum",
    "share": "share sharing social follow buttons toolbar",
    "content": "content article main post entry body story text page maincontent articlebody prose copy",
    "meta": "meta byline author date tags category timestamp info",
}
_GROUP: dict[str, list[str]] = {}
for _g, _w in WORDS.items():
    for _x in _w.split():
        _GROUP.setdefault(_x, []).append(_g)
TAGS = "root html head body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption nav header footer aside form fieldset button select option label address details summary title script style noscript textarea iframe svg dialog template menu caption other".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_KIND = {t: k for k, ts in enumerate(("root", "html body", "div section article main", "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption", "ul ol li dl dt dd table tbody thead tr td th caption", "nav header footer aside form fieldset button select option dialog menu head title script style noscript textarea iframe svg template")) for t in ts.split()}
KINDS = 7
_HIDDEN = len(TAGS) + len(WORDS)
_BINS = _HIDDEN + 1
N_FEATURES = _BINS + 6 + 5 + 1
_SPLIT_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in order of their start: parent, tag number, features; and blocks (node, text)."""

    __slots__ = ("parent", "tag", "groups", "blocks", "chars", "link_chars")

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.blocks = [-1], ["root"], [()], []
        self.chars, self.link_chars = [0], [0]
        stack: list[tuple[str, int]] = [("root", 0)]  # every open element and the node of the block around it
        pieces: list[str] = []
        owner, links, at, end = 0, 0, 0, len(source)

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    self.blocks.append((owner, text))
                    self.chars[owner] += len(text)

        def say(raw: str) -> None:
            nonlocal owner
            if raw:
                text = entities.unescape(raw) if "&" in raw else raw
                if not pieces:
                    owner = stack[-1][1]
                pieces.append(text)
                if links:
                    self.link_chars[stack[-1][1]] += len(text)

        opened: dict[str, list[int]] = {}  # places in the stack, by tag; with them no tag costs a walk over all open elements
        scopes, scopes_but_cells = [0], [0]

        def push(tag: str, node: int) -> None:
            opened.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
                if tag not in ("td", "th"):
                    scopes_but_cells.append(len(stack))
            stack.append((tag, node))

        def close_to(i: int) -> None:
            nonlocal links
            if any(t in BLOCK for t, _ in stack[i:]):
                flush()
            for tag, _ in stack[i:]:
                opened[tag].pop()
                links -= tag == "a"
            del stack[i:]
            for places in (scopes, scopes_but_cells):
                while places[-1] >= max(i, 1):
                    places.pop()

        def close_before(tag: str) -> None:
            """What the start of a block closes: an open paragraph, else the elements that CLOSES names, none of them beyond a scope."""
            closed = CLOSES.get(tag, ())
            bound = (scopes_but_cells if "td" in closed else scopes)[-1]
            paragraph = opened.get("p")
            if paragraph and paragraph[-1] > bound:
                close_to(paragraph[-1])
                return
            found = [places[at] for t in closed if (places := opened.get(t)) and (at := bisect.bisect_right(places, bound)) < len(places)]
            if found:
                close_to(min(found))

        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if opened.get(tag):
                    close_to(opened[tag][-1])
                else:
                    if tag == "br":
                        say(" ")
                    elif tag in BLOCK:
                        flush()
                continue
            if tag == "br" or tag == "wbr":
                say(" " if tag == "br" else "")
                continue
            if tag == "hr":
                flush()
            if tag in VOID:
                continue
            attributes = m[3] if m[2] else m[6]
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            if tag in BLOCK:
                flush()
                close_before(tag)
                names: set[str] = set()
                hidden = False
                for k, v in _ATTRIBUTE.findall(attributes or ""):
                    if k.lower() in ("hidden", "aria-hidden"):
                        hidden |= v.strip("\"'").lower() != "false"
                    else:
                        for w in _SPLIT_NAMES.findall(v):
                            names.update(_GROUP.get(w.lower(), ()))
                self.parent.append(stack[-1][1])
                self.tag.append(tag)
                self.groups.append((*sorted(names), *(["hidden"] if hidden else [])))
                self.chars.append(0)
                self.link_chars.append(0)
                push(tag, len(self.parent) - 1)
            else:
                links += tag == "a"
                push(tag, stack[-1][1])
        flush()

    def features(self) -> list[list[int]]:
        """Numbers of the features that each node has."""
        n = len(self.parent)
        chars, links = self.chars.copy(), self.link_chars.copy()
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        order = list(WORDS)
        out = []
        for i in range(n):
            f = [_TAG.get(self.tag[i], len(TAGS) - 1)]
            for g in self.groups[i]:
                f.append(_HIDDEN if g == "hidden" else len(TAGS) + order.index(g))
            f.append(_BINS + (0 if chars[i] == 0 else 1 if chars[i] < 25 else 2 if chars[i] < 80 else 3 if chars[i] < 200 else 4 if chars[i] < 800 else 5))
            share = links[i] / max(chars[i], 1)
            f.append(_BINS + 6 + (0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.5 else 3 if share < 0.8 else 4))
            f.append(N_FEATURES - 1)
            out.append(f)
        return out


#: Nodes of a level from which it is worked on as arrays.
WIDE = 16


def _log_sum(a: float, b: float) -> float:
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


class Forest:
    """The nodes of many pages, for messages depth by depth: levels of many nodes as arrays, and below the last of them node by node, so that a page's time follows from its nodes, however deep."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0] + [len(p.parent) for p in pages])
        self.starts = starts
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)])
        kind = np.array([_KIND.get(t, KINDS - 1) for p in pages for t in p.tag])
        self.kind = kind[np.maximum(self.parent, 0)] * KINDS + kind  # of the parent and the child
        rows = [f for p in pages for f in p.features()]
        self.feature = np.array([x for f in rows for x in f])
        self.owner = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
        depth = np.zeros(len(rows), np.int64)
        for p, s in zip(pages, starts, strict=False):  # parents come before their children
            for i, up in enumerate(p.parent):
                if up >= 0:
                    depth[s + i] = depth[s + up] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        wide = max((i for i, level in enumerate(levels) if len(level) >= WIDE), default=0) + 1
        self.levels, self.deep = levels[:wide], np.concatenate([order[:0], *levels[wide:]])
        place = np.full(len(depth), -1)
        place[self.deep] = np.arange(len(self.deep))
        self.deep_parent = place[self.parent[self.deep]].tolist() if len(self.deep) else []  # -1: the parent is of a wide level

    def _upward(self, u: np.ndarray, up: np.ndarray, theta: np.ndarray) -> None:
        """Messages of the deep nodes, last ones first."""
        own, pair, got, parents = u[self.deep].tolist(), theta[self.deep].tolist(), [], self.parent[self.deep].tolist()
        for k in range(len(own) - 1, -1, -1):
            (a, b), ((aa, ab), (ba, bb)) = own[k], pair[k]
            m = (_log_sum(aa + a, ab + b), _log_sum(ba + a, bb + b))
            got.append(m)
            if (above := self.deep_parent[k]) >= 0:
                own[above][0] += m[0]
                own[above][1] += m[1]
            else:
                u[parents[k]] += m
        u[self.deep], up[self.deep] = own, got[::-1]

    def _downward(self, u: np.ndarray, up: np.ndarray, theta: np.ndarray, full: np.ndarray, edge: np.ndarray) -> None:
        own, pair, got, parents, whole, edges = u[self.deep].tolist(), theta[self.deep].tolist(), up[self.deep].tolist(), self.parent[self.deep].tolist(), [], []
        for k, (a, b) in enumerate(own):
            fa, fb = whole[above] if (above := self.deep_parent[k]) >= 0 else full[parents[k]].tolist()
            (aa, ab), (ba, bb) = pair[k]
            ra, rb = fa - got[k][0], fb - got[k][1]
            j = (ra + aa + a, ra + ab + b, rb + ba + a, rb + bb + b)
            whole.append((_log_sum(j[0], j[2]), _log_sum(j[1], j[3])))
            top = max(j)
            e = [math.exp(x - top) for x in j]
            total = sum(e)
            edges.append(((e[0] / total, e[1] / total), (e[2] / total, e[3] / total)))
        full[self.deep], edge[self.deep] = whole, edges

    def pass_messages(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """unary: the logit of content by feature. pair[kind][parent][child]. Marginals [n, 2], and of each edge [n, 2, 2]."""
        u = np.zeros((len(self.parent), 2))
        u[:, 1] = np.bincount(self.owner, unary[self.feature], len(u))
        theta, up = pair[self.kind], np.zeros_like(u)
        if len(self.deep):
            self._upward(u, up, theta)
        for level in self.levels[:0:-1]:  # upward
            m = np.logaddexp(theta[level, :, 0] + u[level, None, 0], theta[level, :, 1] + u[level, None, 1])
            up[level] = m
            np.add.at(u, self.parent[level], m)
        full = u.copy()
        edge = np.zeros((len(u), 2, 2))
        for level in self.levels[1:]:  # downward
            rest = full[self.parent[level]] - up[level]
            joint = rest[:, :, None] + theta[level] + u[level][:, None, :]
            full[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint -= joint.max((1, 2), keepdims=True)
            e = np.exp(joint)
            edge[level] = e / e.sum((1, 2), keepdims=True)
        if len(self.deep):
            self._downward(u, up, theta, full, edge)
        full -= full.max(1, keepdims=True)
        p = np.exp(full)
        return p / p.sum(1, keepdims=True), edge


def fit(pages: list[tuple[Page, np.ndarray]], steps: int = 260, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of greatest likelihood: observed counts less those expected under the messages' marginals."""
    forest = Forest([p for p, _ in pages])
    y = np.concatenate([l for _, l in pages]).astype(int)
    child = np.flatnonzero(forest.parent >= 0)
    w, pair = np.zeros(N_FEATURES), np.zeros((KINDS * KINDS, 2, 2))
    seen = np.bincount(forest.feature, y[forest.owner], N_FEATURES)
    seen_pair = np.zeros_like(pair)
    np.add.at(seen_pair, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    m, s = [np.zeros_like(w), np.zeros_like(pair)], [np.zeros_like(w), np.zeros_like(pair)]
    for t in range(1, steps + 1):
        p, edge = forest.pass_messages(w, pair)
        expected = np.bincount(forest.feature, p[forest.owner, 1], N_FEATURES)
        expected_pair = np.zeros_like(pair)
        np.add.at(expected_pair, forest.kind[child], edge[child])
        for i, (x, g) in enumerate(((w, (seen - expected) / len(pages) - decay * w), (pair, (seen_pair - expected_pair) / len(pages) - decay * pair))):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            x += 0.15 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
    return w, pair


def labelled_pages(n: int = 800, seed: int = 17) -> list[tuple[str, set[str]]]:
    """Generated pages: html, and the texts of the blocks that are content."""
    rnd = random.Random(seed)
    syllables = "ba ko ti re lan mor ves un da per si tol ech am ri".split()
    count = iter(range(10**9))

    def words(a: int, b: int) -> str:
        some = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(a, b))]
        return " ".join(["".join(rnd.choice(syllables) for _ in range(3)) + str(next(count)), *some]) + rnd.choice([".", ".", ""])

    def attr(*names: str) -> str:
        name = rnd.choice(names)
        return rnd.choice([f' class="{name}"', f' id="{name}"', f' class="x-{name} clear"', f' role="{name}"']) if name else ""

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(0, 2)}</a></li>' for i in range(k)) + "</ul>" if rnd.random() < 0.7 else " | ".join(f'<a href="/{i}">{words(0, 2)}</a>' for i in range(k))

    def chrome(where: str) -> str:
        text = lambda: rnd.choice([f"<p>{words(2, 30)}</p>", words(2, 25), f"<h3>{words(0, 3)}</h3><p>{words(2, 12)}</p>", links(rnd.randint(2, 6))])
        kinds = {
            "before": [lambda: f"<nav{attr('', 'menu', 'navbar', 'breadcrumbs')}>{links(rnd.randint(2, 9))}</nav>", lambda: f"<header{attr('', 'masthead', 'header', 'site-header')}>{text()}</header>", lambda: f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'banner')}>{text()}</div>", lambda: f"<div{attr('cookie', 'cookie-notice', 'consent', 'notice', 'alert')}>{text()}</div>", lambda: f"<div{attr('menu', 'nav', 'topbar', 'navigation')}>{links(rnd.randint(2, 8))}</div>"],
            "inside": [lambda: f"<div{attr('ad', 'advert', 'sponsored', 'promo')}>{text()}</div>", lambda: f"<aside{attr('', 'related', 'sidebar', 'widget')}>{text()}</aside>", lambda: f"<form{attr('', 'newsletter', 'search')}><label>{words(0, 4)}</label><input type=text><button>{words(0, 1)}</button></form>", lambda: f"<div{attr('share', 'social', 'related', 'newsletter')}>{text()}</div>", lambda: f"<nav>{links(3)}</nav>"],
            "after": [lambda: f"<footer{attr('', 'footer', 'site-footer')}>{rnd.choice(['&copy; ', ''])}{text()}</footer>", lambda: f"<aside{attr('', 'sidebar', 'widgets')}>{text()}{text()}</aside>", lambda: f"<div{attr('sidebar', 'related', 'footer', 'recommended')}>{text()}</div>", lambda: f"<section{attr('comments', 'discussion', 'reader-comments', 'replies')}><h2>{words(0, 2)}</h2>" + "".join(f"<{t}{attr('', 'comment')}><p>{words(3, 40)}</p></{t}>" for t in [rnd.choice(["div", "article", "li"])] * rnd.randint(1, 4)) + "</section>", lambda: f"<form>{words(1, 5)}<select><option>{words(0, 1)}<option>{words(0, 1)}</select></form>", lambda: f"<div{attr('comments', 'comment-list', 'disqus')}><p>{words(3, 50)}</p><p>{words(3, 50)}</p></div>"],
        }
        return rnd.choice(kinds[where])()

    out = []
    for _ in range(n):
        good: set[str] = set()

        def own(a: int, b: int, good=good) -> str:
            w = words(a, b)
            good.add(w)
            return w

        def body() -> str:
            r = rnd.random()
            if r < 0.62:
                return f"<p>{own(*rnd.choice([(0, 0), (0, 4), (5, 30), (30, 120), (120, 900)]))}{rnd.choice(['</p>', '</p>', ''])}"
            if r < 0.72:
                return f"<h2>{own(0, 5)}</h2>"
            if r < 0.8:
                return rnd.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{own(1, 14)}</li>" for _ in range(rnd.randint(1, 5))))
            if r < 0.86:
                return f"<blockquote>{rnd.choice([f'<p>{own(3, 30)}</p>', own(3, 30)])}</blockquote>"
            if r < 0.9:
                return "<table>" + "".join(f"<tr><td>{own(0, 3)}</td><td>{own(0, 3)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>"
            if r < 0.94:
                return f"<figure><img src=x><figcaption>{own(2, 10)}</figcaption></figure>"
            if r < 0.97:
                return f"<pre>{own(2, 12)}</pre>"
            return f"<div>{own(3, 40)}</div>"

        parts = ([f"<h1>{own(1, 8)}</h1>"] if rnd.random() < 0.8 else []) + [body() if rnd.random() < 0.88 else chrome("inside") for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 14, 30, 60]))]
        if rnd.random() < 0.25:  # many paragraphs of one length
            length = rnd.choice([(0, 0), (0, 2), (8, 20), (20, 60)])
            parts += [f"<p>{own(*length)}</p>" for _ in range(rnd.randint(10, 90))]
        a, b = rnd.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{attr('content', 'post', 'entry-content', 'article-body', 'story', 'main')}>", "</div>"), (f"<section{attr('content', 'article')}>", "</section>"), ("<div>", "</div>")])
        if rnd.random() < 0.3:
            a, b = f"<div{attr('wrapper', 'container', 'page')}>{a}", f"{b}</div>"
        if rnd.random() < 0.1:  # a fragment, without a page around it
            out.append((f"{a}{''.join(parts)}{b}", good))
            continue
        before = "".join(chrome("before") for _ in range(rnd.randint(0, 4)))
        after = "".join(chrome("after") for _ in range(rnd.randint(0, 4)))
        head, tail = ("<html><head>", "</head><body>") if rnd.random() < 0.75 else ("", "")  # these tags may be left out
        out.append((f"<!DOCTYPE html>{head}<title>{words(1, 6)}</title><script>x</script>{tail}{before}{a}{''.join(parts)}{b}{after}", good))
    return out


def labels_of(page: Page, good: set[str]) -> np.ndarray:
    """A node is content if it owns a content block, or a child is content."""
    y = np.zeros(len(page.parent), bool)
    for node, text in page.blocks:
        y[node] |= text in good
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] |= y[i]
    return y


@cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    pages = [(Page(h), g) for h, g in labelled_pages()]
    return fit([(p, labels_of(p, g)) for p, g in pages])


def main_texts(sources: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    p, _ = forest.pass_messages(*weights)
    out = []
    for page, start in zip(pages, forest.starts, strict=False):
        out.append("\n\n".join(text for node, text in page.blocks if p[start + node, 1] > 0.5))
    return out


def extract(pages: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = weights or trained()
    df = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = Out(pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])), [], 0

        def flush():
            for (page_id, url, _), text in zip(held, main_texts([h[2] for h in held], weights), strict=True):
                yield from out.add((page_id, url, text, len(text)), len(text) + 64)

        for row in rows_of(batches):
            held.append(row)
            size += len(row[2])
            if size >= 1 << 20 or len(held) >= 512:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()
        yield from out.flush()

    return df.mapInArrow(run, "page_id long, url string, text string, n_chars long")
