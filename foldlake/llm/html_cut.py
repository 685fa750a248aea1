"""Main-text extraction by minimum cut.

A page becomes its text blocks in page order. A logistic classifier gives each block a probability of being content
from its tags, the class, id and role words of its ancestors, its length and its links. Its two costs are the terminal
capacities: -log of the probability of the label that a side of the cut stands for. Blocks next to each other, and
blocks that follow each other within one container, are tied by smoothness edges that weigh more the more of the DOM
path they share. A maximum flow separates the source side, the content. Sure blocks keep the classifier's label and
borderline ones (short lines, list items, headings) go with their neighbours.

The classifier is fitted to the table itself: on a bounded sample of pages (``fit_pages`` of at most ``fit_bytes``
bytes, in the order of a hash of the id), blocks inside nav, footer, aside, form or page headers are taken for
boilerplate and paragraphs and headings inside article or main for content. Half of these are shown without the tags
that gave the label, so that names, lengths and links are learnt. Weights start from, and are held near, PRIOR; pages
without such tags leave it as it is. Pages are independent rows, so Spark only has to deal them out.

Defined results: null or empty html, and pages without content blocks, give the empty text; character references are
decoded once; white space inside a block becomes one space, line breaks included; broken or cut-off markup is read as
far as it goes, in linear time; a null url stays null; repeated rows and null ids are rows like others; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, table

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|aria-label|itemprop|hidden|style)(?![\w-])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of HTML.
SKIPPED = frozenset("script style noscript template svg math iframe select textarea object".split())
SWALLOWS = frozenset("script style textarea".split())  # without an end tag, up to the end of the page
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr q s samp small span strike strong sub sup svg time tt u var wbr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}

#: Weights that the fit starts from, in nats, positive for content. Features are tags, words of names and roles.
PRIOR = {f"tag {t}": w for t, w in {"nav": -5, "footer": -5, "aside": -4.5, "form": -4.5, "button": -5, "menu": -5, "dialog": -4, "head": -12, "title": -12, "input": -4, "label": -3, "article": 1.8, "main": 1.5, "p": 1.2, "blockquote": 1.2, "pre": 1.2, "h1": 1.2, "h2": 0.9, "h3": 0.7, "figcaption": 0.4, "header": -4.5}.items()}
PRIOR |= {f"name {w}": -4.5 for w in "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion comment comments commentlist reply replies disqus respond nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager copyright legal disclaimer toolbar masthead topbar search toc skip header discussion feedback".split()}
PRIOR |= {f"name {w}": -2.0 for w in "meta byline tags rail review reviews".split()}
PRIOR |= {f"name {w}": 1.0 for w in "article articlebody content post entry story text body main".split()}
PRIOR |= {f"role {r}": -5.0 for r in "navigation banner contentinfo complementary search dialog alert alertdialog".split()}
PRIOR |= {"role main": 1.5, "role article": 1.5, "hidden": -12.0, "base": -1.6, "length": 0.9, "linked": -3.0, "rights": -3.0}
#: Tags and roles that give a block its label in the fit.
SHUT = frozenset("tag nav,tag footer,tag aside,tag form,tag header,role navigation,role contentinfo,role complementary".split(","))
OPEN = frozenset(("tag article", "tag main", "role main"))
SAID = frozenset(("tag p", "tag h1", "tag h2", "tag h3", "tag blockquote"))
FIT_PAGES, FIT_BYTES, FIT_ROUNDS, PULL = 300, 64 * 1024, 150, 0.02
#: Capacity units of one nat, and of the smoothness edges: between neighbours (times the shared part of the path), and within a container.
NAT, NEAR, SIBLING, SURE = 100, 45, 55, 1500


def tokens(page: str):
    """(text, None) and ("", (name, end tag?, attributes, self-closing?)) in page order, by a scan that never goes back."""
    at, n, last, quotes, ends = 0, len(page), page.rfind(">"), True, {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], None
            return
        if lt > at:
            yield page[at:lt], None
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4)
            if at < 0:
                return
            at += 3
            continue
        after = page[lt + 1 : lt + 2]
        close = after == "/"
        name = _NAME.match(page, lt + 1 + close)
        if not name:
            if after and after in "!?/":
                at = page.find(">", lt) + 1 if last > lt else n
            else:
                yield "<", None
                at = lt + 1
            continue
        if last < lt:  # no tag ends from here on: only the last one is a tag that was cut off
            following = page.find("<", lt + 1)
            if following < 0:
                return
            yield page[lt:following], None
            at = following
            continue
        m = _REST.match(page, name.end()) if quotes else None
        if m is None:  # a quote is never closed: from here on, quotes don't count
            quotes = False
        stop = m.end() if m else page.find(">", name.end()) + 1
        tag = name.group().lower()
        empty = page[stop - 2] == "/"
        if tag in SKIPPED and not close and not empty:
            if tag not in ends or 0 <= ends[tag] < stop:
                m = re.compile(f"</{tag}", re.I).search(page, stop)
                ends[tag] = m.start() if m else -1
            if ends[tag] < 0 and tag in SWALLOWS:
                return
            at = stop if ends[tag] < 0 else page.find(">", ends[tag]) + 1 or n
            continue
        if tag not in SKIPPED:
            yield "", (tag, close, page[name.end() : stop - 1], empty)
        at = stop


class Element:
    """An open element: its tag, the features of its path, its depth and the element around it."""

    __slots__ = ("tag", "features", "depth", "parent")

    def __init__(self, tag: str, features: frozenset, parent: Element | None):
        self.tag, self.features, self.parent, self.depth = tag, features, parent, parent.depth + 1 if parent else 0


def opened(tag: str, attributes: str, parent: Element) -> Element:
    own = {f"tag {tag}"}
    if tag == "header" and parent.features & OPEN:
        own = set()
    if attributes:
        for k, v in _ATTRIBUTE.findall(attributes):
            k, v = k.lower(), v.strip("\"'")
            if k == "role":
                own.add(f"role {v.lower()}")
            elif k == "hidden" or k == "style" and re.search(r"display\s*:\s*none", v):
                own.add("hidden")
            elif k in ("class", "id"):
                own.update(f"name {w}" for w in _SPLIT.split(_CAMEL.sub("-", v).lower()) if w)
    return Element(tag, parent.features if own <= parent.features else parent.features | own, parent)


def blocks(page: str) -> list[tuple[str, Element, int, int]]:
    """(text, element, characters in links, depth shared with the block before) of the text blocks in page order."""
    stack, held = [Element("", frozenset(), None)], {}
    out, parts, linked, link_from, size, low = [], [], 0, None, 0, 0

    def flush():
        nonlocal parts, linked, size, link_from, low
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1], linked + (size - link_from if link_from is not None else 0), low))
                low = len(stack) - 1
        parts, linked, size = [], 0, 0
        link_from = 0 if link_from is not None else None

    def pop():
        nonlocal low
        held[stack.pop().tag] -= 1
        low = min(low, len(stack) - 1)

    for text, tag in tokens(page):
        if tag is None:
            parts.append(text)
            size += len(text)
            continue
        name, close, attributes, empty = tag
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                if link_from is not None:
                    linked += size - link_from
                link_from = None if close else size
            continue
        flush()
        if close:
            if held.get(name):
                while stack[-1].tag != name:
                    pop()
                pop()
                link_from = None
            continue
        if name in CLOSES_P:
            while stack[-1].tag == "p":
                pop()
        if name in SAME_CLOSES and stack[-1].tag in (name, SAME_CLOSES[name]):
            pop()
        if name not in VOID and not empty:
            stack.append(opened(name, attributes, stack[-1]))
            held[name] = held.get(name, 0) + 1
    flush()
    return out


def measures(text: str, linked: int) -> tuple[float, float, float]:
    """Length (in doublings of 20 characters), share in links, and whether it is a line of rights."""
    return min(6.0, math.log2(1 + len(text) / 20)), min(linked, len(text)) / max(1, len(text)), float(text[:1] == "©" or text[:9].lower() == "copyright")


class Classifier:
    """Log-odds of content, from weights of features."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def log_odds(self, text: str, e: Element, linked: int) -> float:
        path = self.known.get(e.features)
        if path is None:
            if len(self.known) > 50_000:
                self.known.clear()
            path = self.known[e.features] = sum(self.weights.get(f, 0.0) for f in e.features)
        long, links, rights = measures(text, linked)
        w = self.weights
        return w["base"] + path + w["length"] * long + w["linked"] * links + w["rights"] * rights


def weak_label(e: Element) -> int | None:
    """1, 0 or None (unknown), from the tags around a block alone."""
    if e.features & SHUT:
        return 0
    return 1 if e.features & OPEN and f"tag {e.tag}" in SAID and not any(PRIOR.get(f, 0) < -1 for f in e.features) else None


def fit(pages: list[str], rounds: int = FIT_ROUNDS, pull: float = PULL) -> Classifier:
    """Logistic regression on weakly labelled blocks, held near PRIOR by a Gaussian prior; both labels weigh alike."""
    rows, y = [], []
    for page in pages:
        for text, e, linked, _ in blocks(page):
            label = weak_label(e)
            if label is not None:
                path = e.features - SHUT - OPEN if len(rows) % 2 else e.features
                rows.append(dict.fromkeys(path, 1.0) | dict(zip(("base", "length", "linked", "rights"), (1.0, *measures(text, linked)))))
                y.append(label)
    y = np.array(y, float)
    if not 0 < y.sum() < len(y):
        return Classifier(dict(PRIOR))
    names = sorted(set().union(PRIOR, *rows))
    index = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for k, row in enumerate(rows):
        for f, v in row.items():
            x[k, index[f]] = v
    start = np.array([PRIOR.get(f, 0.0) for f in names])
    w, weight = start.copy(), np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ ((p - y) * weight) + pull * (w - start))
    return Classifier({f: float(v) for f, v in zip(names, w) if abs(v) > 1e-3} | {f: float(w[index[f]]) for f in ("base", "length", "linked", "rights")})


def costs(log_odds: float) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content): -log of the other label's probability, cut at SURE."""
    soft = lambda z: min(SURE, round(NAT * (math.log1p(math.exp(-abs(z))) + max(0.0, z))))
    return soft(log_odds), soft(-log_odds)


def edges(found: list[tuple[str, Element, int, int]]) -> list[tuple[int, int, int]]:
    """Smoothness edges between neighbours, and between blocks that follow each other in one container."""
    out, last = [], {}
    for i, (_, e, _, shared) in enumerate(found):
        if i:
            out.append((i - 1, i, NEAR * shared // max(1, found[i - 1][1].depth, e.depth)))
        k = id(e.parent)
        if k in last:
            out.append((last[k], i, SIBLING))
        last[k] = i
    return [x for x in out if x[2] > 0]


def minimum_cut(capacities: list[tuple[int, int]], ties: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut. capacities: (from the source, to the sink) of each node.

    Maximum flow in phases: distances from nodes with spare source capacity, then shortest paths until none is left.
    """
    n = len(capacities)
    spare = [a - b for a, b in capacities]  # the flow source -> node -> sink is sent at once
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in ties:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [c, c]
    while True:
        level = [0 if x > 0 else -1 for x in spare]
        queue, reached = [i for i in range(n) if not level[i]], False
        for i in queue:
            reached = reached or spare[i] < 0
            for k in near[i]:
                if room[k] > 0 and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * n
        for source in [i for i in range(n) if spare[i] > 0]:
            path, i = [], source
            while spare[source] > 0:
                if spare[i] < 0:
                    flow = min(spare[source], -spare[i], *(room[k] for k in path))
                    spare[source] -= flow
                    spare[i] += flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    path, i = [], source
                    continue
                while arc[i] < len(near[i]):
                    k = near[i][arc[i]]
                    if room[k] > 0 and level[to[k]] == level[i] + 1:
                        break
                    arc[i] += 1
                if arc[i] < len(near[i]):
                    path.append(near[i][arc[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    arc[i] += 1
                else:
                    break


def labels(found: list[tuple[str, Element, int, int]], classifier: Classifier) -> tuple[list[bool], list[bool]]:
    """(the cut's labels, the classifier's own) of blocks; True for content."""
    odds = [classifier.log_odds(t, e, linked) for t, e, linked, _ in found]
    return minimum_cut([costs(z) for z in odds], edges(found)), [z > 0 for z in odds]


def extract(page: str | None, classifier: Classifier | None = None) -> str:
    """The main text of one page: content blocks in page order, two line feeds between them."""
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, keep in zip(found, labels(found, classifier or Classifier(PRIOR))[0]) if keep)


def fitted(pages: DataFrame, fit_pages: int = FIT_PAGES, fit_bytes: int = FIT_BYTES) -> Classifier:
    """The classifier of a table; what reaches the driver is at most fit_pages pages of fit_bytes bytes."""
    sample = pages.select("page_id", "html").filter(F.octet_length("html") <= fit_bytes).orderBy(F.xxhash64("page_id"), F.md5("html")).limit(fit_pages)
    return fit([r["html"] for r in sample.collect()])


def _extracted(classifier: Classifier):
    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_turned", pa.int64())])

        def rows():
            for b in batches:
                for i, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    found = blocks(h.as_py() or "")
                    cut, own = labels(found, classifier)
                    t = "\n\n".join(x[0] for x, keep in zip(found, cut) if keep)
                    yield (i, u, t, len(t), len(found), sum(a != b for a, b in zip(cut, own))), len(t) + 100

        yield from arrow_rows(rows(), schema)

    return run


def main_text(pages: DataFrame, fit_pages: int = FIT_PAGES, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row; n_blocks, and n_turned: blocks whose label the cut changed."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return p.mapInArrow(_extracted(fitted(p, fit_pages, fit_bytes)), "page_id long, url string, text string, n_chars long, n_blocks long, n_turned long")


def op8_minimum_cut_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
