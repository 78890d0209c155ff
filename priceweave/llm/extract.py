"""Main-text extraction: gradient-boosted trees over DOM nodes, and one consistent choice for the whole tree.

Every block node gets log-odds of being main text from its subtree's density, the words of its attributes and its
ancestors', its depth and its siblings. Decoding chooses in or out for all nodes at once, by dynamic programming: what
is under a node that is out is out too, so no menu keeps an item and no advert inside an article comes along.

Defined results
- null or empty html, and pages without text: the empty text. Broken markup is read as far as it goes; the rest of an
  unclosed script or style is no text.
- each page is read by itself, so repeated rows, ties and null keys change nothing. An empty table gives no rows.
- a block is what stands between block elements; <br> is white space inside it. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import BoostedTrees, fit
from .common import read, slices
from .html_pages import Page

# fixed values: HTML's element classes
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template svg math canvas object audio video select datalist button noscript".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": set()}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "li", "dd", "dt", "summary", "noscript"} | {"li", "dd", "dt"}

_START = re.compile(r"<(?:!--|[!?]|/?([a-zA-Z][^\s/>]*+))")
# quotes stand only around a whole value, as browsers read it
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+)>""")
_NEXT = re.compile(r"""=\s*+(?:(["'])|[^\s>]*+)|>""")
_NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words of attributes, by what they tell.
TELLS = {
    "main": "article articlebody body content entry main post story text page",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc topnav",
    "frame": "bottom copyright footer foot head header legal masthead top colophon",
    "side": "aside complementary rail right sidebar widget widgets secondary",
    "advert": "ad ads adsbygoogle advert advertisement advertising banner promo promoted promotion slot sponsor sponsored",
    "notice": "alert consent cookie cookies dialog gdpr modal notice overlay popup privacy",
    "comment": "comment comments discussion disqus feedback replies reply respond responses thread user",
    "form": "contact form login newsletter register search signup subscribe subscription",
    "related": "also links more recommended related see share sharing social stories tags",
}
_TELL = {w: i for i, words in enumerate(TELLS.values()) for w in words.split()}
TAGS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "search"}, {"article"}, {"main"}, {"section"}, {"div", "center"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl"}, {"table", "tbody", "tr", "thead", "tfoot"}, {"td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"html", "body"}, {"address", "details", "dialog", "summary"}]
_TAG = {t: i for i, group in enumerate(TAGS) for t in group}
N_TELLS, N_TAGS = len(TELLS), len(TAGS)


class Markup:
    """The tags and comments of a page, each from a given position on; time is linear in the page, however broken."""

    def __init__(self, html: str):
        self.html = html
        self.endless = len(html) + 1  # from here on there is no >
        self.broken = False  # a tag whose end is not found may be tried at each later <: from then on what failed is kept
        self.dead: set[int] = set()
        self.gap = (0, -1)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """start, end, name of a closing tag, name of an opening tag, its attributes."""
        html = self.html
        while m := _START.search(html, at):
            start, at = m.span()
            if m[0] == "<!--":
                end = html.find("-->", at)
                return start, end + 3 if end >= 0 else len(html), "", "", ""
            first = html.find(">", at) if at < self.endless else -1
            if first < 0:
                self.endless = min(self.endless, at)
                continue
            if not m[1]:
                return start, first + 1, "", "", ""
            if html[start + 1] == "/":
                return start, first + 1, m[1], "", ""
            if not self.broken and (rest := _REST.match(html, at)):
                return start, rest.end(), "", m[1], rest[1]
            self.broken = True
            end = self._end(at)
            end = first if end < 0 else end
            return start, end + 1, "", m[1], html[at:end]
        return None

    def _end(self, at: int) -> int:
        """Place of the > that ends an opening tag, or -1 if quotes hold all of them."""
        html, seen = self.html, []
        low, high = self.gap
        m = _NEXT.search(html, high if low <= at <= high else at)
        self.gap = (low if low <= at <= high else at, m.start() if m else len(html))
        while m and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            after = html.find(m[1], m.end()) + 1 if m[1] else m.end()
            m = _NEXT.search(html, after) if after else None
        self.dead.update(seen)
        return -1


class Tree:
    """Block nodes of a page, and its text blocks with the node that each stands in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.tells = ["html"], [-1], [()]
        self.blocks: list[tuple[int, str]] = []
        self.own, self.linked, self.inline = [0], [0], [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block node that each is in
        run: list[str] = []
        hidden = links = at = 0

        def add(text: str) -> None:
            if text and not hidden:
                run.append(text)
                if links and not text.isspace():
                    self.linked[stack[-1][1]] += len(text.strip())

        def flush() -> None:
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                run.clear()
                if text:
                    node = stack[-1][1]
                    self.blocks.append((node, text))
                    self.own[node] += len(text)

        def pop_to(k: int) -> None:
            nonlocal hidden, links
            while len(stack) > k:
                tag, _ = stack[-1]
                if tag in BLOCKS:
                    flush()
                hidden -= tag in HIDDEN
                links -= tag == "a"
                stack.pop()

        markup = Markup(html)
        while found := markup.next(at):
            start, end, closing, opening, attributes = found
            if start > at:
                add(html[at:start])
            at = end
            if closing:
                tag = closing.lower()
                if tag in ("body", "html", "br"):
                    run.append(" ")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    # an inline element's end does not close blocks
                    if tag not in BLOCKS and stack[k][0] in BLOCKS:
                        break
                continue
            if not opening:
                continue
            tag = opening.lower()
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}", re.I).search(html, at)
                at = html.find(">", m.end()) + 1 if m else 0
                at = at or len(html)
                continue
            if tag == "html" or tag == "body" and any(t == "body" for t, _ in stack):
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if tag in CLOSED_BY:
                low = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SCOPE[tag]:
                        break
                    if stack[k][0] in CLOSED_BY[tag]:
                        low = k
                if low is not None:
                    pop_to(low)
            if tag in BLOCKS:
                flush()
            if tag in VOID:
                run.append(" ")
                continue
            if attributes.endswith("/") and tag not in BLOCKS:
                continue
            if tag in BLOCKS:
                self.tag.append(tag)
                self.parent.append(stack[-1][1])
                tells = set()
                for x in _NAMED.findall(attributes):
                    for w in _PART.findall(_CAMEL.sub(" ", x[0] or x[1] or x[2]).lower()):
                        if w in _TELL:
                            tells.add(_TELL[w])
                self.tells.append(tuple(tells))
                self.own.append(0)
                self.linked.append(0)
                self.inline.append(0)
                stack.append((tag, len(self.tag) - 1))
            else:
                self.inline[stack[-1][1]] += 1
                stack.append((tag, stack[-1][1]))
            hidden += tag in HIDDEN
            links += tag == "a"
        if at < len(html):
            add(html[at:])
        pop_to(1)
        flush()

    def features(self) -> np.ndarray:
        """A row for each node; parents stand before their children."""
        n = len(self.tag)
        text, linked, tags, paragraphs, nblocks, children = list(self.own), list(self.linked), [1 + x for x in self.inline], [0] * n, [0] * n, [0] * n
        commas = [0] * n
        for node, t in self.blocks:
            nblocks[node] += 1
            commas[node] += t.count(",") + t.count(".")
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            linked[p] += linked[i]
            tags[p] += tags[i]
            nblocks[p] += nblocks[i]
            commas[p] += commas[i]
            paragraphs[p] += paragraphs[i] + (self.tag[i] == "p" and self.own[i] > 0)
            children[p] += 1
        total, whole = max(1, text[0]), max(1, n)
        largest = [0] * n
        for i in range(1, n):
            largest[self.parent[i]] = max(largest[self.parent[i]], text[i])
        depth, place, seen = [0] * n, [0] * n, [0] * n
        above = [0] * n  # tells of all ancestors as bits; tags of ancestors as bits behind them
        before = [0] * n  # text before the node
        running = 0
        ends = 0
        same = {}
        for i in range(1, n):
            same[self.parent[i], self.tag[i]] = same.get((self.parent[i], self.tag[i]), 0) + 1
        rows = np.zeros((n, N_TAGS + 2 * N_TELLS + 8 + 18))
        first_block = {}
        for k, (node, t) in enumerate(self.blocks):
            first_block.setdefault(node, running)
            running += len(t)
        start = [math.inf] * n
        for i in range(n - 1, -1, -1):
            start[i] = min(start[i], first_block.get(i, math.inf))
            if i:
                start[self.parent[i]] = min(start[self.parent[i]], start[i])
        for i in range(n):
            p = self.parent[i]
            tag = _TAG.get(self.tag[i], N_TAGS - 1)
            row = rows[i]
            row[tag] = 1
            for t in self.tells[i]:
                row[N_TAGS + t] = 1
            bits = 0
            for t in self.tells[i]:
                bits |= 1 << t
            if p >= 0:
                depth[i] = depth[p] + 1
                place[i] = seen[p]
                seen[p] += 1
                for t in range(N_TELLS):
                    row[N_TAGS + N_TELLS + t] = above[p] >> t & 1
                for t in range(8):
                    row[N_TAGS + 2 * N_TELLS + t] = above[p] >> (N_TELLS + t) & 1
                above[i] = above[p] | bits | (1 << (N_TELLS + tag) if tag < 8 else 0)
            else:
                above[i] = bits
            at = N_TAGS + 2 * N_TELLS + 8
            parent_text = max(1, text[p]) if p >= 0 else total
            siblings = children[p] if p >= 0 else 1
            row[at : at + 18] = (
                math.log1p(text[i]),
                linked[i] / max(1, text[i]),
                text[i] / tags[i],
                text[i] / max(1, nblocks[i]),
                nblocks[i],
                paragraphs[i],
                commas[i] / max(1, text[i]),
                text[i] / total,
                text[i] / parent_text,
                self.own[i] / max(1, text[i]),
                depth[i],
                place[i] / max(1, siblings),
                siblings,
                same.get((p, self.tag[i]), 1) / max(1, siblings),
                (linked[p] / parent_text) if p >= 0 else 0,
                largest[p] / parent_text if p >= 0 else 1,
                (start[i] if start[i] < math.inf else total) / total,
                paragraphs[p] / max(1, nblocks[p]) if p >= 0 else 0,
            )
        return rows

    def decode(self, logit: np.ndarray, cut: float = 1.0) -> list[bool]:
        """in or out for each node: the consistent choice of the greatest sum. A node that is out under one that is in
        costs cut; what is under a node that is out is out."""
        n = len(self.tag)
        weight = [min(4.0, max(-4.0, float(x))) for x in logit]
        in_, out = list(weight), [-w for w in weight]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            in_[p] += max(in_[i], out[i] - cut)
            out[p] += out[i]
        chosen = [False] * n
        chosen[0] = True
        for i in range(1, n):
            chosen[i] = chosen[self.parent[i]] and in_[i] >= out[i] - cut
        return chosen

    def main_text(self, logit: np.ndarray) -> str:
        chosen = self.decode(logit)
        return "\n".join(t for node, t in self.blocks if chosen[node])


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, main or not) of the nodes with text of a made-up page: more than half of a node's text is main."""
    plain = Tree(html.replace(Page.MARK, ""))
    marked = Tree(html)
    n = len(plain.tag)
    main, text = [0] * n, [0] * n
    for node, t in marked.blocks:
        text[node] += len(t)
        main[node] += len(t) * (Page.MARK in t)
    for i in range(n - 1, 0, -1):
        main[plain.parent[i]] += main[i]
        text[plain.parent[i]] += text[i]
    rows = [i for i in range(1, n) if text[i]]
    return plain.features()[rows], np.array([2 * main[i] > text[i] for i in rows], np.float64)


def fit_model(pages: int = 900, seed: int = 1) -> BoostedTrees:
    """From made-up pages only: a fixed number, whatever the input."""
    parts = [labelled(Page(seed * 1_000_003 + i).html()) for i in range(pages)]
    return fit(np.vstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), trees=70, depth=4, rate=0.25, clip=4.0)


def extract(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text of each page; nothing is shuffled."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit_model())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500, 4 << 20):
            trees = [Tree(h or "") for h in batch["html"].to_pylist()]
            rows = [t.features() for t in trees]
            ends = np.cumsum([len(r) for r in rows])
            logits = np.split(sent.value.logit(np.vstack(rows)), ends[:-1]) if rows else []
            texts = [t.main_text(x) for t, x in zip(trees, logits)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op5_extract": op5_extract}
ORACLES: dict[str, str] = {}
