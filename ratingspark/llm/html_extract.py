"""Main text of web pages: boosted trees over DOM nodes, decoded hierarchically.

A page becomes a tree of block elements, with the runs of text between their
borders as leaves. Every node gets features: its and its ancestors' kind of
element and attribute tokens, depth, text density of its subtree, links,
punctuation, and how it compares with its siblings. Boosted trees give the
log-probabilities of three classes: ``main`` (all main text), ``other`` (none)
and ``mixed`` (a container of both). The decoder picks the likeliest labelling
of the whole tree in which nothing below ``other`` is kept, below ``main`` are
only ``main`` and ``other``, and a run of text is one or the other: no node
contradicts its ancestors. The text is that of the runs labelled ``main``.

The trees are fitted on pages of ``layouts.py``, generated page frames whose
blocks have known roles (``TRAIN_PAGES`` of them, a documented bound); no page
of the table is used for fitting.

Parsing follows HTML's rules where they decide about text: raw text elements,
void elements, implied ends, comments, character references in each piece of
text. It is linear in the page's length. Defined cases: a null or empty page
has no text; an unfinished tag, comment or script at the end is dropped, as
browsers do; a quote that never closes ends with its tag; repeated rows repeat
their results; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.llm import boosting
from ratingspark.llm.common import bounded_batches, released

MAIN, OTHER, MIXED = 0, 1, 2
TRAIN_PAGES, ROUNDS = 400, 32
#: What a part inside main text must be likelier by, as a log ratio, to be left out.
BREAK = 3.0
#: Characters of pages whose nodes are judged together.
BLOCK = 4 << 20

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes", "svg",
       "math", "select", "option", "canvas", "object", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "picture", "map", "output", "meter", "progress"}
#: Open elements that a start tag ends; any other block ends an open paragraph.
ENDS = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"},
        "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tbody": {"p", "td", "th", "tr", "thead", "tbody"},
        "tfoot": {"p", "td", "th", "tr", "thead", "tbody"}}
PARAGRAPH = {"p"}

#: Kinds of element, one feature each.
ELEMENTS = {"nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside dialog",
            "form": "form button label fieldset legend", "article": "article", "main": "main", "section": "section",
            "title": "h1", "heading": "h2 h3 h4 h5 h6", "paragraph": "p blockquote pre", "list": "ul ol dl", "item": "li dt dd",
            "table": "table thead tbody tfoot tr td th caption", "figure": "figure figcaption", "plain": "div center body html"}
#: Words of class, id, role and label attributes, one feature each group.
TOKENS = {
    "nav": "nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumbs tabs pagination pager toc sitemap toolbar skip topnav subnav",
    "header": "header head masthead topbar branding logo site top banner",
    "footer": "footer foot copyright legal imprint colophon bottom contentinfo credits",
    "side": "sidebar side aside rail widget widgets complementary secondary right left",
    "notice": "cookie cookies consent gdpr notice notification alert alertdialog privacy popup modal overlay toast message disclaimer warning paywall",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense taboola outbrain affiliate commercial",
    "comment": "comment comments commentlist disqus reply replies respond response responses discussion thread feedback reader readers guestbook reviews",
    "form": "form search newsletter subscribe subscription signup login register contact input field",
    "related": "related recommended recommend more also share sharing social follow popular trending latest tags tag teaser teasers",
    "content": "content article post entry main story body text maincontent articlebody copy prose single page document",
    "hidden": "hidden invisible sr offscreen screen noprint print",
}
KINDS = [*ELEMENTS, *(f"token {g}" for g in TOKENS)]
_ELEMENT_BIT = {t: 1 << k for k, g in enumerate(ELEMENTS) for t in ELEMENTS[g].split()}
_TOKEN_BIT: dict[str, int] = {}
for _k, _g in enumerate(TOKENS):
    for _t in TOKENS[_g].split():
        _TOKEN_BIT[_t] = _TOKEN_BIT.get(_t, 0) | 1 << (len(ELEMENTS) + _k)

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r'data-truth="(\w+)"')


def token_bits(attributes: str) -> int:
    bits = 0
    for value in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall(value):
            bits |= _TOKEN_BIT.get(word.lower(), 0)
    return bits


class Tree:
    """The nodes of one or more pages, parents before children. A leaf run has
    its text, a block element an empty one; ``truth`` is read from training
    pages alone."""

    def __init__(self, marked: bool = False):
        self.parent: list[int] = []
        self.bits: list[int] = []
        self.tag: list[str] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.truth: list[str] = []
        self.page: list[int] = []
        self.marked, self.pages = marked, 0

    def _node(self, parent: int, bits: int, tag: str, text: str = "", linked: int = 0, truth: str = "") -> int:
        for column, value in ((self.parent, parent), (self.bits, bits), (self.tag, tag), (self.text, text),
                              (self.linked, linked), (self.truth, truth), (self.page, self.pages)):
            column.append(value)
        return len(self.parent) - 1

    def add(self, html: str) -> None:
        """Parses a page below a root of its own."""
        root = self._node(-1, 0, "#root")
        stack, opened = [(root, "#root")], {"#root": 1}
        run: list[str] = []
        link_at = linked = 0  # depth of the stack where a link is open, linked characters of the run
        at, size = 0, len(html)

        def end_run() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                run.clear()
                if text:
                    parent = stack[-1][0]
                    self._node(parent, self.bits[parent], "#text", text, min(linked, len(text)), self.truth[parent])
                linked = 0

        def pop() -> None:
            nonlocal link_at
            opened[stack.pop()[1]] -= 1
            if link_at > len(stack):
                link_at = 0

        def add_text(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                run.append(piece)
                if link_at:
                    linked += len(piece.strip())

        while at < size:
            found = _OPEN.search(html, at)
            if not found:
                add_text(html[at:])
                break
            add_text(html[at:found.start()])
            name = found.group(2)
            if name is None:  # comment, declaration or a stray end
                if found.group().endswith("--"):
                    # "<!-->" and "<!--->" are whole comments
                    end = found if html.startswith((">", "->"), found.end()) else _COMMENT_END.search(html, found.end())
                    at = size if end is None else html.index(">", end.start() + 3) + 1 if end is found else end.end()
                else:
                    at = html.find(">", found.end()) + 1 or size
                continue
            end = _TAG_END.match(html, found.end())
            at = end.end() if end else html.find(">", found.end()) + 1
            if not at:
                break  # an unfinished tag
            tag, closing = name.lower(), found.group(1)
            if tag in INLINE:
                if tag == "a":
                    link_at = 0 if closing else len(stack)
                continue
            if tag == "br":
                run.append(" ")
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag in RAW:
                if not closing and not html.endswith("/>", 0, at):
                    end = _RAW_END[tag].search(html, at)
                    at = html.find(">", end.end()) + 1 or size if end else size
                continue
            end_run()
            if tag == "hr":
                continue
            if closing:
                if tag in ("body", "html") or not opened.get(tag):
                    continue
                while stack[-1][1] != tag:
                    pop()
                pop()
                continue
            if tag in ("body", "html") and opened.get(tag):
                continue
            ended = ENDS.get(tag, PARAGRAPH)
            while stack[-1][1] in ended:
                pop()
            attributes = html[found.end():at - 1]
            parent, truth = stack[-1][0], ""
            if self.marked:
                mark = _MARK.search(attributes)
                truth = mark.group(1) if mark else self.truth[parent]
            bits = _ELEMENT_BIT.get(tag, 0) | (token_bits(attributes) if attributes else 0)
            stack.append((self._node(parent, bits, tag, truth=truth), tag))
            opened[tag] = opened.get(tag, 0) + 1
        end_run()
        self.pages += 1

    def levels(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Parents, and the nodes of each depth from the roots down."""
        parent = np.array(self.parent, np.int64)
        depth = np.zeros(len(parent), np.int64)
        for k, p in enumerate(self.parent):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        return parent, np.split(order, np.cumsum(np.bincount(depth))[:-1])


def _upwards(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Sums over each node's subtree."""
    total = values.astype(np.float64)
    for nodes in levels[:0:-1]:
        np.add.at(total, parent[nodes], total[nodes])
    return total


def features(tree: Tree, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    n = len(parent)
    above, page = np.maximum(parent, 0), np.array(tree.page)
    leaf = np.array([t == "#text" for t in tree.tag])
    chars = np.array([len(t) for t in tree.text], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in tree.text], np.float64)
    marks = np.array([sum(map(t.count, ".,;:!?。，")) if t else 0 for t in tree.text], np.float64)
    all_chars, all_words, all_marks, all_links, leaves, blocks = (
        _upwards(v, parent, levels) for v in (chars, words, marks, np.array(tree.linked), leaf, ~leaf))
    bits = np.array(tree.bits, np.int64)
    ancestors, depth = np.zeros(n, np.int64), np.zeros(n)
    for k, nodes in enumerate(levels[1:], 1):
        ancestors[nodes] = ancestors[parent[nodes]] | bits[parent[nodes]]
        depth[nodes] = k
    child = parent >= 0
    siblings = np.bincount(above[child], minlength=n)
    _, tag = np.unique(tree.tag, return_inverse=True)
    pair, alike = np.unique(above * (tag.max() + 1) + tag, return_inverse=True)
    same = np.bincount(alike, child, len(pair))[alike]
    # numbers among the siblings, in page order
    by_parent = np.lexsort((np.arange(n), above))
    first = np.searchsorted(above[by_parent], above)
    number = np.empty(n)
    number[by_parent] = np.arange(n)
    number -= first
    count = np.maximum(siblings[above], 1)
    mean_chars = all_chars[above] / count
    roots = levels[0][page]
    page_chars = np.maximum(all_chars[roots], 1)
    before = np.cumsum(chars) - chars
    before -= before[roots]
    link = all_links / np.maximum(all_chars, 1)
    before_in_order, after_in_order = np.roll(by_parent, 1), np.roll(by_parent, -1)
    neighbour = np.empty((2, n), np.int64)
    neighbour[0, by_parent], neighbour[1, by_parent] = before_in_order, after_in_order
    beside = [np.where(above[k] == above, link[k], -1.0) for k in neighbour]
    beside_chars = [np.where(above[k] == above, np.log1p(all_chars[k]), -1.0) for k in neighbour]
    columns = [leaf, np.log1p(all_chars), np.log1p(blocks), np.log1p(all_chars / (blocks + 1)), link,
               np.log1p(all_words / np.maximum(leaves, 1)), all_marks / np.maximum(all_words, 1), all_chars / page_chars,
               before / page_chars, (page_chars - before - all_chars) / page_chars, depth, np.log1p(siblings),
               np.log1p(count), number / count, same / count, np.log1p(mean_chars),
               all_chars / np.maximum(mean_chars, 1), link[above], np.log1p(all_chars[above]), np.log1p(page_chars),
               *beside, *beside_chars]
    columns += [bits >> k & 1 for k in range(len(KINDS))] + [ancestors >> k & 1 for k in range(len(KINDS))]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def decode(log_p: np.ndarray, leaf: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The likeliest labels of all nodes without a contradiction between
    ancestor and descendant."""
    score = log_p.astype(np.float64).copy()
    score[leaf, MIXED] = -1e9
    for nodes in levels[:0:-1]:
        up = parent[nodes]
        np.add.at(score, (up, MAIN), np.maximum(score[nodes, MAIN], score[nodes, OTHER] - BREAK))
        np.add.at(score, (up, OTHER), score[nodes, OTHER])
        np.add.at(score, (up, MIXED), score[nodes].max(axis=1))
    label = np.empty(len(parent), np.int64)
    label[levels[0]] = score[levels[0]].argmax(1)
    for nodes in levels[1:]:
        allowed = score[nodes].copy()
        over = label[parent[nodes]]
        allowed[over != MIXED, MIXED] = -np.inf
        allowed[over == OTHER, MAIN] = -np.inf
        allowed[over == MAIN, OTHER] -= BREAK
        label[nodes] = allowed.argmax(1)
    return label


def truths(tree: Tree, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The classes of the nodes of marked training pages."""
    leaf = np.array([t == "#text" for t in tree.tag])
    kept = np.array([t == "main" for t in tree.truth])
    main, other = (_upwards(leaf & v, parent, levels) for v in (kept, ~kept))
    return np.where((main > 0) & (other > 0), MIXED, np.where((main > 0) | (kept & (other == 0)), MAIN, OTHER))


def train(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, seed: int = 12) -> boosting.BoostedTrees:
    """Boosted trees fitted on ``pages`` generated pages."""
    from ratingspark.llm.layouts import generated

    tree = Tree(marked=True)
    for html in generated(pages, seed):
        tree.add(html)
    parent, levels = tree.levels()
    return boosting.fit(features(tree, parent, levels), truths(tree, parent, levels), 3, rounds)


def main_texts(pages: list[str], model: boosting.BoostedTrees) -> list[str]:
    """The main text of each page."""
    tree = Tree()
    for html in pages:
        tree.add(html)
    out: list[list[str]] = [[] for _ in pages]
    if pages:
        parent, levels = tree.levels()
        leaf = np.array([t == "#text" for t in tree.tag])
        label = decode(model.log_probabilities(features(tree, parent, levels)), leaf, parent, levels)
        for k in np.flatnonzero(leaf & (label == MAIN)).tolist():
            out[tree.page[k]].append(tree.text[k])
    return [" ".join(t) for t in out]


def _extracted(model: boosting.BoostedTrees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                pages, size, start = [], 0, at
                while at < batch.num_rows and (not pages or size < BLOCK):
                    pages.append(batch.column(2)[at].as_py() or "")
                    size += len(pages[-1])
                    at += 1
                texts = main_texts(pages, model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), batch.column(1).slice(start, at - start),
                     pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            model: boosting.BoostedTrees | None = None) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``."""
    bounded_batches(pages.sparkSession)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType),
                           T.StructField(url_col, pages.schema[url_col].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return (pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)])
            .mapInArrow(released(_extracted(model or train())), schema))
