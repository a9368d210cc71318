import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingspark.llm import html_extract as H
from ratingspark.llm import layouts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return H.train()


def text_of(html, model):
    return H.main_texts([html], model)[0]


def runs(html):
    tree = H.Tree()
    tree.add(html)
    return [t for t in tree.text if t]


def test_held_out_layouts(model):
    tree = H.Tree(marked=True)
    for html in layouts.generated(200, seed=4711):
        tree.add(html)
    parent, levels = tree.levels()
    leaf = np.array([t == "#text" for t in tree.tag])
    truth = H.truths(tree, parent, levels)[leaf]
    label = H.decode(model.log_probabilities(H.features(tree, parent, levels)), leaf, parent, levels)[leaf]
    chars, page = np.array([len(t) for t in tree.text])[leaf], np.array(tree.page)[leaf]
    right = chars[(truth == H.MAIN) & (label == H.MAIN)].sum()
    assert right / chars[label == H.MAIN].sum() > 0.995 and right / chars[truth == H.MAIN].sum() > 0.995
    assert len(set(page[(truth == H.MAIN) != (label == H.MAIN)].tolist())) <= 12


def test_no_contradiction_between_ancestor_and_descendant(model):
    draw = np.random.default_rng(6)
    tree = H.Tree()
    for html in layouts.generated(20, seed=5):
        tree.add(html)
    parent, levels = tree.levels()
    leaf = np.array([t == "#text" for t in tree.tag])
    label = H.decode(np.log(draw.dirichlet([1, 1, 1], len(parent))), leaf, parent, levels)
    inner = parent >= 0
    over = label[parent[inner]]
    assert not ((over == H.OTHER) & (label[inner] != H.OTHER)).any()
    assert not ((over == H.MAIN) & (label[inner] == H.MIXED)).any()
    assert (label[leaf] != H.MIXED).all()


def test_decoder_finds_the_best_labelling():
    """Against all labellings of small trees."""
    import itertools
    draw = np.random.default_rng(7)
    for _ in range(30):
        parent = np.array([-1, *[int(draw.integers(0, k)) for k in range(1, 6)]])
        leaf = ~np.isin(np.arange(6), parent)
        depth = np.zeros(6, int)
        for k in range(1, 6):
            depth[k] = depth[parent[k]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        log_p = np.log(draw.dirichlet([1, 1, 1], 6))

        def worth(label):
            total = sum(log_p[k, x] for k, x in enumerate(label))
            for k in range(1, 6):
                over, x = label[parent[k]], label[k]
                if over == H.OTHER and x != H.OTHER or over == H.MAIN and x == H.MIXED:
                    return -np.inf
                total -= H.BREAK * (over == H.MAIN and x == H.OTHER)
            return -np.inf if any(leaf[k] and x == H.MIXED for k, x in enumerate(label)) else total
        best = max(itertools.product(range(3), repeat=6), key=worth)
        assert H.decode(log_p, leaf, parent, levels).tolist() == list(best)


def test_pages_of_the_table(spark, model):
    """Every given page's article, cut out by its known frame."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, model=model).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", article)]
        row = got[page.page_id]
        assert row.text == " ".join(b for b in blocks if b) and row.n_chars == len(row.text) and row.url == page.url


FRAMES = {
    "semantic": "<header><a href='/'>Daily</a><nav><a href='/a'>World</a> <a href='/b'>Sport</a></nav></header>"
                "<div class='cookie-banner'>We use cookies to improve this site. <button>OK</button></div>{}"
                "<aside class='sidebar'><h3>More</h3><ul><li><a href='/1'>One story</a></li><li><a href='/2'>Another</a></li></ul></aside>"
                "<section id='comments'><h3>Comments</h3><div class='comment'><p>I do not agree with this at all, sorry.</p></div></section>"
                "<footer>&copy; Daily, all rights reserved.</footer>",
    "plain": "<div id='top'><div class='menu'><ul><li><a href='#'>Home</a><li><a href='#'>About</a><li><a href='#'>Contact us</a></ul></div></div>"
             "<div class='ad-slot'>Buy one, get one free, today only!</div>{}"
             "<div class='newsletter'><form><label>Your address</label><input><button>Subscribe</button></form></div>"
             "<div id='footer'>Copyright 2024 Example. <a href='#'>Imprint</a></div>",
}
BODY = ("<h1>A  title&nbsp;here</h1><p>First &lt;paragraph&gt; with <b>bo</b>ld text,\n and more of it.<p>Second one, unclosed, with a "
        "<a href='/x'>link</a> inside.<ul><li>An item of the list.<li>Another item.</ul><p>The last paragraph ends it here.</p>")
WANT = ("A title here First <paragraph> with bold text, and more of it. Second one, unclosed, with a link inside. "
        "An item of the list. Another item. The last paragraph ends it here.")


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>",
                                    "<div id='content'>{}</div>"])
def test_written_pages(model, frame, around):
    assert text_of("<html><body>" + FRAMES[frame].format(around.format(BODY)) + "</body></html>", model) == WANT


def test_parsing():
    assert runs("a<script>if (a<b) '</p>' </script >b<!-- <p>x --><style>p{}</style>c") == ["abc"]
    assert runs("<p>one<p>two<div>three</p>four</div>") == ["one", "two", "three", "four"]
    assert runs("<p title='a>b'>one</p><p title=\"x>one") == ["one", "one"]
    assert runs("1 < 2 &amp; 3 > 2 &am<b>p;</b> &#x41;&notanentity;") == ["1 < 2 & 3 > 2 &amp; A¬anentity;"]
    assert runs("a<br>b<br/>c <i>d</i>e") == ["a b c de"]
    assert runs("<!-->a<!--->b<!x>c<?php x ?>d</>e") == ["abcde"]
    assert runs("<textarea>x</textarea><title>y</title>z <unfinished") == ["z"]
    assert runs("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert runs("x<script>never closed <p>y") == ["x"]


@pytest.mark.parametrize("piece", ["<div>", "</div>", "<a \"", "<a '>", "<!--", "<", "&", "<li><ul>", "<b>", "class=", "<script>", "&#", "</p><p>",
                                   "<p a='>", "<section><div>", " ", "<x "])
def test_linear_on_repeated_marks(piece):
    """A megabyte of each mark."""
    began = time.time()
    tree = H.Tree()
    tree.add(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 10


def test_deep_page_and_edge_rows(spark, model):
    deep = "<div>" * 3000 + "<p>Some words, in the deep.</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href='/'>Home</a></nav>"), (4, "u", deep), (None, "u", "<article><p>No id, but text.</p></article>"),
            (5, "u", "<article><p>Same page, twice.</p></article>"), (5, "u", "<article><p>Same page, twice.</p></article>"),
            (6, "u", "<article><p>" + "A long text, of many words. " * 40_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select(
        "*", *[F.lit(1).alias(c) for c in ("id", "text", "n_chars", "page")])
    got = H.extract(df, model=model).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == "" and by_id[None] == "No id, but text." and by_id[5] == "Same page, twice."
    assert by_id[6] == ("A long text, of many words. " * 40_000).strip()
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(df.where("false"), model=model).collect() == []
