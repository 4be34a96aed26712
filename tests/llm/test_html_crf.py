"""Main text of pages: parsing, training and held-out accuracy."""

import html
import itertools
import os
import re
import time

import numpy as np
import pytest

from lagline.llm import html_crf as h

FOLDER = "/root/testdata/sf0.01"
ODD = [
    None, "", "   ", "no mark-up at all", "<p>open <b>bold<p>next", "<div", "<a href='x", "&lt;p&gt; &amp;amp; &#233;&nbsp;x",
    "<script>var a = '</p>';</script><style>p{}</style><p>t</p>", "<!-- open comment", "<p>" + "long word " * 30_000 + "</p>",
]


def texts(page):
    return [b.text for b in h.blocks(page)]


def test_blocks():
    assert texts("<p>One <b>two</b>\n three<br>four<p>five<div>six</div>seven") == ["One two three four", "five", "six", "seven"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts(ODD[8]) == ["t"] and texts(ODD[7]) == ["<p> &amp; é x"] and texts("<p a='>'>x") == ["x"]
    assert texts("<div style='display:none'><p>gone</p></div><p>here") == ["here"]
    inner = h.blocks("<article class='post x1'><p>t <a href=y>link</a></p></article>")[0]
    assert inner.tags == ("article", "p") and "post" in inner.names and inner.linked == 4


def test_malformed_pages_keep_their_text():
    assert texts("<div><video src=x/></div><article><p>Real text</p></article>") == ["Real text"]
    assert texts("<form><select><option>a</form><p>Real text") == ["Real text"]
    assert texts("<p title=John's>It's one</p><p>two's</p>") == ["It's one", "two's"]
    assert texts('<p title="a>b" id=c\'d="e>f<p id = \'>\'>g') == ["f", "g"]
    assert texts("<p>a <object><p>alt</p><br></object> b</p>") == ["a b"]
    assert texts("<p>one</p><script>open <p>two") == ["one"]


def brute_path(chain, page):
    score = chain.scores(page)
    total = lambda y: sum(score[t, v] for t, v in enumerate(y)) + sum(chain.steps[a, b] for a, b in zip(y, y[1:]))
    return max(total(y) for y in itertools.product((0, 1), repeat=len(page))), total


def test_work_follows_the_length_of_deep_and_unclosed_markup():
    for page in ("<div class='post x'>x" * 50_000, "<a " * 300_000, "x>" + "<a " * 300_000, "<h1>x" * 50_000 + "</p>" * 50_000, "<p><td>" + "<h2>x" * 50_000):
        started = time.perf_counter()
        h.features(h.blocks(page))
        assert time.perf_counter() - started < 20
    assert texts("<p>a<!-- b > c") == ["a"] and texts("a<!-- b") == ["a"] and texts("<p>a<!-->b") == ["a"] and texts("x>" + "<a " * 3) == ["x>" + "<a " * 2 + "<a"] and texts("<p>a < b <c") == ["a < b <c"]


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(2)
    chain = h.Chain(draw.standard_normal((h.FEATURES, 2)), draw.standard_normal((2, 2)), draw.standard_normal((2, 2)))
    for n in range(1, 9):
        page = [draw.integers(0, h.FEATURES, 4) for _ in range(n)]
        best, total = brute_path(chain, page)
        assert abs(total(chain.decode(page)) - best) < 1e-9
    assert chain.decode([]) == []


def test_gradient_raises_the_likelihood():
    pages = h.labelled([])
    short, longer = h.train(pages, rounds=2), h.train(pages, rounds=40)
    right = lambda c: np.mean([a == b for x, y in pages for a, b in zip(c.decode(x), y)])
    assert right(longer) > 0.98 >= 0.5 and right(longer) >= right(short)


def test_held_out_skeletons():
    chain = h.train(h.labelled([]))
    other = h.skeleton_pages(["Quite different sentences are used for this.", "Short one.", "A long sentence with many words that goes on for a while, yes it does."])
    got = [chain.decode(h.slots(h.features(h.blocks(p)))) == y for p, y in other]
    assert sum(got) >= 0.9 * len(got)


def plain(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside)]
    return "\n".join(x for x in parts if x)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    chain = h.fit(pages)
    rows = h.extract(pages, chain=chain).select("html", "text", "n_chars").collect()
    assert all(r.text == plain(r.html) and r.n_chars == len(r.text) for r in rows)
    for step in (1, 2):  # the same pages without mark-up that names the article
        assert np.mean([h.main_text(h.weaker(r.html, step), chain) == r.text for r in rows]) > 0.95


def test_odd_pages_and_empty_table(spark):
    frame = spark.createDataFrame([(k, p, "x", "y") for k, p in enumerate(ODD)] + [(None, None, "x", "y")], "page_id bigint, html string, text string, n_chars string")
    chain = h.train(h.labelled([]))
    rows = h.extract(frame, chain=chain).collect()
    assert len(rows) == len(ODD) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.html is None] == ["", ""]
    assert h.extract(frame.limit(0)).count() == 0
