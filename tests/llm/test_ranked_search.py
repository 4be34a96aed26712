"""Hard negatives, exact top-k search and ranked lexical search against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.llm import angular_negatives, block_search, lexical_blocks, metric_tree
from lagline.llm.queries import prepare
from tests.llm.brute import LOWER

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, block string, score string, dim string"


def usable(rows, labelled):
    """[(id, whole components, label)] of the rows that take part."""
    return [
        (i, [min(max(math.floor(256 * x), -2**53), 2**53) for x in v], k) for i, v, k in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and (k is not None or not labelled)
    ]


def order(pair):
    i, score = pair
    return -score, i is None, i


def scores(rows, at, keep):
    """(id, score) of the rows that `keep` takes, best first, without the row itself."""
    own = rows[at]
    found = []
    for n, (i, v, k) in enumerate(rows):
        if n != at and len(v) == len(own[1]) and keep(k, own[2]):
            found.append((i, min(max(sum(a * b for a, b in zip(own[1], v)), -2**63 + 1), 2**63 - 1)))
    return sorted(found, key=order)


def plain_top(rows, every):
    rows = usable(rows, False)
    return sorted((
        (i, n, j, s) for at, (i, _, _) in enumerate(rows) if i is not None and i % every == 0
        for n, (j, s) in enumerate(scores(rows, at, lambda a, b: True)[:5], 1)), key=str)


def plain_negatives(rows, every):
    rows, out = usable(rows, True), []
    for at, (i, _, _) in enumerate(rows):
        if i is None or i % every:
            continue
        others = scores(rows, at, lambda a, b: a != b)
        for p, ps in scores(rows, at, lambda a, b: a == b)[:5]:
            fit = [(n, s) for n, s in others if 50 * ps <= 100 * s <= 95 * ps]
            out += [(i, p, r, n, ps, s) for r, (n, s) in enumerate(fit[:3], 1)]
    return sorted(out, key=str)


def frame_of(spark, rows):
    return prepare(spark).createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def check(spark, rows, every):
    frame = frame_of(spark, rows)
    top = metric_tree.top_products(frame, F.col("id") % every == 0)
    assert top.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in top.collect()), key=str) == plain_top(rows, every)
    hard = angular_negatives.hard_negatives(frame, F.col("id") % every == 0, F.col("label"))
    assert sorted((tuple(r) for r in hard.collect()), key=str) == plain_negatives(rows, every)


@pytest.mark.parametrize("small", [False, True])
def test_planted_vectors(spark, monkeypatch, small):
    if small:  # many blocks, pages of one block, query blocks of a few rows
        monkeypatch.setattr(block_search, "BLOCK_VALUES", 40 * 12)
        monkeypatch.setattr(block_search, "QUERY_VALUES", 5 * 12)
        monkeypatch.setattr(block_search, "PAGE_HEADS", 3)
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((6, 12))
    kinds = draw.integers(0, 6, 500)
    vectors = centres[kinds] * 0.7 + draw.standard_normal((500, 12)) * 0.4
    vectors[100:260] = vectors[100]  # a third are copies, of two labels
    vectors[300:320] *= 30
    rows = [(int(i), v.tolist(), int(k) % 4) for i, v, k in zip(draw.permutation(500), vectors, kinds)]
    check(spark, rows, 25)


def test_odd_vectors(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0, 0.5]
    rows = [
        (0, one, 1), (10, [2.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [1.0, None], 2), (7, [0.0, 0.0], 2),
        (8, [], 1), (20, [], 2), (9, [1.0, 0.5, 0.0], 2), (30, [1.0, 0.5, 0.0], 2), (None, one, 1), (None, one, 2), (0, one, 1), (0, [2.0, 1.0], 1),
        (11, [0.9, 0.4], 2), (12, [0.9, 0.4], 2), (13, one, None), (40, [-1.0, -0.5], 3), (-10, [1e6, 2e6], 3), (50, [1e300, 1.0], 1),
        (51, [1e9, -3e12], 2), (14, [0.7, 0.35], 2), (15, [0.6, 0.3], 4),
    ]
    check(spark, rows, 10)
    empty = frame_of(spark, [])
    assert metric_tree.top_products(empty, F.col("id") % 10 == 0).count() == 0
    assert angular_negatives.hard_negatives(empty, F.col("id") % 10 == 0, F.col("label")).count() == 0


def test_the_tree_skips(spark):
    draw = np.random.default_rng(2)
    own = np.floor(256 * (np.repeat(draw.standard_normal((40, 16)), 50, axis=0) + draw.standard_normal((2000, 16)) * 0.05))
    tree = metric_tree.Tree(np.arange(2000), own)
    seen = []
    wrapped = metric_tree.products
    try:
        metric_tree.products = lambda q, n, v, m: seen.append(len(q) * len(v)) or wrapped(q, n, v, m)
        own = tree.vectors[:40]
        tree.best(own, (own ** 2).sum(axis=1), np.full(40, -(1 << 63)), 5)
    finally:
        metric_tree.products = wrapped
    assert sum(seen) < 0.4 * 40 * 2000
    assert (np.sort(tree.ids) == np.arange(2000)).all() and tree.leaf.sum() > 20


def test_angle_windows_skip():
    draw = np.random.default_rng(2)
    own = np.floor(256 * (np.repeat(draw.standard_normal((40, 16)), 50, axis=0) + draw.standard_normal((2000, 16)) * 0.05))
    index = angular_negatives.AngleIndex(own[::150], True)
    body = index.body({"vector": own, "id": np.arange(2000), "label": np.zeros(2000, np.int64)})
    seen = []
    wrapped = angular_negatives.products
    ask = {"vector": own[:20], "square": (own[:20] ** 2).sum(axis=1), "label": np.zeros(20, np.int64),
           "highs": [np.array([2**63 - 1])] * 20, "lows": [np.array([int(v @ v) * 9 // 10]) for v in own[:20]]}
    try:
        angular_negatives.products = lambda q, n, v, m: seen.append(len(v)) or wrapped(q, n, v, m)
        list(index.search(ask, body, 5))
    finally:
        angular_negatives.products = wrapped
    assert sum(seen) < 0.5 * 20 * 2000


def plain_rank(items, docs):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in held.items()}
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * total // length if length else 0
            s = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((i, s))
        out += [(item, n, i, s) for n, (i, s) in enumerate(sorted(found, key=order)[:20], 1)]
    return sorted(out, key=str)


def ranked(spark, items, docs):
    asked = prepare(spark).createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc string")
    held = spark.createDataFrame([(*r, "x", 7) for r in docs], "doc_id bigint, text string, item string, n bigint")
    found = lexical_blocks.rank(asked, held)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_documents(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical_blocks, "ITEM_BYTES", 400)
    draw = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("eno", "ÄR", "Äx", "9")]
    share = 1 / np.arange(1, len(words) + 1)
    say = lambda n: " ".join(draw.choice(words, n, p=share / share.sum()))
    docs = [(int(i), say(int(draw.integers(1, 120)))) for i in draw.permutation(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(300)]  # ties beyond the first 20
    docs += [(5, "ab"), (5, "ab"), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "-- !"), (2003, "AENO " * 30000), (2004, say(20000))]
    items = [(k, say(int(draw.integers(1, 40)))) for k in range(30)] + [(30, None), (31, ""), (32, "nowhere at all"), (33, docs[5][1]), (33, docs[5][1]), (None, "beno")]
    assert ranked(spark, items, docs) == plain_rank(items, docs)


def test_ranking_of_nothing(spark):
    assert ranked(spark, [], [(1, "a b")]) == ranked(spark, [(1, "a b")], []) == ranked(spark, [(1, None)], [(1, "a")]) == []


def test_segments_skip_blocks():
    """Blocks below the k-th score stay unread, and the answer is that of all documents."""
    draw = np.random.default_rng(3)
    n, terms = 3000, 60
    vectors = np.where(draw.random((n, terms)) < 0.25, draw.integers(1, 900, (n, terms)), 0)
    for k in range(30):
        vectors[k * 100:k * 100 + 100, (2 * k) % terms] += 4000  # groups of similar documents
    items = lexical_blocks.Items([{2 * k: 3, 2 * k + 1: 1, 5: 1} for k in range(10)], np.arange(terms, 0, -1))
    owner, term = np.nonzero(vectors)
    search = lexical_blocks.Search(items, np.ones(10, np.int64), 20)
    asked = []
    inner = search._merge
    search._merge = lambda i, d, s: asked.append(len(i)) or inner(i, d, s)
    search.segment(np.arange(n), term, vectors[owner, term], owner)
    for k, item in enumerate([{2 * k: 3, 2 * k + 1: 1, 5: 1} for k in range(10)]):
        score = sum(c * vectors[:, t] for t, c in item.items())
        best = np.lexsort((np.arange(n), -score))[:20]
        assert (search.docs[k] == best).all() and (search.scores[k] == score[best]).all()
    assert sum(asked) < 0.5 * 10 * n
