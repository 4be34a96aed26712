"""Vector links against all pairs, and shards against their law."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.llm import rp_forest, sharding
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


def exact(rows):
    """[(id, vector, label)] -> sorted [(id, n_links, component, kept)]."""
    links, n = [], [0] * len(rows)
    for label in {r[2] for r in rows if r[2] is not None}:
        at = [i for i, r in enumerate(rows) if r[2] == label and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
        for dim in {len(rows[i][1]) for i in at}:
            own = [i for i in at if len(rows[i][1]) == dim]
            unit = rp_forest.unit_vectors(np.array([rows[i][1] for i in own], float))
            for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))):
                links.append((own[a], own[b]))
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = brute.roots(len(rows), links)
    least = {}
    for r, x in zip(rows, root):
        least.setdefault(x, []).append(r[0])
    least = {x: min((i for i in v if i is not None), default=None) for x, v in least.items()}
    return sorted(((r[0], k, least[x], r[0] is not None and r[0] == least[x]) for r, k, x in zip(rows, n, root)), key=str)


def got(frame, **options):
    return sorted((tuple(r) for r in rp_forest.link_vectors(frame, **options).collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_table(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert got(frame) == exact([tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()])


SCHEMA = "vec_id bigint, embedding array<float>, label int, members string, leaf string"


def planted(seed=1, n=3000, dim=24):
    draw = np.random.default_rng(seed)
    vectors = draw.standard_normal((n, dim))
    for i in range(0, n, 3):  # every third is near another one, on both sides of the limit
        vectors[i] = vectors[draw.integers(n)] + draw.standard_normal(dim) * draw.uniform(0, 0.3)
    vectors[:300] = vectors[0] + draw.standard_normal((300, dim)) * 0.05  # a dense group
    return [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, draw.integers(0, 2, n)))]


@pytest.mark.parametrize("block", [1024, 32])
def test_recall_and_no_false_links(spark, monkeypatch, block):
    monkeypatch.setattr(rp_forest, "BLOCK", block)
    rows = planted()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found, want = got(frame, leaf_rows=200), exact(rows)
    assert len(rp_forest.Forest(rp_forest.unit_vectors(np.array([r[1] for r in rows])), 3000, leaf_rows=200).trees[0]) > 3
    pairs = list(zip(found, want))
    assert all(f[0] == w[0] and f[1] <= w[1] for f, w in pairs)
    assert sum(f[1] for f in found) >= 0.97 * sum(w[1] for w in want)
    assert sum(f == w for f, w in pairs) >= 0.95 * len(pairs)


def test_large_leaves_are_split_again_by_their_own_sample(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "SAMPLE_ROWS", 256)
    monkeypatch.setattr(rp_forest, "LEAF_SAMPLE", 300)
    seen = []
    again = rp_forest._split_again
    monkeypatch.setattr(rp_forest, "_split_again", lambda *a: seen.append((a[0], again(*a))) or seen[-1][1])
    rows = planted(seed=2)
    found, want = got(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), leaf_rows=50), exact(rows)
    before, after = ([r["leaves"] for r in f.orderBy("class").collect()] for f in seen[0])
    labels = [r[0] for r in seen[0][1].orderBy("class").select("label").collect()]
    sizes = Counter((label, leaf) for label, own in zip(labels, after) for leaf in own)
    assert max(Counter((label, leaf) for label, own in zip(labels, before) for leaf in own).values()) > 300
    assert max(n for (_, leaf), n in sizes.items() if leaf >= 0) <= 100
    assert any(leaf < 0 for _, leaf in sizes) and all(after)  # the dense group stays whole
    pairs = list(zip(found, want))
    assert all(f[0] == w[0] and f[1] <= w[1] for f, w in pairs)
    assert sum(f[1] for f in found) >= 0.95 * sum(w[1] for w in want)


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0], float("nan"), float("inf")
    rows = [
        (1, one, 1), (2, [2.0, 0.001], 1), (3, one, None), (4, one, 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, nan], 1),
        (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [3e38, 1e30], 1), (4, one, 2), (None, one, 2), (13, [0.0, 1.0], 1),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert got(frame) == exact(rows)
    assert got(frame.limit(0)) == []


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = sharding.Permutation(n, 3)
        out = p.forward(np.arange(n))
        assert sorted(out) == list(range(n)) and (p.backward(out) == np.arange(n)).all()
    assert (sharding.Permutation(5000, 1).forward(np.arange(5000)) != sharding.Permutation(5000, 2).forward(np.arange(5000))).any()


def test_shards(spark):
    rows = [(i, f"text {i}", "a") for i in range(500)] + [(7, "same", "b")] * 400 + [(None, None, "c"), (None, "x", "c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    order = [F.col("doc_id"), F.xxhash64("text")]
    one = sharding.assign_shards(frame, order, 24, seed=3).collect()
    slots = {}
    for r in one:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert sharding.locate(r["global_row"], len(rows), 24, 3) == (r["shard"], r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], len(rows), 24, 3) == r["global_row"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert len(slots) == 24 and max(counts) - min(counts) <= 1
    assert sorted(r["global_row"] for r in one) == list(range(len(rows)))
    again = sharding.assign_shards(frame.repartition(7), order, 24, seed=3).collect()
    assert sorted(map(str, one)) == sorted(map(str, again))
    assert sharding.assign_shards(frame.limit(0), order, 24).count() == 0
