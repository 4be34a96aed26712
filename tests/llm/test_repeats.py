"""Repeated passages and suffix sorting against plain versions."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagline.llm import lyndon_dedup, queries, suffixes
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def answer(frame):
    cut = lyndon_dedup.remove_repeats(frame)
    rows = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_suffix_order():
    draw = random.Random(3)
    for _ in range(1500):
        letters = draw.choice([1, 2, 3, 6, 40])
        text = [draw.randrange(letters) for _ in range(draw.randrange(40))] * draw.choice([1, 1, 3])
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffixes.suffix_array(text) == order
        best = suffixes.longest_shared(text)
        for i in range(len(text)):
            n = 0
            while i + n < len(text) and any(j != i and text[j:j + n + 1] == text[i:i + n + 1] for j in range(len(text) - n)):
                n += 1
            assert best[i] == n


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_table(spark):
    frame = queries.documents(spark, FOLDER)
    rows = [(r[0], r[1]) for r in frame.collect()]
    want = brute.repeats(rows)
    assert sum(r[2] for r in want) > 0
    assert answer(frame) == want


def mixed(seed, docs=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéß ") for _ in range(draw.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(draw.randrange(60, 200)) for _ in range(8)] + ["a" * 700, "ab" * 500, "x" * 399]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            piece = draw.choice(shared)
            a, b = sorted((draw.randrange(len(piece)), draw.randrange(len(piece))))
            parts += [prose(draw.randrange(0, 30)), draw.choice([piece, piece[a:b], piece[b:]])]
        rows.append((i, " ".join(parts)))
    return rows + [(900, None), (901, ""), (902, "short"), (902, "short"), (None, rows[0][1]), (903, rows[1][1] + "!"), (904, "z" * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [200, 3])
def test_edges_copies_and_runs(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(lyndon_dedup, "HOT", hot)
    monkeypatch.setattr(lyndon_dedup, "TASK_BYTES", 20_000)
    rows = mixed(seed)
    assert answer(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute.repeats(rows)


def test_common_passages_make_few_rows(spark, monkeypatch):
    """Rows of hot anchors follow places of passages, not their windows."""
    rows_of, stage = {}, lyndon_dedup.staged

    def counted(frame, name="stage", *rest):
        made = stage(frame, name, *rest)
        rows_of[name] = made.count()
        return made

    monkeypatch.setattr(lyndon_dedup, "HOT", 10)
    monkeypatch.setattr(lyndon_dedup, "staged", counted)
    draw = random.Random(5)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    passages = [prose(n) for n in (90, 200, 340)]
    rows = [(i, prose(40) + " " + passages[i % 3] + " " + prose(i % 50)) for i in range(60)]
    assert answer(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute.repeats(rows)
    repeated = sum(20 * (len(p) - lyndon_dedup.LENGTH + 1) for p in passages)
    made = sum(rows_of.get(n, 0) for n in ("pieces", "windows"))
    assert 0 < made < repeated / 4


def test_a_common_passage_is_spread(spark):
    """The places of one passage in many texts are marked in many tasks."""
    draw = random.Random(6)
    passage = bytes(draw.randrange(97, 123) for _ in range(lyndon_dedup.LENGTH + 20))
    rows = [(7, 3000, b"%04d" % i, 5, 21, 63, passage) for i in range(2000)]
    rows += [(7, 3000, b"x%04d" % i, 5, 21, 63, bytes([65 + i % 7]) * 10 + b"%04d" % i + passage[14:]) for i in range(1000)]
    bodies = spark.createDataFrame(rows, "gram bigint, n bigint, key binary, first int, windows int, reach int, body binary")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        found = lyndon_dedup._counted_runs(bodies, lyndon_dedup.LENGTH)
        dealt = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        covered = {bytes(r["key"]): (r["a"], r["b"]) for r in found.groupBy("key").agg(F.min("start").alias("a"), F.max("end").alias("b")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(dealt) < sum(dealt) / 8
    size, seen, want = lyndon_dedup.LENGTH, Counter(r[6][k:k + lyndon_dedup.LENGTH] for r in rows for k in range(r[4])), {}
    for *_, key, first, windows, _, body in rows:
        twice = [first + k for k in range(windows) if seen[body[k:k + size]] > 1]
        want[key] = (twice[0], twice[-1] + size)
    assert covered == want


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "t" * 500, "a", "b")], "doc_id bigint, text string, kept string, `key` string")
    got = lyndon_dedup.remove_repeats(frame).first()
    assert got["key"] == "b" and got["n_removed"] == 500 and bytes(got["kept"]) == b""
    assert lyndon_dedup.remove_repeats(frame.limit(0)).count() == 0
