"""Span hashes of structured words, and the marks of very many edges."""

import numpy as np
from pyspark.sql import functions as F

from lagline.llm import components, kit


def test_structured_words_have_different_hashes():
    """Modulo a power of two, this word and its complement collide for every base."""
    word = bytes(97 + bin(i).count("1") % 2 for i in range(1024))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + other + word, np.uint8)
    at = np.array([0, 1024, 2048])
    a, b, c = kit.SpanHash(data).of(at, at + 1024)
    assert a == c != b


def test_hashes_do_not_depend_on_the_place():
    data = np.random.default_rng(1).integers(0, 256, 70_000).astype(np.uint8)
    whole, later = kit.SpanHash(data), kit.SpanHash(data[40_001:])
    assert (whole.every(24)[40_001:] == later.every(24)).all()
    start = np.arange(0, 60_000, 7)
    assert (whole.every(24)[start] == kit.SpanHash(data).every(24)[start]).all()
    assert len(np.unique(whole.of(start, start + 9))) == len(start)
    assert len(kit.SpanHash(data[:3]).every(4)) == 0


def test_marks_of_many_edges(spark):
    edges = spark.range(3_000_000).select(F.col("id").alias("a"), (F.col("id") + 5_000_000).alias("b"))
    assert components._mark(edges)[0] == 3_000_000
    assert components._mark(edges) == components._mark(edges.repartition(3))
    assert components._mark(edges) != components._mark(edges.withColumn("b", F.col("b") + 1))
