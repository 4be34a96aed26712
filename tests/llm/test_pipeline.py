"""The pipeline against plain versions of its stages."""

import os
import re
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lagline.llm import sanitize
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def stored(spark, frame, folder, name):
    frame.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


@needs_tables
def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = rows_of(docs)
    kept = stored(spark, stages["quality_rules"](spark, docs, FOLDER), folder, "a")
    passed = []
    for doc_id, text in before:
        words, chars, symbols, dup, repeated = brute.quality(text)
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        if not (words < 50 or 100 * repeated > 50 * words or 10 * symbols > words or chars < 2 * words or chars > 25 * words or 2 * dup > lines):
            passed.append((doc_id, text))
    assert rows_of(kept) == passed
    own = rows_of(kept)
    single = stored(spark, stages["near_duplicates"](spark, kept, FOLDER), folder, "b")
    best = {c: i for i, _, c in brute.near_duplicates(own) if i == c}
    assert rows_of(single) == [r for r in own if r[0] in best.values()] and len(single.columns) == len(docs.columns)
    own = rows_of(single)
    cut = stored(spark, stages["repeated_passages"](spark, single, FOLDER), folder, "c")
    facts = {r[0]: r for r in brute.repeats(own)}
    assert [i for i, _ in rows_of(cut)] == [i for i, _ in own]
    assert all((t == dict(own)[i]) == (facts[i][2] == 0) for i, t in rows_of(cut))
    assert cut.where("n_chars <> length(text)").count() == 0
    own = dict(rows_of(cut))
    masked = stored(spark, stages["personal_data"](spark, cut, FOLDER), folder, "d")
    for doc_id, text in rows_of(masked):
        assert (text == own[doc_id]) == (not sanitize.base_spans(own[doc_id]))
        assert not sanitize.base_spans(text)
    own = dict(rows_of(masked))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in stages["packing"](spark, masked, FOLDER).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(struct.unpack(f"<{r['length']}I", bytes(r["ids"])))
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in own.items()}


def test_odd_rows_pass_every_stage(spark, folder):
    prose = " ".join(f"word{i % 61}x{i}" for i in range(90))
    rows = [(None, prose), (1, prose), (1, prose), (2, None), (3, ""), (4, prose + " more"), (5, "x " * 20_000), (None, None)]
    docs = spark.createDataFrame([(i, t, "k", "root") for i, t in rows], "doc_id bigint, text string, key string, kept string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(spark, stage(spark, docs, folder), folder, str(k))
        if k == 1:
            assert [r["doc_id"] for r in docs.collect()] == [1]
    assert docs.count() > 0
    docs = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(spark, stage(spark, docs, folder), folder, f"e{k}")
    assert docs.count() == 0
