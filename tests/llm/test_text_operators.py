"""Text operators against plain versions, on whole small tables and on odd rows."""

import base64
import hashlib
import os
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagline.llm import bpe_codec, license_scan, packing, parity_join, queries, rule_cascade, sanitize
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LONG = " ".join(f"w{i * 7919 % 10007}x{i}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "a b c d e f"), (6, "A B C D E F"),
    (7, LONG), (8, LONG.replace("w7919x1 ", "changed ")), (9, "it's  don't \n\n 'S 's ''ll x)'s 12 345 ٣٤ Σίσυφος ΣΑΣ İx é"),
    (10, "mail Jane.Doe@mail.example.com now, +1 (988) 555-2485, 10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 a@b c@d.e@f.gg"),
    (11, "Under the MIT License. under the mit  license; Apache License, Version 2.0 cc-by-nc cc by-nc mit license"),
    (12, "😀 " * 80 + "<|endoftext|>" + "'" * 200), (13, "spam spam spam " * 40), (14, "\n".join(["same line"] * 30)),
]
SCHEMA = "doc_id bigint, text string, n_words string, ids string, kept string, start string, labels string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def docs(spark):
    return [(r[0], r[1]) for r in queries.documents(spark, FOLDER).collect()]


def test_near_duplicate_keys_need_little_memory_whatever_the_batch():
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghijklmnop", k=2000)) + f" {i}" for i in range(2000)]
    whole = pa.record_batch({"text": texts})
    peaks = {}
    for rows in (200, 2000):
        parity_join.keys_of_texts(whole.slice(0, rows), 80, 100)  # makes tables that stay
        tracemalloc.start()
        key, name = parity_join.keys_of_texts(whole.slice(0, rows), 80, 100)
        peaks[rows] = tracemalloc.get_traced_memory()[1] - key.nbytes - name.nbytes
        tracemalloc.stop()
    value, offsets = parity_join.shingle_sets(whole.column(0))
    keys, owner = parity_join.chunk_keys(value, offsets, 80, 100)
    together = lambda k, n: np.sort(np.stack([k.view(np.int64), n]).T.copy().view("i8,i8").ravel())
    assert np.array_equal(together(key, name), together(keys, parity_join.set_classes(value, offsets)[owner]))
    assert peaks[2000] < 2 * peaks[200] + 3 * (key.nbytes + name.nbytes)


@needs_tables
@pytest.mark.parametrize("table", ["documents", "odd"])
def test_near_duplicates(spark, odd, table):
    frame, rows = (odd, ODD) if table == "odd" else (queries.documents(spark, FOLDER), docs(spark))
    got = parity_join.near_duplicates(frame)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == brute.near_duplicates(rows)


@pytest.mark.parametrize("words", [6, 9, 14, 40, 200])
def test_near_duplicates_at_the_limit(spark, words):
    """Families of edits whose similarity lies on both sides of the limit; a shared passage links nobody."""
    draw = random.Random(words)
    rows, n = [], 0
    for family in range(12):
        base = [f"f{family}w{draw.randrange(40)}" for _ in range(words)]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(0, 2 + words // 40)):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(9)}"
            rows.append((n, " ".join(copy + base[:draw.randrange(3)])))
            n += 1
    rows += [(n + i, " ".join(["the", "passage"] + [f"p{k}" for k in range(words)] + [f"own{i}x{k}" for k in range(words)])) for i in range(30)]
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == brute.near_duplicates(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    test_near_duplicates_at_the_limit(spark, 9)


@needs_tables
def test_quality_statistics(spark, odd):
    for frame, rows in ((odd, ODD), (queries.documents(spark, FOLDER), docs(spark))):
        cascade = rule_cascade.plan_cascade(frame)
        assert {r.name for r in cascade.rules} == {r.name for r in rule_cascade.RULES}
        got = rule_cascade.apply_cascade(frame, cascade, with_statistics=True)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuples(got, "doc_id", *names) == sorted(((i, *brute.quality(t)) for i, t in rows), key=str)
        plain = rule_cascade.apply_cascade(frame, rule_cascade.Cascade(tuple(reversed(cascade.rules))))
        assert tuples(plain, "doc_id", "kept") == tuples(got, "doc_id", "kept")


def test_cascade_orders_by_rejection_per_cost(spark):
    rows = [(i, "word " * 3) for i in range(400)]
    cascade = rule_cascade.plan_cascade(spark.createDataFrame(rows, "doc_id bigint, text string"))
    rates = [m["rejects"] / m["cost"] for m in (cascade.measured[r.name] for r in cascade.rules)]
    assert rates == sorted(rates, reverse=True) and rates[0] > 0


@needs_tables
def test_licenses(spark, odd):
    for frame, rows in ((odd, ODD), (queries.documents(spark, FOLDER), docs(spark))):
        got = license_scan.scan(frame)
        assert tuples(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(
            ((i, *brute.licenses(t)) for i, t in rows), key=str)


def test_a_changed_license_text_is_placed(spark):
    text = next(t.text for t in license_scan.TEMPLATES if t.label == "bsd").split()
    whole = " ".join(["intro"] * 40 + text[:24] + ["oh", "well"] + text[24:])
    broken = whole.replace("retain the above copyright", "keep the above copyright")
    got = license_scan.scan(spark.createDataFrame([(1, whole), (2, broken)], "doc_id bigint, text string"))
    found = {r.doc_id: r for r in got.collect()}
    assert found[1].labels == "bsd" and found[1].score > 0.9 and found[1].places[0].word in (40, 42)
    assert found[2].labels == "" and found[2].score == 0 and found[1].first_word is None


@needs_tables
def test_personal_data(spark, odd):
    for frame, rows in ((odd, ODD), (queries.documents(spark, FOLDER), docs(spark))):
        got = sanitize.find(frame).select("doc_id", sanitize.spans_text(F.col("base")).alias("base"))
        assert tuples(got, "doc_id", "base") == sorted(((i, brute.personal(t)) for i, t in rows), key=str)


def test_base_forms_against_the_stated_patterns():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice("a1 .@-+(5%_é\n") for _ in range(draw.randrange(60)))
        got = ",".join(f"{sanitize.KINDS[k]}:{s}:{e}" for s, k, e in sanitize.base_spans(text))
        assert got == brute.personal(text)


def test_a_term_that_stands_for_an_entity_is_masked(spark):
    filler = lambda k: " ".join(f"common{(k * 31 + j * 17) % 50}" for j in range(30))
    rows = [(k, filler(k)) for k in range(300)]
    rows += [(1000 + k, f"{filler(k)} write to Zorblatt common{k} at z.b@mail.org {filler(k + 5)}") for k in range(5)]
    rows += [(2000 + k, "the same text names Quux near q@mail.org again") for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    masked = {r.doc_id: r for r in sanitize.mask(sanitize.find(frame)).collect()}
    assert masked[0].text == rows[0][1]
    assert "Zorblatt" not in masked[1000].text and "z.b@mail.org" not in masked[1000].text and "[EMAIL]" in masked[1000].text
    assert "common0" in masked[1000].text
    assert masked[2000].text == "the same text names Quux near [EMAIL] again"  # copies of one text prove nothing


def test_a_term_is_masked_wherever_it_stands_in_the_text(spark):
    filler = lambda k, n=30: " ".join(f"common{(k * 31 + j * 17) % 50}" for j in range(n))
    rows = [(k, filler(k)) for k in range(300)]
    # 50 words away and named twice; near the address and again in the signature; far away in copies of one text.
    rows += [(1000 + k, f"Zorblatt {filler(k, 50)} at z.b@mail.org {filler(k + 5)} signed ZORBLATT") for k in range(5)]
    rows += [(2000 + k, f"{filler(k)} to Grumbel at g@mail.org {filler(k + 5, 40)} yours Grumbel") for k in range(5)]
    rows += [(3000 + k, f"Quux {filler(1, 50)} near q@mail.org again") for k in range(5)]
    rows += [(4000, f"{filler(3)} Wexford {filler(4)}")] + [(4001 + k, f"Wexford {filler(k)} w{k}@mail.org") for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    told = {(r.entity, r.term) for r in sanitize.disclosures(frame).collect()}
    assert ("email:z.b@mail.org", "zorblatt") in told and ("email:g@mail.org", "grumbel") in told
    assert not {t for _, t in told} & {"quux", "wexford"}
    masked = {r.doc_id: r for r in sanitize.mask(sanitize.find(frame)).collect()}
    for k in range(5):
        assert "zorblatt" not in masked[1000 + k].text.lower() and "Grumbel" not in masked[2000 + k].text
        assert sum(s.kind == 4 and s.removed and s.end - s.start == 8 for s in masked[1000 + k].spans) == 2
        assert masked[3000 + k].text.startswith("Quux") and "common" in masked[1000 + k].text
    assert masked[4000].text == dict(rows)[4000]


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers


@needs_tables
def test_packing(spark, odd, files):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(files.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    for frame, rows in ((odd, ODD), (queries.documents(spark, FOLDER), docs(spark))):
        pieces = packing.pack(frame, files.path("word_bpe_49k.json"))
        got = pieces.groupBy("doc_id", "doc_tokens").agg(F.sort_array(F.collect_list(F.struct("start", "length", "ids"))).alias("p"))
        assert pieces.where("length <> bucket or length & (length - 1) <> 0 or length > 4096 or offset <> 0").count() == 0
        assert pieces.select("sequence_id").distinct().count() == pieces.count()
        whole = {}
        for r in got.collect():
            joined, starts = b"", set()
            for p in r.p:
                if p.start not in starts:
                    assert p.start * 4 == len(joined)
                    joined += bytes(p.ids)
                starts.add(p.start)
            whole.setdefault(r.doc_id, set()).add(struct.unpack(f"<{len(joined) // 4}I", joined))
            assert r.doc_tokens * 4 == len(joined)
        want = {}
        for i, text in rows:
            want.setdefault(i, set()).add((*tokenizer.encode(text or "", add_special_tokens=False).ids, 2))
        assert whole == want


@needs_tables
def test_byte_bpe(spark, odd, files):
    import tiktoken

    path = files.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame, rows in ((odd, ODD), (queries.documents(spark, FOLDER), docs(spark))):
        got = bpe_codec.decode(bpe_codec.encode(frame, path), path)
        want = []
        for i, text in rows:
            ids = encoding.encode_ordinary(text or "")
            want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), hashlib.sha256((text or "").encode()).hexdigest()))
        assert tuples(got.select("doc_id", "n_tokens", F.crc32("ids").alias("c"), F.sha2("decoded", 256).alias("d")), "doc_id", "n_tokens", "c", "d") == sorted(want, key=str)


def test_empty_tables(spark, empty, files):
    assert parity_join.near_duplicates(empty).count() == 0
    assert rule_cascade.apply_cascade(empty, rule_cascade.plan_cascade(empty)).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert sanitize.mask(sanitize.find(empty)).count() == 0
    assert packing.pack(empty, files.path("word_bpe_49k.json")).count() == 0
    assert bpe_codec.encode(empty, files.path("byte_bpe_multi_50k.tiktoken")).count() == 0
