"""Packing by power-of-two decomposition.

A document of n tokens is cut, in order, into n // 4096 pieces of 4096 tokens and one piece
for each set bit of the rest, largest first. Every piece is a whole sequence: equal lengths
share a bucket, no sequence crosses documents and none needs padding. Nothing is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lagline.llm import bpe
from lagline.llm.kit import binary_rows, chunked

SEQUENCE_TOKENS = 4096
END_ID = 2


@lru_cache(maxsize=2)
def word_codec(path: str) -> bpe.Codec:
    """A codec for a `tokenizers` BPE file with byte symbols and an end-of-word suffix."""
    model = json.load(open(path))["model"]
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
    symbols = _byte_symbols()
    inner = np.array([vocabulary[c] for c in symbols], np.int32)
    final = np.array([vocabulary[c + suffix] for c in symbols], np.int32)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, made = ([vocabulary[f(a, b)] for a, b in pairs] for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
    merges = bpe.Merges.build(np.array(left), np.array(right), np.arange(len(pairs)), np.array(made))
    codec = bpe.Codec(bpe.PerfectHash(np.zeros(0, np.uint64), np.zeros(0, np.int32)), merges, inner, final)
    back = {c: i for i, c in enumerate(symbols)}
    words = [(bytes(back[c] for c in w[:-len(suffix)]), i) for w, i in vocabulary.items()
             if w.endswith(suffix) and len(w) > len(suffix) and all(c in back for c in w[:-len(suffix)])]
    # Only entries that their own merges produce may be answered as a whole.
    data = np.frombuffer(b"".join(w for w, _ in words), np.uint8)
    end = np.cumsum([len(w) for w, _ in words])
    start = end - np.array([len(w) for w, _ in words])
    ids, counts = codec.encode(data, start, end)
    first = ids[np.cumsum(counts) - counts]
    sound = [(w, i) for (w, i), n, got in zip(words, counts, first) if n == 1 and got == i]
    codec.whole = bpe.whole_table([w for w, _ in sound], [i for _, i in sound])
    return codec


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return [table.get(b) or chr(256 + hidden.index(b)) for b in range(256)]


def normal_form(text: str) -> str:
    """The vocabulary's normaliser: NFC, then each character's own lower case (white space goes later)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # a sigma has one lower case here, at a word's end too


def token_ids(texts: list[str], codec: bpe.Codec) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and n + 1 offsets."""
    forms = [normal_form(t) for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in forms])]).astype(np.int64)
    whole = "".join(forms)
    points, at = bpe.code_points(whole)
    start, end = bpe.pre_tokens(points, edges, with_spaces=False)
    data = np.frombuffer(whole.encode(), np.uint8)
    ids, counts = codec.encode(data, at[start], at[end])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, ends[np.searchsorted(start, edges)]


def piece_lengths(n: int, most: int = SEQUENCE_TOKENS) -> list[int]:
    """Full sequences, then the set bits of the rest from the largest."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         most: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, bucket, sequence_id, offset.

    `most` is a power of two. A null or empty text is its end token alone. Repeated rows
    give repeated pieces under sequence ids of their own; ids may be null. Other columns of
    `documents` are not read. A sequence id holds task, running number and length, so it is
    unique without a second pass; `bucket` is its length.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("a power of two is needed")
    codec = documents.sparkSession.sparkContext.broadcast(word_codec(vocabulary))
    picked = documents.select(id_col, text_col)
    schema = T.StructType([
        picked.schema[id_col], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        running = TaskContext.get().partitionId() << 31
        for chunk in chunked(batches, text_col):
            texts = [t or "" for t in chunk.column(1).to_pylist()]
            ids, offsets = token_ids(texts, codec.value)
            per = np.diff(offsets) + 1
            with_end = np.insert(ids, offsets[1:], end_id).astype("<u4")
            cuts = [piece_lengths(int(n), most) for n in per]
            counts = np.array([len(c) for c in cuts])
            length = np.array([x for c in cuts for x in c], np.int64)
            ends = np.cumsum(length)
            owner = np.repeat(np.arange(len(texts)), counts)
            begin = ends - length
            sequence = (running + np.arange(len(length))) * 16 + np.log2(length).astype(np.int64)
            running += len(length)
            columns = [
                chunk.column(0).take(pa.array(owner)), begin - (np.cumsum(per) - per)[owner], length,
                binary_rows(with_end.view(np.uint8), np.concatenate([[0], ends]) * 4), per[owner],
                length.astype(np.int32), sequence, np.zeros(len(length), np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=arrow)

    return picked.mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a loader fills batches from sequences of one shape."""
    pieces.write.partitionBy("bucket").parquet(path)
