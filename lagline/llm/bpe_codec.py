"""Byte-level BPE over whole texts: encode by ranks, decode by table."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from lagline.llm import bpe
from lagline.llm.kit import binary_rows, byte_buffer, map_rows, ragged


@lru_cache(maxsize=2)
def rank_table(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@lru_cache(maxsize=2)
def rank_codec(path: str) -> bpe.Codec:
    """Two neighbours merge at the rank of their joined bytes, so every split of a token into two tokens is a pair."""
    tokens = rank_table(path)
    number = {t: i for i, t in enumerate(tokens) if t}
    left, right, made = [], [], []
    for token, i in number.items():
        for cut in range(1, len(token)):
            a, b = number.get(token[:cut]), number.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                made.append(i)
    made = np.array(made)
    single = np.array([number[bytes([b])] for b in range(256)], np.int32)
    return bpe.Codec(
        bpe.whole_table(list(number), list(number.values())),
        bpe.Merges.build(np.array(left), np.array(right), made, made), single, single,
    )


def encode_texts(texts: list[str], codec: bpe.Codec) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = "".join(texts)
    points, at = bpe.code_points(whole)
    start, end = bpe.pre_tokens(points, edges, with_spaces=True)
    ids, counts = codec.encode(np.frombuffer(whole.encode(), np.uint8), at[start], at[end])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, ends[np.searchsorted(start, edges)]


def encode(documents: DataFrame, ranks: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens and ids (little-endian uint32). Special tokens are ordinary text here.

    A null or empty text has no ids. Rows are independent, so repeated rows and other columns
    stay as they are; columns called n_tokens or ids are replaced.
    """
    codec = documents.sparkSession.sparkContext.broadcast(rank_codec(ranks))
    at = documents.columns.index(text_col)

    def run(chunk):
        ids, offsets = encode_texts([t or "" for t in chunk.column(at).to_pylist()], codec.value)
        return [pa.array(np.diff(offsets)), binary_rows(ids.astype("<u4").view(np.uint8), offsets * 4)]

    return map_rows(documents, run, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], text_col)


def decode(frame: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes that the ids stand for. Null or no ids give no bytes."""
    tokens = rank_table(ranks)
    ends = np.cumsum([len(t) for t in tokens])
    table = frame.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), ends))
    at = frame.columns.index(ids_col)

    def run(chunk):
        data, ends = table.value
        begin = np.concatenate([[0], ends[:-1]])
        raw, offsets = byte_buffer(chunk.column(at))
        ids = raw.tobytes()
        ids = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = (ends - begin)[ids]
        out = np.concatenate([[0], np.cumsum(lengths)])
        return [binary_rows(data[ragged(begin[ids], lengths)], out[offsets // 4])]

    return map_rows(frame, run, [("decoded", T.BinaryType())], ids_col)
