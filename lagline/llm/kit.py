"""Vectorised text helpers for Arrow tasks: chunks, byte buffers, span hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_BYTES = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, element-wise on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draws(seed: int, n: int) -> np.ndarray:
    """n fixed uint64 values for a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and n + 1 offsets. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunked(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = byte_buffer(column)
        at = 0
        while at < len(batch):
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), len(batch))
            yield batch.slice(at, end - at)
            at = end


PRIME = U64((1 << 31) - 1)
STRIP = 1 << 14


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same residue modulo the Mersenne prime 2^31 - 1: from below 2^63 to below 2^33, from there to 2^31 + 4."""
    return (x & PRIME) + (x >> U64(31))


def residue(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^63, without dividing."""
    x = fold(fold(x))
    return x - PRIME * (x >= PRIME)


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo the prime, by doubling; half as wide as what they are multiplied with."""
    out = np.ones(n, np.uint32)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = residue(out[:more].astype(np.uint64) * U64(pow(base, done, int(PRIME))))
        done += more
    return out


def power_tables(bases: tuple[int, ...], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses up to n, at least.

    Tasks get their code by value, and so would get these tables; held by a module of their
    own, they are made once in every process and never travel.
    """
    shared = sys.modules.setdefault("span_hash_tables", types.ModuleType("span_hash_tables"))
    tables = vars(shared).setdefault("tables", {})
    if bases not in tables or len(tables[bases][0][0]) <= n:
        size = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        tables[bases] = [(powers(b, size), powers(pow(b, -1, int(PRIME)), size)) for b in bases]
    return tables[bases]


class SpanHash:
    """Hashes of arbitrary spans of one byte buffer, from two running sums.

    Two polynomials modulo a prime, over a random value per byte: 62 bits, spread over 64.
    Equal bytes give equal hashes wherever they stand. Modulo a power of two the Thue-Morse
    word and its complement would collide whatever the base; modulo a prime a word of n bytes
    collides with a given other one at n in 2^31 bases at most, in both sums at its square.
    """

    BYTES = draws(11, 512).reshape(2, 256) % (PRIME - U64(1)) + U64(1)
    BASES = (1_173_741_829, 1_918_734_321)  # fixed values, of large order modulo the prime

    def __init__(self, data: np.ndarray):
        self._tables = power_tables(self.BASES, len(data))
        self.sums = np.zeros((2, len(data) + 1), np.uint64)
        for k, (power, _) in enumerate(self._tables):
            for a in range(0, len(data), STRIP):  # strips that stay in the processor's cache
                own = data[a:a + STRIP]
                np.cumsum(fold(self.BYTES[k][own] * power[a:a + len(own)]), out=self.sums[k, a + 1:a + 1 + len(own)])
                self.sums[k, a + 1:a + 1 + len(own)] += self.sums[k, a]

    def _name(self, start, end) -> np.ndarray:
        high, low = (
            residue(fold(sums[end] - sums[start]) * inverse[start]) for sums, (_, inverse) in zip(self.sums, self._tables)
        )
        return high << U64(31) | low

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end]; the length takes part."""
        with np.errstate(over="ignore"):
            return mix(self._name(start, end) + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all windows of `width` bytes, by start."""
        n = self.sums.shape[1] - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for a in range(0, n, STRIP):
            b = min(a + STRIP, n)
            out[a:b] = mix(self._name(slice(a, b), slice(a + width, b + width)))
        return out


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with inside[byte], and the first word of each row.

    Runs never cross rows. The third array has one entry per row and the total at its end.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = inside[data]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the given lengths, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, lengths)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one byte buffer and n + 1 offsets."""
    wide = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())]
    )
    return wide.cast(pa.binary())


def map_rows(frame: DataFrame, function: Callable, fields: list[tuple[str, T.DataType]], text: str) -> DataFrame:
    """Append columns that `function(chunk) -> list of arrays` computes from whole rows.

    `chunk` is a record batch with about CHUNK_BYTES of `text`. A column of the same
    name is replaced; every other column passes through unchanged.
    """
    names = {n.lower() for n, _ in fields}
    through = [f.name for f in frame.schema.fields if f.name.lower() not in names]
    schema = T.StructType([frame.schema[n] for n in through] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for chunk in chunked(batches, text):
            made = function(chunk)
            columns = [chunk.column(chunk.schema.get_field_index(n)) for n in through] + list(made)
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return frame.mapInArrow(run, schema)
