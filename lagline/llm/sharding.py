"""Shuffled shards from a keyed permutation of global row numbers.

Rows get dense numbers 0..n-1 in a stated order; a Feistel network over the smallest
even-bit domain that holds n, walked along its cycle until it falls below n, permutes
them. Position p goes to shard p % shards, slot p // shards. So both are computable from
a row number alone, and a row number from shard and slot, without the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lagline.llm.kit import U64, draws, mix
from lagline.staging import staged

ROUNDS = 6


class Permutation:
    """A bijection of 0..n-1, with its inverse, from a seed."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = draws(seed, ROUNDS)

    def _step(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        mask, half = U64((1 << self.half) - 1), U64(self.half)
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return right << half | left  # swapped, so that reversed keys undo it

    def _walk(self, x, keys: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        with np.errstate(over="ignore"):
            out = self._step(x, keys)
            far = np.flatnonzero(out >= U64(self.n))
            while len(far):
                out[far] = self._step(out[far], keys)
                far = far[out[far] >= U64(self.n)]
        return out.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, self.keys)

    def backward(self, positions) -> np.ndarray:
        return self._walk(positions, self.keys[::-1])


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one global row number."""
    position = int(Permutation(n, seed).forward([row])[0])
    return position % shards, position // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Global row number in one slot of a shard."""
    return int(Permutation(n, seed).backward([slot * shards + shard])[0])


def global_rows(frame: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Dense numbers in `order`, and the number of rows.

    Range partitions spread the sort; the scan position breaks ties, so that repeated rows
    or a key with a third of all rows spread too. One count per partition reaches the driver.
    """
    tie = F.monotonically_increasing_id()
    ranged = (
        frame.withColumn("__tie", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie")
        .drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    )
    stored = staged(ranged, "sharding")
    part = F.shiftright("__at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    base, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(base)
        base += counts.get(p, 0)
    starts = F.array(*[F.lit(x).cast("bigint") for x in offsets or [0]])
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn(name, F.get(starts, part) + local).drop("__at"), base


def assign_shards(frame: DataFrame, order: list[Column], shards: int, seed: int = 0) -> DataFrame:
    """Add global_row, shard and slot (both bigint but shard) to every row of `frame`.

    Shards differ by one row at most and slots are gapless from 0. The same rows and seed
    give the same answer however they are stored, as long as `order` tells different rows
    apart; equal rows may swap numbers. Nulls sort first. Columns of `frame` with these
    three names are replaced. An empty frame stays empty.
    """
    frame = frame.drop("global_row", "shard", "slot")
    numbered, n = global_rows(frame, order, "global_row")
    permutation = Permutation(n, seed)

    @F.pandas_udf(T.LongType())
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(rows.to_numpy()))

    placed = numbered.withColumn("__position", position("global_row"))
    return placed.withColumns({
        "shard": (F.col("__position") % shards).cast("int"),
        "slot": F.expr(f"__position div {shards}"),
    }).drop("__position")
