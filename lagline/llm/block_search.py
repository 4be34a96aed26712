"""Highest integer inner products of a stated query set against all rows, block by block.

Rows and queries are numbered in the order of a coarse clustering and cut into blocks of a
fixed number of components. Block heads (a few numbers that bound every score in the block)
stand on pages. A first round searches the few most promising blocks of each query block; its
scores raise what a hit must reach, and the second round visits only the blocks whose heads
cannot exclude it. What a head looks like, how it bounds and how a block is searched is the
business of an index: see `angular_negatives` and `metric_tree`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.functions.numbering import number_rows
from lagline.staging import staged

BLOCK_VALUES = 1 << 18  # components of one block of rows, and
QUERY_VALUES = 1 << 16  # of one block of queries; a block holds one row at least
PAGE_HEADS = 256  # block heads on one page
NEAR_BLOCKS = 2  # blocks that the first round searches for each block of queries
SAMPLE_ROWS, SAMPLE_VALUES = 4096, 1 << 20  # bounds of the sample that pivots are chosen from
PIVOTS = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = 1 << 53  # components saturate here; below it sums of products are exact in doubles


class Index(Protocol):
    def head(self, block: dict) -> dict: ...
    def body(self, block: dict): ...
    def highest(self, queries: dict, heads: dict) -> np.ndarray: ...
    def search(self, queries: dict, body, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]: ...


def integer_rows(frame: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """(id, label, dim, vector) with components floor(256 * x), of the rows that take part.

    Null vectors and those with a null or non-finite component take no part. Components
    saturate at 2^53. A null id stands as the largest long and so comes last among ties.
    """
    own = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")]
    rows = frame.select(*own, (F.lit(0) if label is None else label).cast("bigint").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x * 256, F.lit(float(EXACT))), F.lit(float(-EXACT))))
    valid = F.col("vector").isNotNull() & F.col("label").isNotNull() & ~F.exists("vector", bad)
    return rows.where(F.coalesce(valid, F.lit(False))).select(
        F.coalesce("id", F.lit(MOST)).alias("id"), "label", F.size("vector").alias("dim"), F.transform("vector", whole).alias("vector"))


def least_ids(rows: DataFrame, most: int) -> DataFrame:
    """Of equal rows only those of the `most` least ids: equal vectors have equal scores, so no
    others can be among a query's first `most`. The limit applies before the shuffle too."""
    order = W.partitionBy("label", "dim", "vector").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def products(queries: np.ndarray, length: float, vectors: np.ndarray, longest: float) -> np.ndarray:
    """Integer inner products by query and vector, given the longest of each; those beyond the range of a long stay at its end."""
    if length * longest < EXACT / 2:
        return (queries @ vectors.T).astype(np.int64)
    q, v = ([[int(x) for x in row] for row in side] for side in (queries, vectors))
    return np.array([[min(max(sum(a * b for a, b in zip(x, y)), LEAST + 1), MOST) for y in v] for x in q], np.int64).reshape(len(q), len(v))


def pivots(rows: DataFrame) -> np.ndarray:
    """Up to PIVOTS vectors, each far from those before it, of a bounded sample chosen by hash."""
    facts = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not facts[0]:
        return np.zeros((1, 1))
    width = max(1, facts[1])
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    chance = int(min(1.0, most / facts[0]) * (1 << 30))
    of = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < chance
    picked = sorted(r[0] for r in rows.where(of).select("vector").limit(2 * most).collect())
    sample = np.array([v + [0] * (width - len(v)) for v in picked] or [[0] * width], float)
    found, away = [0], np.full(len(sample), np.inf)
    while len(found) < min(PIVOTS, len(sample)):
        away = np.minimum(away, np.linalg.norm(sample - sample[found[-1]], axis=1))
        if not away.max():
            break
        found.append(int(away.argmax()))
    return sample[found]


def fitted(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Pivots cut or padded to another number of components."""
    out = np.zeros((len(vectors), dim))
    out[:, :min(dim, vectors.shape[1])] = vectors[:, :dim]
    return out


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows with equal whole-number keys, one table each."""
    key, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1), len(batch)]
        for start, end in zip(edges, edges[1:]):
            now = tuple(int(x) for x in values[:, start])
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


def located(rows: DataFrame, anchors: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            vectors = batch.column(batch.schema.get_field_index("vector"))
            region, near = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                own, at = matrix(vectors.take(pa.array(pick)), int(dim)), fitted(anchors, int(dim))
                away = np.stack([np.linalg.norm(own - a, axis=1) for a in at], axis=1)
                region[pick], near[pick] = away.argmin(axis=1), away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(near)], [*batch.schema.names, "region", "near"])

    return rows.mapInArrow(run, f"{kind}, region int, near double")


def blocked(rows: DataFrame, values: int, order: list[str]) -> DataFrame:
    """Add a block number: neighbours in (dim, *order) share a block of about `values` components.

    A cluster that holds much of the table, equal vectors included, fills many blocks.
    """
    unique = [F.col(c) for c in ("dim", *order)] + [F.xxhash64("vector"), F.col("id")]
    numbered = number_rows(rows, unique, "row")
    size = F.greatest(F.lit(1), F.floor(F.lit(values) / F.greatest("dim", F.lit(1))))
    return numbered.withColumn("block", F.floor(F.col("row") / size).cast("bigint"))


def packed_blocks(rows: DataFrame, index: Index) -> DataFrame:
    """(dim, block, head, body) of `blocked` rows."""

    def run(batches):
        for (dim, number), table in runs(batches, ["dim", "block"]):
            block = {c: table.column(c).to_numpy() for c in ("id", "label", "region")} | {"vector": matrix(table.column("vector"), dim)}
            made = [pickle.dumps(x, protocol=5) for x in (index.head(block), index.body(block))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), *(pa.array([m], pa.binary()) for m in made)], ["dim", "block", "head", "body"])

    dealt = rows.repartition("dim", "block").sortWithinPartitions("dim", "block", "row")
    return dealt.mapInArrow(run, "dim int, block bigint, head binary, body binary")


def packed_queries(queries: DataFrame) -> DataFrame:
    """(dim, qblock, queries) of rows (id, label, dim, vector, lows, highs, block)."""

    def run(batches):
        for (dim, number), table in runs(batches, ["dim", "block"]):
            made = {c: table.column(c).to_numpy() for c in ("id", "label")} | {"vector": matrix(table.column("vector"), dim)}
            made |= {c: [np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in ("lows", "highs")}
            made["square"] = (made["vector"] ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([pickle.dumps(made, protocol=5)], pa.binary())], ["dim", "qblock", "queries"])

    dealt = queries.repartition("dim", "block").sortWithinPartitions("dim", "block", "row")
    return dealt.mapInArrow(run, "dim int, qblock bigint, queries binary")


def paged(blocks: DataFrame) -> DataFrame:
    """(dim, page, heads): the heads of PAGE_HEADS blocks, one array per fact."""

    def run(batches):
        for (dim, page), table in runs(batches, ["dim", "page"]):
            heads = [pickle.loads(h) for h in table.column("head").to_pylist()]
            made = {k: np.stack([h[k] for h in heads]) for k in heads[0]} | {"block": table.column("block").to_numpy()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([page], pa.int64()), pa.array([pickle.dumps(made, protocol=5)], pa.binary())], ["dim", "page", "heads"])

    heads = blocks.select("dim", F.floor(F.col("block") / PAGE_HEADS).cast("bigint").alias("page"), "block", "head")
    return heads.repartition("dim", "page").sortWithinPartitions("dim", "page", "block").mapInArrow(run, "dim int, page bigint, heads binary")


def reached(queries: DataFrame, pages: DataFrame, index: Index) -> DataFrame:
    """(dim, qblock, block, best): blocks that some query of the block may find a hit in."""

    def run(batches):
        for batch in batches:
            for dim, qblock, own, heads in zip(*(batch.column(k).to_pylist() for k in range(4))):
                heads = pickle.loads(heads)
                best = index.highest(pickle.loads(own), heads)
                some = np.flatnonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), dim, np.int32)), pa.array(np.full(len(some), qblock, np.int64)), pa.array(heads["block"][some]), pa.array(best[some])],
                    ["dim", "qblock", "block", "best"])

    ends = pages.groupBy("dim").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    cells = queries.join(ends, "dim").select("*", F.explode(F.sequence("first", "last")).alias("page")).join(pages, ["dim", "page"])
    return cells.select("dim", "qblock", "queries", "heads").mapInArrow(run, "dim int, qblock bigint, block bigint, best double")


def searched(cells: DataFrame, queries: DataFrame, blocks: DataFrame, index: Index, most: int) -> DataFrame:
    """(class, band, id, score): the first `most` hits of each query and band in each block of `cells`."""

    def run(batches):
        last, body = None, None
        for batch in batches:
            for dim, number, own, held in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (dim, number) != last:
                    last, body = (dim, number), pickle.loads(held)
                own, out = pickle.loads(own), []
                for query, band, ids, scores in index.search(own, body, most):
                    out.append((np.full(len(ids), own["id"][query]), np.full(len(ids), band, np.int32), ids, scores))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["class", "band", "id", "score"])

    joined = cells.select("dim", "qblock", "block").join(queries, ["dim", "qblock"]).join(blocks.select("dim", "block", "body"), ["dim", "block"])
    return joined.select("dim", "block", "queries", "body").mapInArrow(run, "class bigint, band int, id bigint, score bigint")


def first_hits(found: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("class", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(rows: DataFrame, queries: DataFrame, index: Index, anchors: np.ndarray, most: int, order: list[str] | None = None) -> DataFrame:
    """(class, band, rank, id, score): for each query and band, its `most` best rows.

    `rows` are (id, label, dim, vector); `queries` have a class as their id, and arrays `lows`
    and `highs` of the whole scores that each band takes, ends included. Higher scores come
    first, ties by smaller id. Rows and queries of different numbers of components never meet.
    """
    order = order or ["region", "near"]
    blocks = staged(packed_blocks(blocked(located(rows, anchors), BLOCK_VALUES, order), index), "blocks")
    asked = staged(blocked(located(queries, anchors), QUERY_VALUES, order), "asked")
    pages = staged(paged(blocks), "pages")
    own = staged(packed_queries(asked), "queries")
    favourite = W.partitionBy("dim", "qblock").orderBy(F.desc("best"), "block")
    near = staged(
        reached(own, pages, index).withColumn("_n", F.row_number().over(favourite)).where(F.col("_n") <= NEAR_BLOCKS).drop("_n"), "near")
    early = staged(first_hits(searched(near, own, blocks, index, most), most), "early")
    reach = early.where(F.col("rank") == most).groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("reach"))
    higher = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.col("reach")[i], x)))
    raised = asked.join(reach, asked["id"] == reach["class"], "left").withColumn("lows", higher).drop("class", "reach")
    own = staged(packed_queries(raised), "queries")
    far = staged(reached(own, pages, index).join(near.select("dim", "qblock", "block"), ["dim", "qblock", "block"], "left_anti"), "far")
    late = searched(far, own, blocks, index, most)
    return staged(first_hits(early.drop("rank").unionByName(late), most), "hits")
