"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits recursively along a random direction at the sample's median; vectors near
a split go to both sides, so a close pair rarely parts, and several trees make up for it.
Vectors are compared inside leaves only, by cosine, and a pair that shares several leaves
counts in the first. Leaves that the sample was too small to split are split again, each by a
sample of its own, until none is too large or it is too dense to part. Equal vectors are one class with a weight before anything is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm.components import components
from lagline.staging import staged

THRESHOLD = 0.98
TREES = 3
SPILL = 0.75  # half-width of the overlap, in standard deviations of a projected pair at the threshold
LEAF_ROWS = 3000  # a node of about so many vectors is not split further
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 2_000_000  # bounds of the sample the splits are fitted on
SAMPLE_LEAST = 64  # a node with fewer sample rows is not split further
LEAF_SAMPLE = 5_000  # sample rows that a leaf too large is split by, SAMPLE_VALUES components at most
BLOCK = 1024  # vectors of one leaf that one task compares, per side


class Forest:
    """Splits by tree and node: (direction, threshold), children of node k at 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, spill: float = SPILL, threshold: float = THRESHOLD,
                 leaf_rows: int = LEAF_ROWS, seed: int = 5):
        width = sample.shape[1] if len(sample) else 1
        self.width = width
        self.margin = spill * np.sqrt(2 - 2 * threshold) / np.sqrt(width)
        self.trees: list[dict[int, tuple[np.ndarray, float]]] = []
        share = rows / max(len(sample), 1)
        for tree in range(trees):
            draw, nodes = np.random.default_rng((seed, tree)), {}
            todo = [(0, np.arange(len(sample)))]
            while todo:
                node, members = todo.pop()
                if len(members) < 2 * SAMPLE_LEAST or len(members) * share <= leaf_rows:
                    continue
                direction = draw.standard_normal(width)
                direction /= np.linalg.norm(direction)
                at = sample[members] @ direction
                middle = float(np.median(at))
                sides = members[at < middle + self.margin], members[at >= middle - self.margin]
                if max(map(len, sides)) > 0.9 * len(members):
                    continue  # a dense group: splitting would copy it whole
                nodes[node] = (direction, middle)
                todo += [(2 * node + 1, sides[0]), (2 * node + 2, sides[1])]
            self.trees.append(nodes)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that holds a row; leaves are numbered over all trees."""
        rows, codes = [], []
        for tree, nodes in enumerate(self.trees):
            todo = [(0, np.arange(len(unit)))]
            while todo:
                node, members = todo.pop()
                if node not in nodes:
                    rows.append(members)
                    codes.append(np.full(len(members), tree << 48 | node, np.int64))
                    continue
                direction, middle = nodes[node]
                at = unit[members] @ direction[:unit.shape[1]]
                todo += [(2 * node + 1, members[at < middle + self.margin]), (2 * node + 2, members[at >= middle - self.margin])]
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def unit_vectors(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaling first keeps squares finite."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _routed(classes: DataFrame, forest: Forest) -> DataFrame:
    sent = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            size = vectors.value_lengths().to_numpy()
            flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size):
                pick = np.flatnonzero(size == dim)
                unit = unit_vectors(flat[(offsets[pick][:, None] + np.arange(dim)).ravel()].reshape(-1, dim))
                row, leaf = sent.value.leaves(unit[:, :sent.value.width])
                ends = np.searchsorted(row, np.arange(len(pick) + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(pick)), batch.column(1).take(pa.array(pick)), pa.array(np.full(len(pick), dim, np.int32)),
                    batch.column(3).take(pa.array(pick)), pa.array([u.tobytes() for u in unit], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf)),
                ], ["class", "label", "dim", "members", "unit", "leaves"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("class", "label", "vector", "members").mapInArrow(
        run, f"class bigint, label {kind}, dim int, members bigint, unit binary, leaves array<bigint>")


def _direction(leaf: int, node: int, dim: int) -> np.ndarray:
    direction = np.random.default_rng((leaf, node)).standard_normal(dim)
    return direction / np.linalg.norm(direction)


def leaf_splits(unit: np.ndarray, leaf: int, rows: int, margin: float, leaf_rows: int) -> dict[int, float]:
    """Thresholds by node of one leaf of `rows` vectors, of which `unit` is a sample; none if it is too dense to part."""
    nodes, todo = {}, [(0, np.arange(len(unit)))]
    while todo:
        node, members = todo.pop()
        if len(members) < 2 * SAMPLE_LEAST or len(members) * rows <= leaf_rows * len(unit):
            continue
        at = unit[members] @ _direction(leaf, node, unit.shape[1])
        middle = float(np.median(at))
        sides = members[at < middle + margin], members[at >= middle - margin]
        if max(map(len, sides)) > 0.9 * len(members):
            continue
        nodes[node] = middle
        todo += [(2 * node + 1, sides[0]), (2 * node + 2, sides[1])]
    return nodes


def _parted(unit: np.ndarray, leaf: int, nodes: dict[int, float], margin: float) -> list[tuple[np.ndarray, int]]:
    """(rows, node) of every end of a leaf's splits."""
    out, todo = [], [(0, np.arange(len(unit)))]
    while todo:
        node, members = todo.pop()
        if not len(members):
            continue
        if node not in nodes:
            out.append((members, node))
            continue
        at = unit[members] @ _direction(leaf, node, unit.shape[1])
        todo += [(2 * node + 1, members[at < nodes[node] + margin]), (2 * node + 2, members[at >= nodes[node] - margin])]
    return out


def _split_again(routed: DataFrame, spill: float, threshold: float, leaf_rows: int) -> DataFrame:
    """`routed` with no leaf of over twice `leaf_rows` vectors but those too dense to part.

    Each round counts the leaves, fits the splits of those too large in one task a leaf from
    at most about LEAF_SAMPLE of its rows, and deals their rows anew; the splits meet the rows by an
    ordinary join, so a leaf's rows may spread over tasks. A leaf that cannot be parted gets
    a negative number, which says that it is done.
    """
    kind = routed.schema["label"].dataType.simpleString()
    key = ["label", "dim", "leaf"]
    scale = spill * np.sqrt(2 - 2 * threshold)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        unit = np.frombuffer(b"".join(pdf.sort_values("class")["unit"]), np.float64).reshape(len(pdf), -1)
        nodes = leaf_splits(unit, int(first["leaf"]), int(first["n"]), scale / np.sqrt(unit.shape[1]), leaf_rows)
        return pd.DataFrame({"label": pdf["label"].iloc[:1].values, "dim": [first["dim"]], "leaf": [first["leaf"]],
                             "nodes": [list(nodes)], "middles": [list(nodes.values())]})

    def deal(batches):
        for pdf in batches:
            for (_, dim, leaf), rows in pdf.groupby(key, sort=False):
                nodes = {} if rows["nodes"].iloc[0] is None else dict(zip(rows["nodes"].iloc[0], rows["middles"].iloc[0]))
                unit = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
                for members, node in _parted(unit, int(leaf), nodes, scale / np.sqrt(dim)):
                    yield pd.DataFrame({"class": rows["class"].to_numpy()[members], "leaf": leaf, "node": node if nodes else -1})

    while True:
        large = (
            routed.select("label", "dim", F.explode("leaves").alias("leaf")).where("leaf >= 0").groupBy(*key)
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf_rows)
        )
        large = staged(large, "large")
        if large.isEmpty():
            return routed
        inside = routed.select("label", "dim", "class", "unit", F.explode("leaves").alias("leaf")).join(large, key)
        most = F.greatest(F.lit(4 * SAMPLE_LEAST), F.least(F.lit(LEAF_SAMPLE), F.floor(F.lit(SAMPLE_VALUES) / F.col("dim"))))
        chosen = F.pmod(F.xxhash64("class", "leaf"), F.lit(1 << 30)) < most / F.col("n") * (1 << 30)
        splits = inside.where(chosen).groupBy(*key).applyInPandas(
            fit, f"label {kind}, dim int, leaf bigint, nodes array<bigint>, middles array<double>")
        dealt = inside.join(staged(splits, "splits"), key, "left").select(*key, "class", "unit", "nodes", "middles").mapInPandas(
            deal, "class bigint, leaf bigint, node bigint")
        # A leaf's new number is a hash of the old one and the node; equal numbers by chance only join two leaves.
        new = F.when(F.col("node") < 0, F.bitwise_not("leaf")).otherwise(F.shiftrightunsigned(F.xxhash64("leaf", "node"), 1))
        moved = dealt.select("class", "leaf", new.alias("new")).groupBy("class").agg(
            F.collect_set("leaf").alias("left"), F.collect_set("new").alias("entered"))
        none = F.array().cast("array<bigint>")
        leaves = F.array_union(F.array_except("leaves", F.coalesce("left", none)), F.coalesce("entered", none))
        routed = staged(routed.join(moved, "class", "left").select(
            "class", "label", "dim", "members", "unit", F.array_sort(leaves).alias("leaves")), "routed")


def _earlier(leaves: list, leaf: int) -> np.ndarray:
    """0/1 by vector and leaf, for the leaves before `leaf`: a positive product of two rows says that they met before."""
    lists = [[x for x in own if x < leaf] for own in leaves]
    known = {x: k for k, x in enumerate(sorted({x for own in lists for x in own}))}
    out = np.zeros((len(lists), max(1, len(known))), np.float32)
    for row, own in enumerate(lists):
        out[row, [known[x] for x in own]] = 1
    return out


def _compared(key: tuple, rows: list, threshold: float):
    """(class, links, root): links counted here for the first time, and a class of the same local group."""
    leaf, i, j = key[2], key[3], key[4]
    rows = sorted(rows, key=lambda r: r[1])
    block, name, members = (np.array([r[k] for r in rows]) for k in range(3))
    unit = np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(len(rows), -1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    close = unit[left] @ unit[right].T >= threshold
    if i == j:
        np.fill_diagonal(close, False)
    if not close.any():
        return
    before = _earlier([r[4] for r in rows], leaf)
    fresh = close & (before[left] @ before[right].T == 0)
    links = np.zeros(len(rows), np.int64)
    links[left] += fresh @ members[right]
    if i != j:
        links[right] += fresh.T @ members[left]
    # The least row that each row reaches, through both sides until nothing changes.
    root = np.arange(len(rows))
    while True:
        last = root.copy()
        root[left] = np.minimum(root[left], np.where(close, root[right][None, :], len(rows)).min(axis=1))
        root[right] = np.minimum(root[right], np.where(close, root[left][:, None], len(rows)).min(axis=0))
        root = root[root]
        if (root == last).all():
            break
    some = np.flatnonzero((links > 0) | (root != np.arange(len(rows))))
    yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(links[some]), pa.array(name[root[some]])], ["class", "links", "root"])


def link_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows with equal, non-null labels and equal dimension whose cosine is at least `threshold`
    link when some leaf holds both. Null, empty and zero vectors and those with null or
    non-finite components link with nothing: their component is their own id. Every row is a
    vector of its own, so repeated rows link with each other; component_id is the least id
    reachable (null only if all are null) and kept says that it is the row's own.
    """
    rows = embeddings.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.coalesce(
        F.col("label").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(valid)
    classes = staged(
        good.groupBy("label", "vector").agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("members"))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    total, width = facts[0], facts[1] or 1
    most = max(SAMPLE_LEAST, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    # Chosen by hash, so that no task sends more than its share; twice the bound is never exceeded.
    chance = int(min(1.0, most / max(total, 1)) * (1 << 30))
    picked = [r[0] for r in classes.select("vector").where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < chance).limit(2 * most).collect()]
    sample = unit_vectors(np.array([v + [0.0] * (width - len(v)) for v in picked])) if picked else np.zeros((0, 1))
    forest = Forest(sample, total, trees, spill, threshold, leaf_rows)
    routed = _split_again(staged(_routed(classes, forest), "routed"), spill, threshold, leaf_rows)
    in_leaf = routed.select("label", "dim", "class", F.explode("leaves").alias("leaf"))
    large = (
        in_leaf.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("label", "dim", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = (
        routed.select("*", F.explode("leaves").alias("leaf")).join(large, ["label", "dim", "leaf"]).withColumn("block", block)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("label", "dim", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "class", "members", "unit", "leaves")
    )

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != key:
                    if held:
                        yield from _compared(key, held, threshold)
                    key, held = row[:5], []
                held.append(row[5:])
        if held:
            yield from _compared(key, held, threshold)

    group = ["label", "dim", "leaf", "i", "j"]
    found = staged(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "class bigint, links bigint, root bigint"), "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    told = staged(
        classes.join(links, "class", "left").join(roots, "class", "left")
        .select("class", "label", "vector", "first_id", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")), "told")
    least = told.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = told.join(least, "root").select("label", "vector", (F.col("links") + F.col("members") - 1).alias("n_links"), "component_id")
    linked = good.join(answer, ["label", "vector"]).select("__id", "n_links", "component_id")
    alone = rows.where(~valid).select("__id", F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"))
