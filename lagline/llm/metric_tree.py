"""Exact top-k inner products by best-first search over an M-tree.

Every block of rows is a subtree of paged nodes: a node keeps a routing vector, the radius that
covers what lies below it, its distance to its parent's routing vector and the largest norm
below it; a leaf keeps each row's distance to the leaf's routing vector. With the distance d of
a query to a row, twice their inner product is |q|^2 + |x|^2 - d^2, so a lower bound of d bounds
the score from above. The triangle inequality over stored distances gives a first bound without
computing anything; only nodes and rows that pass it have their own distance or score computed.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lagline.llm import block_search
from lagline.llm.block_search import LEAST, MOST, products
from lagline.staging import staged

PAGE = 48  # rows of one leaf
FAN = 32  # children of one inner node, at most


def gaps(a_square: np.ndarray, b_square: np.ndarray, dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(a_square + b_square - 2 * dots, 0))


def ceiling(square: np.ndarray, longest: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """No score can be higher, given the least distance; rounding is allowed for."""
    size = square + longest
    safe = np.maximum(gap - 1e-7 * np.sqrt(size), 0)
    return (size - safe * safe) / 2 * (1 + 1e-12) + 1e-9 * size + 1


class Tree:
    """Nodes 0 (root), 1, ...; the children of a node, and the rows of a leaf, are neighbours."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.square = (vectors ** 2).sum(axis=1)
        self.route, self.radius, self.up, self.longest = [], [], [], []
        self.first, self.last, self.leaf = [], [], []
        rows, away = [], []
        todo = [(self._add(np.arange(len(ids)), None), np.arange(len(ids)))]
        at = 0
        while at < len(todo):
            node, members = todo[at]
            at += 1
            far = self._away(self.route[node], members)
            self.leaf[node] = len(members) <= PAGE
            if self.leaf[node]:
                self.first[node], self.last[node] = len(rows), len(rows) + len(members)
                rows.extend(members)
                away.extend(far)
                continue
            groups = self._split(members)
            self.first[node] = len(self.route)
            todo += [(self._add(g, node), g) for g in groups]
            self.last[node] = len(self.route)
        for name in ("route", "radius", "up", "longest", "first", "last", "leaf"):
            setattr(self, name, np.array(getattr(self, name)))
        order = np.array(rows, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.vectors, self.ids, self.square, self.away = vectors[order], ids[order], self.square[order], np.array(away)
        self.route = place[self.route]

    @classmethod
    def of(cls, facts: dict) -> Tree:
        """A tree from the arrays that it was stored as."""
        tree = cls.__new__(cls)
        vars(tree).update(facts)
        return tree

    def _away(self, row: int, members: np.ndarray) -> np.ndarray:
        return gaps(self.square[row], self.square[members], self.vectors[members] @ self.vectors[row])

    def _add(self, members: np.ndarray, parent: int | None) -> int:
        own = self.vectors[members]
        row = int(members[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()])
        self.route.append(row)
        self.radius.append(float(self._away(row, members).max()))
        self.up.append(0.0 if parent is None else float(self._away(self.route[parent], np.array([row]))[0]))
        self.longest.append(float(self.square[members].max()))
        for facts in (self.first, self.last, self.leaf):
            facts.append(0)
        return len(self.route) - 1

    def _split(self, members: np.ndarray) -> list[np.ndarray]:
        """Groups around evenly picked rows; equal rows are cut into runs."""
        seeds = members[np.linspace(0, len(members) - 1, min(FAN, 1 + len(members) // PAGE)).astype(np.int64)]
        nearest = np.stack([self._away(s, members) for s in seeds]).argmin(axis=0)
        groups = [members[nearest == k] for k in range(len(seeds))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:
            groups = np.array_split(members, min(FAN, -(-len(members) // PAGE)))
        return groups

    def best(self, queries: np.ndarray, squares: np.ndarray, lows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of shape (queries, most): the highest scores from each query's low on, ties by smaller id.

        Nodes are visited by the best bound of the queries that may still find something below
        them; each query has its own bounds and its own least score, which rises as it finds
        better ones. Places that stay empty have the score LEAST and the id MOST.
        """
        lows = lows.copy()
        ids, scores = np.full((len(queries), most), MOST), np.full((len(queries), most), LEAST)
        length, floor = np.sqrt(squares), lows.astype(float)
        start = gaps(squares, self.square[self.route[0]], queries @ self.vectors[self.route[0]])
        bound = ceiling(squares, self.longest[0], start - self.radius[0])
        heap = [(-float(bound.max()), 0, np.arange(len(queries)), bound, start)]
        while heap:
            _, node, who, bound, distance = heapq.heappop(heap)
            open_ = bound >= floor[who]
            who, distance = who[open_], distance[open_]
            if not len(who):
                continue
            below = np.arange(self.first[node], self.last[node])
            if self.leaf[node]:
                limit = ceiling(squares[who][:, None], self.square[below][None, :], np.abs(distance[:, None] - self.away[below][None, :]))
                near = limit >= floor[who][:, None]
                who, rows = who[near.any(axis=1)], below[near.any(axis=0)]
                if not len(who):
                    continue
                made = products(queries[who], float(length[who].max()), self.vectors[rows], float(np.sqrt(self.square[rows].max())))
                hit = (made >= lows[who][:, None]).any(axis=1)
                who, made = who[hit], made[hit]
                made = np.concatenate([scores[who], np.where(made >= lows[who][:, None], made, LEAST)], axis=1)
                name = np.concatenate([ids[who], np.broadcast_to(self.ids[rows], (len(who), len(rows)))], axis=1)
                name = np.where(made == LEAST, MOST, name)
                order = np.lexsort((name, ~made), axis=-1)[:, :most]  # ~s falls as s rises and cannot overflow
                scores[who], ids[who] = np.take_along_axis(made, order, axis=1), np.take_along_axis(name, order, axis=1)
                lows[who] = np.maximum(lows[who], scores[who, most - 1])
                floor[who] = lows[who]
                continue
            known = np.abs(distance[:, None] - self.up[below][None, :]) - self.radius[below][None, :]
            near = ceiling(squares[who][:, None], self.longest[below][None, :], known) >= floor[who][:, None]
            for kid, here in zip(below, near.T):
                asking = who[here]
                if not len(asking):
                    continue
                away = gaps(squares[asking], self.square[self.route[kid]], queries[asking] @ self.vectors[self.route[kid]])
                bound = ceiling(squares[asking], self.longest[kid], away - self.radius[kid])
                some = bound >= floor[asking]
                if some.any():
                    heapq.heappush(heap, (-float(bound.max()), int(kid), asking[some], bound[some], away[some]))
        return ids, scores


class MetricTree:
    """The blocks of `block_search` as M-trees: a head is the root entry of a block's tree."""

    def head(self, block: dict) -> dict:
        own = block["vector"]
        square = (own ** 2).sum(axis=1)
        row = int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin())
        far = gaps(square[row], square, own @ own[row])
        return {"route": own[row], "radius": far.max(), "longest": square.max()}

    def body(self, block: dict) -> dict:
        return vars(Tree(block["id"], block["vector"]))

    def highest(self, queries: dict, heads: dict) -> np.ndarray:
        low = np.array([x[0] for x in queries["lows"]])
        far = gaps(queries["square"][:, None], (heads["route"] ** 2).sum(axis=1)[None, :], queries["vector"] @ heads["route"].T)
        bound = ceiling(queries["square"][:, None], heads["longest"][None, :], far - heads["radius"][None, :])
        return np.where(bound >= low[:, None], bound, -np.inf).max(axis=0)

    def search(self, queries: dict, body: dict, most: int):
        ids, scores = Tree.of(body).best(queries["vector"], queries["square"], np.array([x[0] for x in queries["lows"]]), most)
        for k in np.flatnonzero((ids != MOST).any(axis=1) | (scores != LEAST).any(axis=1)):
            full = (ids[k] != MOST) | (scores[k] != LEAST)
            yield int(k), 0, ids[k][full], scores[k][full]


def top_products(embeddings: DataFrame, is_query, most: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id_col>, score): the `most` highest integer inner products of each query row.

    `is_query` is a condition on the column `id`. Components count as floor(256 * x), x as
    double; candidates are all rows but the query's own, so a repeated row finds its copies.
    Ties go to the smaller id, null ids last; a row without an id is a candidate only. Rows
    take no part if their vector is null or holds a null or non-finite component; zero vectors
    do. Rows with different numbers of components never meet. No rows give no rows. Other
    columns of the table play no part.
    """
    rows = block_search.integer_rows(embeddings, id_col, vector_col)
    asking = rows.where(is_query & (F.col("id") != MOST))
    classes = staged(
        asking.select("label", "dim", "vector").distinct().withColumn("id", F.monotonically_increasing_id()), "classes")
    some = staged(block_search.least_ids(rows, most + 1), "rows")
    band = [F.array(F.lit(x).cast("bigint")).alias(n) for x, n in ((LEAST, "lows"), (MOST, "highs"))]
    hits = block_search.search(some, classes.select("id", "label", "dim", "vector", *band), MetricTree(), block_search.pivots(some), most + 1)
    return answered(asking, classes, hits, most).select(
        F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"),
        F.nullif(F.col("hit.id"), F.lit(MOST)).alias(id_col), F.col("hit.score").alias("score"))


def answered(asking: DataFrame, classes: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """(id, class, rank, hit) of every asking row: its class's hits without the row itself."""
    lists = hits.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))  # most + 1 at most
    known = classes.select(F.col("id").alias("class"), "label", "dim", "vector").join(lists, "class")
    square = F.aggregate("vector", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    square = F.least(square, F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    itself = F.array_position(F.transform("hits", lambda h: (h["id"] == F.col("id")) & (h["score"] == F.col("square"))), True)
    others = F.filter("hits", lambda h, i: i + 1 != F.col("itself"))
    rows = asking.join(known, ["label", "dim", "vector"]).withColumn("square", square).withColumn("itself", itself)
    return rows.select("id", "class", F.posexplode(F.slice(others, 1, most)).alias("rank", "hit")).withColumn("rank", F.col("rank") + 1)
