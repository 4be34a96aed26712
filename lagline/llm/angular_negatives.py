"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions. For an anchor and a row,
each direction says that their angle lies between the difference and the sum of the two stored
angles; the tightest interval of all directions gives an interval of the cosine, and the norms
turn it into an interval of the score, widened for rounding. Inside a block rows stand by their
angle to one direction, so the rows that can reach a score are one window of it; of these only
rows whose score interval meets a wanted range of scores get the integer product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lagline.llm import block_search
from lagline.llm.block_search import LEAST, MOST, fitted, products
from lagline.llm.metric_tree import answered
from lagline.staging import staged

TURN = 1e-6  # allowance on a sum or difference of stored angles; arccos near one is good to 5e-8


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors ** 2).sum(axis=1))


def angles(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction of length one; that of a zero row is 0 and unused."""
    length = norms(vectors)
    cosine = (vectors @ directions.T) / np.where(length > 0, length, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1))


def upper(size, angle):
    """No score can be higher where the angle is at least `angle`; size is the product of the norms."""
    return size * np.cos(np.clip(angle - TURN, 0, np.pi)) + 1e-9 * size + 1


def lower(size, angle):
    """No score can be lower where the angle is at most `angle`."""
    return size * np.cos(np.clip(angle + TURN, 0, np.pi)) - 1e-9 * size - 1


class AngleIndex:
    """Blocks of `block_search` with stored angles; labels of a hit equal the anchor's, or differ."""

    def __init__(self, pivots: np.ndarray, same_label: bool):
        self.pivots, self.same = pivots, same_label

    def directions(self, dim: int) -> np.ndarray:
        own = fitted(self.pivots, dim)
        length = norms(own)
        if dim:
            own[length == 0, 0] = 1
        return own / np.where(length > 0, length, 1)[:, None]

    def head(self, block: dict) -> dict:
        own = block["vector"]
        length, turn = norms(own), angles(own, self.directions(own.shape[1]))
        return {"least": turn.min(axis=0), "most": turn.max(axis=0), "short": length.min(), "long": length.max(),
                "label": np.array([block["label"].min(), block["label"].max()])}

    def body(self, block: dict) -> dict:
        """Rows by their angle to the direction that is nearest to most of them."""
        own = block["vector"]
        turn = angles(own, self.directions(own.shape[1]))
        main = int(np.bincount(turn.argmin(axis=1)).argmax())
        order = np.argsort(turn[:, main], kind="stable")
        return {"id": block["id"][order], "label": block["label"][order], "vector": own[order], "length": norms(own)[order],
                "turn": turn[order], "main": main}

    def highest(self, queries: dict, heads: dict) -> np.ndarray:
        length, turn = np.sqrt(queries["square"]), angles(queries["vector"], self.directions(queries["vector"].shape[1]))
        best = np.full(len(heads["block"]), -np.inf)
        for k in range(len(length)):
            closest = np.maximum(heads["least"] - turn[k], turn[k] - heads["most"]).max(axis=1)
            widest = np.minimum(heads["most"] + turn[k], 2 * np.pi - heads["least"] - turn[k]).min(axis=1)
            # Norms differ inside a block: a positive bound takes the longest, a negative one the shortest.
            top = np.maximum(upper(length[k] * heads["long"], closest), upper(length[k] * heads["short"], closest))
            bottom = np.minimum(lower(length[k] * heads["long"], widest), lower(length[k] * heads["short"], widest))
            least, most = heads["label"][:, 0], heads["label"][:, 1]
            own = queries["label"][k]
            meets = (least <= own) & (own <= most) if self.same else (least != own) | (most != own)
            for low, high in zip(queries["lows"][k], queries["highs"][k]):
                hit = meets & (low <= high) & (top >= low) & (bottom <= high)
                best = np.maximum(best, np.where(hit, np.minimum(top, high), -np.inf))
        return best

    def search(self, queries: dict, body: dict, most: int):
        turns = angles(queries["vector"], self.directions(queries["vector"].shape[1]))
        main, longest = body["turn"][:, body["main"]], float(body["length"].max())
        for k, query in enumerate(queries["vector"]):
            bands = [(j, low, high) for j, (low, high) in enumerate(zip(queries["lows"][k], queries["highs"][k])) if low <= high]
            if not bands:
                continue
            length, low, high = float(np.sqrt(queries["square"][k])), min(b[1] for b in bands), max(b[2] for b in bands)
            size = length * longest
            # A score of `low` needs an angle no wider than this, so the main angle lies within it of the anchor's.
            need = (low - 1) * (1 - 1e-9) if low > 1 else -1.0
            width = np.pi if need <= 0 or not size else float(np.arccos(min(1.0, need / (size * (1 + 1e-9))))) + 2 * TURN
            at = turns[k, body["main"]]
            rows = np.arange(np.searchsorted(main, at - width, "left"), np.searchsorted(main, at + width, "right"))
            rows = rows[(body["label"][rows] == queries["label"][k]) == self.same]
            closest = np.abs(body["turn"][rows] - turns[k]).max(axis=1)
            together = body["turn"][rows] + turns[k]
            widest = np.minimum(together, 2 * np.pi - together).min(axis=1)
            sizes = length * body["length"][rows]
            top, bottom = upper(sizes, closest), lower(sizes, widest)
            meets = np.zeros(len(rows), bool)
            for _, least, last in bands:
                meets |= (top >= least) & (bottom <= last)
            rows = rows[meets]
            if not len(rows):
                continue
            scores = products(query[None, :], length, body["vector"][rows], longest)[0]
            for band, least, last in bands:
                hit = np.flatnonzero((scores >= least) & (scores <= last))
                hit = hit[np.lexsort((body["id"][rows[hit]], ~scores[hit]))[:most]]
                if len(hit):
                    yield k, band, body["id"][rows[hit]], scores[hit]


def hard_negatives(embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3,
                   id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of components floor(256 * x). An anchor's positives are its first
    `positives` other rows of the same label; for each, the first `negatives` rows of another
    label whose score lies between half and 0.95 of the positive's, ends included. Higher scores
    come first, ties by smaller id, null ids last. `is_anchor` is a condition on the column `id`,
    `label` a whole number over the table's columns. Rows take no part with a null label, a null
    vector or a null or non-finite component; a row without an id is never an anchor. A repeated
    row is another row: it is its copy's positive. A positive without any negative gives no row,
    nor does one of a negative score. Rows of different numbers of components never meet.
    """
    rows = block_search.integer_rows(embeddings, id_col, vector_col, label)
    asking = rows.where(is_anchor & (F.col("id") != MOST))
    classes = staged(asking.select("label", "dim", "vector").distinct().withColumn("id", F.monotonically_increasing_id()), "classes")
    some = staged(block_search.least_ids(rows, max(positives + 1, negatives)), "rows")
    pivots = block_search.pivots(some)
    whole = [F.array(F.lit(x).cast("bigint")).alias(n) for x, n in ((LEAST, "lows"), (MOST, "highs"))]
    close = block_search.search(
        some, classes.select("id", "label", "dim", "vector", *whole), AngleIndex(pivots, True), pivots, positives + 1, ["label", "region", "near"])
    # One band per score that a positive of the class can have: at most positives + 1.
    scores = close.where("score >= 0").groupBy("class").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    lows = F.transform("scores", lambda s: s - F.shiftright(s, 1))
    part = lambda s: s.cast("decimal(19,0)") / 20
    highs = F.transform("scores", lambda s: s - F.ceil(part(s)).cast("bigint"))
    bands = staged(classes.join(scores, classes["id"] == scores["class"]).select("id", "label", "dim", "vector", "scores", lows.alias("lows"), highs.alias("highs")), "bands")
    other = block_search.search(some, bands.drop("scores"), AngleIndex(pivots, False), pivots, negatives)
    told = other.join(bands.select(F.col("id").alias("class"), "scores"), "class").select(
        "class", F.col("scores")[F.col("band")].alias("positive_score"), F.struct("rank", "id", "score").alias("found"))
    lists = told.groupBy("class", "positive_score").agg(F.sort_array(F.collect_list("found")).alias("found"))  # `negatives` at most
    pairs = answered(asking, classes, close, positives).select("id", "class", F.col("hit.id").alias("positive"), F.col("hit.score").alias("positive_score"))
    known = lambda name: F.nullif(F.col(name), F.lit(MOST))
    return pairs.join(lists, ["class", "positive_score"]).select("*", F.explode("found").alias("n")).select(
        F.col("id").alias("anchor_id"), known("positive").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"),
        known("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
