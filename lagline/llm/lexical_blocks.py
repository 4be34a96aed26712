"""Ranked lexical search with per-term geometric blocking.

Documents become vectors of term contributions. They are searched in segments of a bounded
number of postings; inside a segment every posting list is clustered by the similarity of its
documents (random projections of their vectors, around documents picked from the list) and each
block keeps the coordinatewise maximum of its documents' vectors. The product of an item with
that summary bounds every score in the block, so a block is skipped only if the bound stays
below the item's current k-th score. Lists are visited by falling weight, and a document that
holds an earlier term of the item has been dealt with there: bounds need only later terms, and
once the largest contributions of all later terms cannot reach the k-th score, the item is done.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lagline.llm import kit
from lagline.llm.block_search import MOST
from lagline.staging import staged

ITEM_BYTES = 1 << 20  # item texts that one pass over the documents answers; their terms are broadcast
SEGMENT_POSTINGS = 1 << 18
BLOCK_DOCS = 32  # documents of one block, on average
SKETCH = 16  # random projections that stand for a document's vector when lists are clustered
CELL_VALUES = 1 << 22  # vector components that are unpacked at once
SEED_SHARE = 32  # one document in so many gives the first k-th scores, a lower bound of the final ones

WORD = np.ones(256, bool)
for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    WORD[first:last + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the terms, and the first term of each row."""
    data, offsets = kit.byte_buffer(column)
    data = LOWER[data]
    return data, *kit.word_spans(data, offsets, WORD)


class Vocabulary:
    """Terms by 64-bit hash; a hit is compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        end = np.cumsum([len(t) for t in terms]).astype(np.int64)
        start = end - np.array([len(t) for t in terms], np.int64)
        name = kit.SpanHash(data).of(start, end)
        self.order = np.argsort(name, kind="stable")
        self.name, self.data, self.start, self.size = name[self.order], data, start, end - start
        self.most = int(np.unique(name, return_counts=True)[1].max()) if len(terms) else 0

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        found = np.full(len(start), -1, np.int64)
        if not len(start) or not self.most:
            return found
        names = kit.SpanHash(data).of(start, end)
        first = np.searchsorted(self.name, names)
        for k in range(self.most):
            at = np.minimum(first + k, len(self.name) - 1)
            term = self.order[at]
            pick = np.flatnonzero((self.name[at] == names) & (self.size[term] == end - start) & (found < 0))
            size = end[pick] - start[pick]
            if not len(pick):
                continue
            same = data[kit.ragged(start[pick], size)] == self.data[kit.ragged(self.start[term[pick]], size)]
            equal = np.logical_and.reduceat(same, np.cumsum(size) - size)
            found[pick[equal]] = term[pick[equal]]
        return found


def counted_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term: all terms, and which of the vocabulary how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for chunk in kit.chunked(batches, "text"):
            data, start, end, first = spans(chunk.column(1))
            term = sent.value.find(data, start, end)
            row = np.repeat(np.arange(len(chunk)), np.diff(first))
            key, count = np.unique(row[term >= 0] << 32 | term[term >= 0], return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(chunk) + 1) << 32)
            n = np.diff(first)
            made = pa.RecordBatch.from_arrays([
                chunk.column(0), pa.array(n.astype(np.int64)), kit.list_column((key & 0xFFFFFFFF).astype(np.int32), offsets, pa.int32()),
                kit.list_column(count.astype(np.int32), offsets, pa.int32()),
            ], ["doc", "n", "terms", "counts"])
            yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc bigint, n bigint, terms array<int>, counts array<int>")


class Items:
    """Items as vectors over ranked terms: entry arrays by item, and the entries of each term."""

    def __init__(self, items: list[dict[int, int]], weights: np.ndarray):
        order = np.lexsort((np.arange(len(weights)), -weights))
        self.rank = np.empty(len(weights), np.int64)
        self.rank[order] = np.arange(len(weights))
        self.weight = weights[order]
        self.terms = len(weights)
        entries = sorted((i, int(self.rank[t]), c) for i, own in enumerate(items) for t, c in own.items() if weights[t] > 0)
        self.item, self.term, self.count = (np.array([e[k] for e in entries], np.int64) for k in range(3))
        self.start = np.searchsorted(self.item, np.arange(len(items) + 1))
        self.by_term = np.argsort(self.term, kind="stable")
        self.of_term = np.searchsorted(self.term[self.by_term], np.arange(len(weights) + 1))


class Search:
    """The best documents of each item over the segments that one task reads."""

    def __init__(self, items: Items, floors: np.ndarray, most: int):
        self.items, self.most = items, most
        self.floors = floors.copy()
        self.docs = [np.zeros(0, np.int64)] * len(floors)
        self.scores = [np.zeros(0, np.int64)] * len(floors)
        self.turn = np.random.default_rng(13).standard_normal((items.terms, SKETCH)).astype(np.float32)

    def segment(self, docs: np.ndarray, term: np.ndarray, value: np.ndarray, owner: np.ndarray) -> None:
        """Postings sorted by document and, inside it, by rank; `owner` is the document's place in `docs`."""
        q = self.items
        ends = np.searchsorted(owner, np.arange(1, len(docs) + 1))
        postings = np.argsort(term, kind="stable")
        lists = np.searchsorted(term[postings], np.arange(q.terms + 1))
        top = np.zeros(q.terms)
        filled = np.flatnonzero(np.diff(lists))
        top[filled] = np.maximum.reduceat(value[postings], lists[filled])
        # What an item's terms from an entry on can give at most, in this segment.
        part = np.concatenate([[0], np.cumsum(top[q.term] * q.count)])
        rest = part[q.start[q.item + 1]] - part[:-1]
        sketch = np.zeros((len(docs), SKETCH), np.float32)
        begins = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > begins)
        if not len(some):
            return
        sketch[some] = np.add.reduceat(value[:, None].astype(np.float32) * self.turn[term], begins[some], axis=0)
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        seen = np.zeros((len(self.floors), len(docs)), bool)
        column = np.full(q.terms, -1, np.int64)
        for t in filled:
            entry = q.by_term[q.of_term[t]:q.of_term[t + 1]]
            entry = entry[rest[entry] >= self.floors[q.item[entry]]]
            if not len(entry):
                continue
            asking = q.item[entry]
            sizes = q.start[asking + 1] - entry
            later = kit.ragged(entry, sizes)
            used = np.unique(q.term[later])
            column[used] = np.arange(len(used))
            wanted = np.zeros((len(asking), len(used)))
            wanted[np.repeat(np.arange(len(asking)), sizes), column[q.term[later]]] = q.count[later]
            own = postings[lists[t]:lists[t + 1]]
            own, edges = self._blocks(own, sketch[owner[own]])
            self._list(asking, wanted, column, own, edges, term, value, owner, ends, docs, seen)
            column[used] = -1

    def _blocks(self, own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A posting list in blocks of similar documents, and where the blocks begin."""
        n = -(-len(own) // BLOCK_DOCS)
        if n == 1:
            return own, np.array([0, len(own)])
        centre = sketch[np.linspace(0, len(own) - 1, n).astype(np.int64)]
        near = (sketch @ centre.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        return own[order], np.append(np.flatnonzero(np.diff(near[order], prepend=-1)), len(own))

    def _list(self, asking, wanted, column, own, edges, term, value, owner, ends, docs, seen) -> None:
        width, at = wanted.shape[1], 0
        while at < len(edges) - 1:  # some blocks at a time, so that the unpacked vectors stay bounded
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + CELL_VALUES // width, "right")) - 1)
            members, cut = own[edges[at]:edges[upto]], edges[at:upto + 1] - edges[at]
            sizes = ends[owner[members]] - members
            entries = kit.ragged(members, sizes)
            row, col = np.repeat(np.arange(len(members)), sizes), column[term[entries]]
            vectors = np.zeros((len(members), width))
            vectors[row[col >= 0], col[col >= 0]] = value[entries[col >= 0]]
            summary = np.maximum.reduceat(vectors, cut[:-1], axis=0)
            reach = wanted @ summary.T >= self.floors[asking][:, None]
            found = []
            for block in np.flatnonzero(reach.any(axis=0)):
                who, here = np.flatnonzero(reach[:, block]), slice(cut[block], cut[block + 1])
                scores = wanted[who] @ vectors[here].T
                place = owner[members[here]]
                fresh = ~seen[asking[who][:, None], place[None, :]]
                seen[asking[who][:, None], place[None, :]] = True
                i, d = np.nonzero(fresh & (scores >= self.floors[asking[who]][:, None]))
                found.append((asking[who[i]], docs[place[d]], scores[i, d].astype(np.int64)))
            if found:
                self._merge(*(np.concatenate(c) for c in zip(*found)))
            at = upto

    def _merge(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(item, kind="stable")
        item, doc, score = item[order], doc[order], score[order]
        edges = [*np.flatnonzero(np.diff(item, prepend=-1)), len(item)]
        for start, end in zip(edges, edges[1:]):
            i = int(item[start])
            docs, scores = np.concatenate([self.docs[i], doc[start:end]]), np.concatenate([self.scores[i], score[start:end]])
            best = np.lexsort((docs, -scores))[:self.most]
            self.docs[i], self.scores[i] = docs[best], scores[best]
            if len(best) == self.most:
                self.floors[i] = max(self.floors[i], int(scores[best[-1]]))


def searched(vectors: DataFrame, items: Items, floors: np.ndarray, most: int) -> DataFrame:
    """(item, doc, score): the best documents per item of each task, all that reach the item's floor."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches):
        items, floors = sent.value
        search, held, postings = Search(items, floors, most), [], 0

        def close():
            docs, scale, terms, counts, sizes = (np.concatenate(c) for c in zip(*held))
            owner, term = np.repeat(np.arange(len(docs)), sizes), items.rank[terms]
            order = np.lexsort((term, owner))
            term, count, m = term[order], counts[order].astype(np.int64), np.repeat(scale, sizes)
            value = items.weight[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m))
            search.segment(docs, term, value, owner)

        for batch in batches:
            column = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            size = column["terms"].value_lengths().to_numpy().astype(np.int64)
            held.append((column["doc"].to_numpy(), column["m"].to_numpy(), column["terms"].flatten().to_numpy(), column["counts"].flatten().to_numpy(), size))
            postings += int(size.sum())
            if postings >= SEGMENT_POSTINGS:
                close()
                held, postings = [], 0
        if postings:
            close()
        for i, (docs, scores) in enumerate(zip(search.docs, search.scores)):
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i, np.int32)), pa.array(docs), pa.array(scores)], ["item", "doc", "score"])

    found = vectors.select("doc", "m", "terms", "counts").where(F.size("terms") > 0).mapInArrow(run, "item int, doc bigint, score bigint")
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def answered(texts: list[tuple], docs: DataFrame, most: int) -> DataFrame:
    """(item, doc, score, rank) for the texts of one pass."""
    data, start, end, first = spans(pa.array([t for _, t in texts], pa.large_string()))
    words = [data[s:e].tobytes() for s, e in zip(start, end)]
    number: dict[bytes, int] = {}
    items = [dict(Counter(number.setdefault(w, len(number)) for w in words[a:b])) for a, b in zip(first, first[1:])]
    counted = staged(counted_terms(docs, Vocabulary(list(number))), "counted")
    total, terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    weights = np.zeros(len(number), np.int64)
    for term, n in holders.collect():  # one row per term of the items of this pass
        weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1)))
    length = F.expr(f"75 + (25 * cast(n AS decimal(20, 0)) * cast({total} AS decimal(19, 0))) div cast({max(1, terms)} AS decimal(19, 0))")
    vectors = counted.withColumn("m", length.cast("bigint"))
    ranked, floors = Items(items, weights), np.ones(len(items), np.int64)
    early = searched(vectors.where(F.pmod(F.xxhash64("doc", "n"), F.lit(SEED_SHARE)) == 0), ranked, floors, most)
    for item, score in early.where(F.col("rank") == most).select("item", "score").collect():  # one row per item of this pass
        floors[item] = score
    return staged(searched(vectors, ranked, floors, most), "ranked")


def rank(items: DataFrame, docs: DataFrame, most: int = 20, item_col: str = "item_id", item_text: str = "text",
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<item_col>, rank, <id_col>, score): each item's `most` best documents with a score above 0.

    A row of either table is an item or document of its own; null texts have no terms. Equal
    scores rank by ascending id, null ids last. Items without a scoring document give no row.
    Item texts pass through the driver ITEM_BYTES at a time (one item at least), each time with
    one pass over the documents; all document work is distributed.
    """
    spark = items.sparkSession
    asked = staged(items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
                   .where(F.length("text") > 0).withColumn("key", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // ITEM_BYTES))
    own = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(MOST)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    answer = None
    for number in range(passes):
        part = asked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == number)
        texts = [tuple(r) for r in part.select("key", "text").orderBy("key").collect()]
        if not texts:
            continue
        keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(texts)], "place int, key bigint")
        found = answered(texts, own, most)
        found = found.join(F.broadcast(keys), found["item"] == keys["place"]).select("key", "rank", "doc", "score")
        answer = found if answer is None else answer.unionByName(found)
    if answer is None:
        answer = spark.createDataFrame([], "key bigint, rank int, doc bigint, score bigint")
    return answer.join(asked.select("key", "item"), "key").select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.nullif(F.col("doc"), F.lit(MOST)).alias(id_col), "score")
