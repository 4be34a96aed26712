"""Near duplicates on word shingles by a parity-sketch join.

A set of shingle hashes is cut into chunks of the hash range. XOR over a chunk's hashes is
the chunk's sketch: a shingle that two sets do not share changes one chunk, so sets whose
symmetric difference is D differ in at most D chunks. A Jaccard similarity of j bounds D by
(1 - j) / (1 + j) of the summed sizes, hence two sets that emit their first bound + 1
non-empty chunks emit a common one (pigeonhole). Chunk counts are fixed per band of sizes.
Candidates must then pass the Hamming distance of one parity bit sketch per set, which
never exceeds the symmetric difference, and are verified on the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm.components import components
from lagline.llm.kit import U64, SpanHash, byte_buffer, chunked, draws, mix, ragged, word_spans
from lagline.staging import release, staged, tidy, written

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100  # similarity as a ratio of whole numbers
LEAST_BITS = 512  # of the shortest sketch for the Hamming test
MERGE_ROUNDS = 2  # of closest pairs between components, before all pairs that are left
BROADCAST_ROWS = 200_000  # names of texts, 60 bytes each
BLOCK = 512  # sets of one group that are compared in one task, per side

# Lower case for A-Z; the white space that ends a word.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
INSIDE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
WEIGHTS = draws(23, SHINGLE)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one after another, and n + 1 offsets."""
    raw, offsets = byte_buffer(column)
    data = LOWER[raw]
    start, end, first = word_spans(data, offsets, INSIDE)
    rows = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = SpanHash(data).of(start, end)
    words = np.diff(first)
    counts = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    at = ragged(first[:-1], counts)
    row = np.repeat(np.arange(rows), counts)
    width = np.minimum(words, size)[row]
    value = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            part = mix(word[np.minimum(at + k, len(word) - 1)] ^ WEIGHTS[k])
            value = np.where(k < width, (value + part) * U64(0x9E3779B97F4A7C15), value)
        value = mix(value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def set_classes(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set, equal for equal sets; 0 for the empty set."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), offsets[:-1][some])
            out[some] = mix(total + n[some].astype(np.uint64)) | U64(1)
    return out.astype(np.int64)


def bound(n: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """The most by which a set of n can differ from a set that it links to: (d - s)(n + n d / s) / (d + s)."""
    return n * (denominator - numerator) // numerator


def bands(n: np.ndarray, numerator: int, denominator: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(set, band) pairs: band k holds sizes from 2^k below 2^(k+1), and partners above that."""
    home = np.frexp(n.astype(np.float64))[1] - 1
    own = np.flatnonzero(n > 0)
    below = np.flatnonzero((n > 0) & (home > 0) & (n * numerator < (1 << np.maximum(home, 0)) * denominator))
    return [(own, home[own]), (below, home[below] - 1)]


def chunk_keys(value: np.ndarray, offsets: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that two linked sets have in common at least once, and the set of each."""
    n = np.diff(offsets)
    keys, owners = [], []
    needed = bound(n, numerator, denominator) + 1
    lacking = np.zeros(len(n), bool)
    for sets, band in bands(n, numerator, denominator):
        if not len(sets):
            continue
        # A quarter more chunks than the largest set of the band has to emit.
        largest = (2 << band) * denominator // numerator
        chunks = (bound(largest, numerator, denominator) + 1) * 5 // 4 + 1
        at = ragged(offsets[:-1][sets], n[sets])
        which = np.repeat(np.arange(len(sets)), n[sets])
        chunk = ((value[at] >> U64(32)) * chunks[which].astype(np.uint64)) >> U64(32)
        new = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (which[1:] != which[:-1])])
        head = np.flatnonzero(new)
        of = which[head]
        rank = np.arange(len(head)) - np.searchsorted(of, of)
        full = np.bincount(of, minlength=len(sets))
        lacking[sets[full < needed[sets]]] = True
        with np.errstate(over="ignore"):
            sketch = np.bitwise_xor.reduceat(mix(value[at]), head)
            key = mix(sketch + mix(chunk[head] * U64(64) + band[of].astype(np.uint64)))
        take = rank < needed[sets][of]
        keys.append(key[take])
        owners.append(sets[of[take]])
    short = np.flatnonzero(lacking)
    if len(short):
        # Sets with too few non-empty chunks also meet each other on their smallest shingles (prefix filter).
        prefix = n[short] - (n[short] * numerator + denominator - 1) // denominator + 1
        keys.append(mix(value[ragged(offsets[:-1][short], prefix)] ^ U64(0xA0761D6478BD642F)))
        owners.append(np.repeat(short, prefix))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def keys_of_texts(chunk: pa.RecordBatch, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a chunk's texts and the class of each; the work arrays are those of a megabyte of text at a time."""
    keys, names = [], []
    for piece in chunked([chunk], "text"):
        value, offsets = shingle_sets(piece.column(piece.schema.get_field_index("text")))
        key, owner = chunk_keys(value, offsets, numerator, denominator)
        keys.append(key)
        names.append(set_classes(value, offsets)[owner])
    return np.concatenate(keys), np.concatenate(names)


def bit_sketches(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A parity bit sketch per set: every shingle flips one bit of a power of two, at least two bits a shingle."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        bits = max(LEAST_BITS, 1 << (2 * (b - a) - 1).bit_length())
        flips = np.bincount((value[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
    return out


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the same set has with fewer bits: XOR of its parts."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


ROWS = "key string, n bigint, class bigint, sketch binary"


def _sets(keyed: DataFrame) -> DataFrame:
    """Size, class and sketch of every (key, text)."""

    def run(batches):
        for chunk in chunked(batches, "text"):
            value, offsets = shingle_sets(chunk.column(1))
            sketch = bit_sketches(value, offsets)
            yield pa.RecordBatch.from_arrays([
                chunk.column(0), pa.array(np.diff(offsets)), pa.array(set_classes(value, offsets)), pa.array(sketch, pa.binary()),
            ], ["key", "n", "class", "sketch"])

    return keyed.mapInArrow(run, ROWS)


def _meetings(keyed: DataFrame, numerator: int, denominator: int, parts: int) -> DataFrame:
    """(bucket, keys, classes): keys with two classes or more, as packed arrays.

    Tasks sort their keys into buckets before the shuffle and send arrays, each key and class
    once. A bucket that holds a very common key still gets one entry per class.
    """
    buckets = 4 * parts

    def emit(batches):
        for chunk in chunked(batches, "text", 8 << 20):
            key, name = keys_of_texts(chunk, numerator, denominator)
            bucket = (key % U64(buckets)).astype(np.int64)
            small = (key >> U64(32)).astype(np.uint32)
            order = np.lexsort((name, small, bucket))
            bucket, small, name = bucket[order], small[order], name[order]
            new = np.ones(len(order), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (small[1:] != small[:-1]) | (name[1:] != name[:-1])
            bucket, small, name = bucket[new], small[new], name[new]
            there = np.flatnonzero(np.bincount(bucket, minlength=buckets)) if len(bucket) else np.zeros(0, np.int64)
            ends = np.searchsorted(bucket, there, "right")
            starts = np.searchsorted(bucket, there)
            yield pa.RecordBatch.from_arrays([
                pa.array(there.astype(np.int32)), pa.array([small[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([name[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            ], ["bucket", "keys", "classes"])

    def meet(batches):
        at, keys, names = None, [], []
        for batch in batches:
            for bucket, key, name in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    yield from _shared(at, keys, names)
                    at, keys, names = bucket, [], []
                keys.append(np.frombuffer(key, np.uint32))
                names.append(np.frombuffer(name, np.int64))
        yield from _shared(at, keys, names)

    schema = "bucket int, keys binary, classes binary"
    return (
        keyed.select("text").mapInArrow(emit, schema).repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(meet, schema)
    )


def _shared(bucket, keys: list, names: list):
    if not keys:
        return
    key, name = np.concatenate(keys), np.concatenate(names)
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
    key, name = key[new], name[new]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    many = count[where] > 1
    if many.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([key[many].tobytes()], pa.binary()), pa.array([name[many].tobytes()], pa.binary())],
            ["bucket", "keys", "classes"])


def _stars(meetings: DataFrame) -> DataFrame:
    """(member, leader, n): each class with the least class of every group it is in."""

    def run(batches):
        for batch in batches:
            for keys, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key, name = np.frombuffer(keys, np.uint32), np.frombuffer(names, np.int64)
                head = np.concatenate([[True], key[1:] != key[:-1]])
                leader = name[np.flatnonzero(head)][np.cumsum(head) - 1]
                pair = np.stack([name, leader], axis=1)[name != leader]
                pair, count = np.unique(pair, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(count)], ["member", "leader", "n"])

    found = meetings.mapInArrow(run, "member bigint, leader bigint, n bigint")
    return found.groupBy("member", "leader").agg(F.sum("n").alias("n"))


def _close(classes: DataFrame, pairs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) that sizes and Hamming distance leave possible."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b, na, sa, nb, sb = (batch.column(i) for i in range(6))
            far = np.zeros(len(batch), np.int64)
            for k, pair in enumerate(zip(sa.to_pylist(), sb.to_pylist())):
                x, y = (np.frombuffer(s, np.uint64) for s in pair)
                words = min(len(x), len(y))
                far[k] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()
            ok = _possible(far, na.to_numpy(), nb.to_numpy(), numerator, denominator)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])

    return (
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
        .mapInArrow(run, "a bigint, b bigint")
    )


def _possible(far, na, nb, numerator: int, denominator: int):
    return (far * (denominator + numerator) <= (na + nb) * (denominator - numerator)) & (
        np.minimum(na, nb) * denominator >= np.maximum(na, nb) * numerator)


def _verified(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose sets are similar enough, decided on the sets.

    Texts travel, as they compress and shingle hashes don't; sets are made where pairs meet.
    """
    pairs = staged(pairs.distinct(), "pairs")
    names = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = staged(names.join(classes, "class").select("key", "class"), "wanted")
    # Few enough (the count bounds their size), they go to the texts; otherwise the texts come to them.
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = staged(keyed.join(near, "key").select("class", "text").dropDuplicates(["class"]), "texts")

    def judge(batches):
        for chunk in chunked(batches, "t_b"):
            (left, at), (right, bt) = (shingle_sets(chunk.column(k)) for k in (2, 3))
            ok = []
            for i in range(len(chunk)):
                x, y = left[at[i]:at[i + 1]], right[bt[i]:bt[i + 1]]
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(denominator * common >= numerator * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([chunk.column(0).filter(ok), chunk.column(1).filter(ok)], ["a", "b"])

    left, right = (texts.select(F.col("class").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "t_a", "t_b").mapInArrow(judge, "a bigint, b bigint")


def _across(stars: DataFrame, roots: DataFrame, classes: DataFrame, numerator: int, denominator: int, nearest: bool) -> DataFrame:
    """Possible pairs between different components that some group holds together.

    With `nearest`, only the closest one of each member of a block; it says which components
    probably meet, at a cost that does not follow the square of a group.

    Every group is part of its leader's star. A star whose members all share its leader's
    component is settled; in the others, members are compared in blocks, and only pairs of
    different components that pass sizes and Hamming distance leave the task.
    """
    root = roots.select(F.col("node").alias("member"), "root")
    ring = stars.select("member", "leader").unionByName(stars.select(F.col("leader").alias("member"), "leader").distinct())
    placed = ring.join(root, "member", "left").withColumn("root", F.coalesce("root", "member"))
    mixed = (
        placed.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r1"), F.max("root").alias("r2"))
        .where("r1 <> r2").select("leader", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    held = placed.join(mixed, "leader").join(classes.select(F.col("class").alias("member"), "n", "sketch"), "member")
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = held.withColumn("block", block).select("*", other).select(
        "leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "member", "root", "n", "sketch")

    def compare(batches):
        group, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != group:
                    yield from _compared(group, rows, numerator, denominator, nearest)
                    group, rows = row[:3], []
                rows.append(row[3:])
        yield from _compared(group, rows, numerator, denominator, nearest)

    return (
        dealt.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def _compared(group, rows: list, numerator: int, denominator: int, nearest: bool):
    """Possible pairs of two blocks; sketches of different length meet at the shorter one."""
    if not rows:
        return
    _, i, j = group
    block, member, root, n = (np.array([r[k] for r in rows]) for k in range(4))
    sketches = [np.frombuffer(r[4], np.uint64) for r in rows]
    words = np.array([len(x) for x in sketches])
    for length in np.unique(words):
        # Linked sizes differ by a quarter at most, and so lengths by one step at most.
        own, double = np.flatnonzero(words == length), np.flatnonzero(words == 2 * length)
        both = np.concatenate([own, double])
        table = np.stack([fold(sketches[x], length) for x in both])
        for k, x in enumerate(own):
            later = np.arange(k + 1, len(both))
            y = both[later]
            fit = root[y] != root[x]
            if i != j:
                fit &= block[y] != block[x]
            later, y = later[fit], y[fit]
            if not len(y):
                continue
            far = np.bitwise_count(table[later] ^ table[k]).sum(axis=1).astype(np.int64)
            possible = _possible(far, n[x], n[y], numerator, denominator)
            y, far = y[possible], far[possible]
            if nearest and len(y):
                y = y[[int(np.argmin(far))]]
            if len(y):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(member[x], member[y])), pa.array(np.maximum(member[x], member[y]))], ["a", "b"])


def text_components(documents: DataFrame, text_col: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(key, n, root) for every distinct text: its md5, its number of shingles, and a name of its component.

    Links need denominator * intersection >= numerator * union. Equal sets are one class, so
    copies share a component without being paired. Sets are told apart by 64-bit names,
    shingles by 64-bit hashes. root is meaningless where n is 0.
    """
    if 2 * numerator < denominator:
        raise ValueError("similarities below one half need more bands")
    spark, mark = documents.sparkSession, len(written())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = documents.select(F.md5(body).alias("key"), body.alias("text"))
    rows = staged(_sets(keyed).dropDuplicates(["key"]), "sets")
    classes = staged(
        rows.where("n > 0").groupBy("class").agg(F.min_by(F.struct("key", "n", "sketch"), "key").alias("r")).select("class", "r.*"), "classes")
    meetings = staged(_meetings(keyed, numerator, denominator, parts), "meetings")
    since = len(written()) - 1
    stars = staged(_stars(meetings), "stars")
    release(spark, written(since)[:-1])
    since = len(written())
    first = stars.groupBy("member").agg(F.max_by("leader", F.struct("n", F.negative("leader"))).alias("leader"))
    first = first.select(F.col("leader").alias("a"), F.col("member").alias("b"))
    links = staged(_verified(keyed, classes, _close(classes, first, numerator, denominator), numerator, denominator), "links")
    release(spark, written(since)[:-1])
    # Components that are close merge first, by few pairs; then every pair left between two is looked at.
    for nearest in (*[True] * MERGE_ROUNDS, False):
        rest = _across(stars, components(links), classes, numerator, denominator, nearest)
        more = _verified(keyed, classes, rest, numerator, denominator)
        links = staged(links.unionByName(more).distinct(), "links")
        del rest, more
        release(spark, written(since)[:-1])
        tidy(spark)
    roots = components(links).withColumnRenamed("node", "class")
    named = staged(rows.join(roots, "class", "left").select("key", "n", F.coalesce("root", "class").alias("root")), "components")
    release(spark, written(mark)[:-1])
    return named


def _key(text_col: str):
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    Texts without words, null ones too, have no shingles and link with nothing: their
    component is their own id. Repeated rows share a component. component_id is the least
    id reachable, null only if all those ids are.
    """
    ids = documents.select(F.col(id_col).alias("__id"), _key(text_col).alias("key"))
    placed = ids.join(text_components(documents, text_col, numerator, denominator), "key")
    least = placed.where("n > 0").groupBy("root").agg(F.min("__id").alias("component_id"))
    return placed.join(least, "root", "left").select(
        F.col("__id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id")).alias("component_id"),
    )


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """The rows of `documents`, one for each component: that of the least id, then of the least md5 of the text.

    Ids that are null come last. Rows of equal id and text count as one row. Rows without
    shingles all stay. All columns pass through.
    """
    named = text_components(documents, text_col, numerator, denominator)
    ids = documents.select(_key(text_col).alias("key"), F.col(id_col).alias("__id"))
    order = F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("key").alias("key"))
    chosen = (
        ids.join(named.where("n > 0"), "key").groupBy("root", "key", "__id").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("root").agg(F.min_by(F.struct("key", "__id", "rows"), order).alias("c"))
        .select(F.col("c.key").alias("__key"), F.col("c.__id").alias("__id"), F.col("c.rows").alias("__rows"))
    )
    every = named.where("n = 0").select(F.col("key").alias("__key"), F.lit(None).cast(documents.schema[id_col].dataType).alias("__id"), F.lit(0).cast("bigint").alias("__rows"))
    # Which rows stay is settled on keys and ids; the texts then move once.
    decided = staged(chosen.unionByName(every), "decided")
    names = documents.columns
    held = documents.withColumn("__key", _key(text_col)).join(decided, "__key").where(
        (F.col("__rows") == 0) | F.col(id_col).eqNullSafe(F.col("__id")))
    kept = held.where("__rows < 2").select(*names)
    if decided.where("__rows > 1").isEmpty():
        return kept
    return kept.unionByName(held.where("__rows > 1").dropDuplicates(["__key"]).select(*names))
