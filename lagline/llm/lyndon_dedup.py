"""Exact removal of repeated passages with suffix arrays built by linear grouping.

Every 400-byte window has an anchor, its least k-gram by hash, so equal windows have equal
anchors at equal places. The windows of one anchor form a segment; segments whose anchor
k-gram stands once in the corpus cannot repeat and go no further. The rest meet by anchor.
Their bytes are read as content-defined phrases, a suffix array over the phrases finds
which runs of phrases stand twice, and windows inside such runs are compared by 64-bit hashes of their bytes.
Anchors with very many segments take another exact way: their windows are cut into pieces of a few dozen by their
distance to the anchor, equal pieces are counted as wholes, and only pieces that share what all their windows cover
without being equal are taken apart into windows, which are counted by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lagline.llm.kit import U64, SpanHash, binary_rows, byte_buffer, chunked, map_rows, ragged
from lagline.llm.suffixes import longest_shared
from lagline.staging import release, staged, tidy, written

LENGTH = 400
GRAM = 24  # bytes of an anchor
CUT = 8  # bytes that decide whether a phrase ends
PHRASE_MASK = 31  # phrases of 32 bytes on average
HOT = 200  # segments of one anchor that one task compares
TASK_BYTES = 1 << 20  # segments of so many bytes are sorted together
PIECE = 32  # windows of a hot anchor that are counted together


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, row, first window, number of windows, anchor's distance from the first) of all segments; windows count from the row's start."""
    none = np.zeros(0, np.int64)
    width = length - GRAM + 1
    grams = SpanHash(data).every(GRAM)
    if len(grams) < width:
        return none.astype(np.uint64), none, none, none, none
    bits = U64(max(1, int(len(grams) - 1).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[:len(least) - (width - step)], least[width - step:])
    anchor = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    window = ragged(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
    if not len(window):
        return none.astype(np.uint64), none, none, none, none
    anchor = anchor[window]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])]))
    count = np.diff(np.append(head, len(window)))
    return grams[anchor[head]], rows[head], window[head] - offsets[:-1][rows[head]], count, anchor[head] - window[head]


def _anchors(keyed: DataFrame, length: int) -> DataFrame:
    """(key, gram, first, windows, reach) of every segment."""

    def run(batches):
        for chunk in chunked(batches, "text"):
            data, offsets = byte_buffer(chunk.column(1))
            gram, row, first, count, reach = segments(data, offsets, length)
            yield pa.RecordBatch.from_arrays([
                chunk.column(0).take(pa.array(row)), pa.array(gram.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                pa.array(reach.astype(np.int32)),
            ], ["key", "gram", "first", "windows", "reach"])

    return keyed.mapInArrow(run, "key binary, gram bigint, first int, windows int, reach int")


def _bodies(held: DataFrame, length: int) -> DataFrame:
    """One row per wanted segment with its bytes. Of neighbouring rows with one key, the first counts."""

    def run(batches):
        last = None
        for chunk in chunked(batches, "text"):
            keys = chunk.column(0).to_pylist()
            fresh = [k != b for k, b in zip(keys, [last, *keys[:-1]])]
            last = keys[-1]
            picked = chunk.filter(pa.array(fresh))
            if not len(picked):
                continue
            data, offsets = byte_buffer(picked.column(1))
            lists = picked.column(2)
            row = np.repeat(np.arange(len(picked)), lists.value_lengths().to_numpy())
            gram, first, windows, reach, n = (lists.flatten().field(i).to_numpy() for i in range(5))
            start, size = offsets[row] + first, windows.astype(np.int64) + length - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(gram), pa.array(n), picked.column(0).take(pa.array(row)), pa.array(first), pa.array(windows), pa.array(reach),
                binary_rows(data[ragged(start, size)], np.concatenate([[0], np.cumsum(size)])),
            ], ["gram", "n", "key", "first", "windows", "reach", "body"])

    return held.mapInArrow(run, "gram bigint, n bigint, key binary, first int, windows int, reach int, body binary")


def phrase_starts(body: np.ndarray) -> np.ndarray:
    """Places behind CUT bytes whose hash ends a phrase."""
    return np.flatnonzero((SpanHash(body).every(CUT) & U64(PHRASE_MASK)) == 0) + CUT


def repeated_windows(bodies: list[bytes], grams: list[int], occurrences: list[tuple], length: int = LENGTH) -> list[np.ndarray]:
    """For every segment, which of its windows stand in another occurrence too.

    Segments of one anchor meet; `occurrences` tells copies of one row from true repeats.
    """
    places: dict[tuple[int, bytes], set] = {}
    for gram, body, where in zip(grams, bodies, occurrences):
        places.setdefault((gram, body), set()).add(where)
    per_gram: dict[int, int] = {}
    for gram, _ in places:
        per_gram[gram] = per_gram.get(gram, 0) + 1
    found: dict[tuple[int, bytes], np.ndarray] = {}
    meet = [k for k in places if per_gram[k[0]] > 1]
    for k in places:
        found[k] = np.full(len(k[1]) - length + 1, len(places[k]) > 1)
    if meet:
        data = np.frombuffer(b"".join(b for _, b in meet), np.uint8)
        sizes = np.array([len(b) for _, b in meet])
        starts = np.cumsum(sizes) - sizes
        hashes = SpanHash(data)
        cut = phrase_starts(data)
        owner = np.searchsorted(starts, cut - CUT, "right") - 1
        inside = cut <= starts[owner] + sizes[owner]
        cut, owner = cut[inside], owner[inside]
        # Phrases lie between two cuts of one segment; a unique symbol parts the segments.
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        name = hashes.of(cut[pair], cut[pair + 1])
        symbol = np.unique(name, return_inverse=True)[1] + len(meet)
        new = np.concatenate([[True], owner[pair][1:] != owner[pair][:-1]]) if len(pair) else np.zeros(0, bool)
        gaps = np.flatnonzero(new)
        sequence = np.insert(symbol, gaps, np.arange(len(gaps)))
        shared = longest_shared(sequence.tolist()) if len(sequence) else np.zeros(0, np.int64)
        longest = np.zeros(len(cut), np.int64)
        longest[pair] = np.delete(shared, gaps + np.arange(len(gaps)))
        # A window is possible if all phrases inside it, from its byte CUT on, stand elsewhere.
        counts = sizes - length + 1
        window = ragged(starts, counts)
        begin = np.searchsorted(cut, window + CUT)
        whole = np.searchsorted(cut, window + length, "right") - begin - 1
        possible = (whole < 1) | (longest[np.minimum(begin, max(len(cut) - 1, 0))] >= whole if len(cut) else True)
        at = window[possible]
        content = hashes.of(at, at + length)
        _, which, times = np.unique(content, return_inverse=True, return_counts=True)
        twice = times[which] > 1  # distinct segments of one anchor are distinct places
        flags = np.zeros(len(window), bool)
        flags[np.flatnonzero(possible)[twice]] = True
        for k, key in enumerate(meet):
            found[key] = found[key] | flags[starts[k] - (length - 1) * k:][:counts[k]]
    return [found[g, b] for g, b in zip(grams, bodies)]


def _runs(flags: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


RUNS = "key binary, start bigint, end bigint"


def _sorted_runs(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated runs among segments of anchors that are not hot."""

    def solve(rows: list[tuple]):
        flags = repeated_windows([r[3] for r in rows], [r[0] for r in rows], [(r[1], r[2]) for r in rows], length)
        out = [(r[1], a, b) for r, f in zip(rows, flags) for a, b in _runs(f, r[2], length)]
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
            ], ["key", "start", "end"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held > TASK_BYTES and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield from solve(rows)

    picked = bodies.where(F.col("n") <= HOT).select("gram", "key", "first", "body")
    return picked.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, RUNS)


def pieces(reach: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(segment, first window, number of windows, start and end of their core) of all pieces, in their segments' bytes.

    A piece holds the windows that begin between k and k + 1 times PIECE bytes before the anchor, so equal windows are
    in the same place of pieces with the same core: the bytes that every possible window of the piece covers.
    """
    step = min(PIECE, length)
    low = (reach - windows + 1) // step
    many = reach // step - low + 1
    segment = np.repeat(np.arange(len(reach)), many)
    begin = ragged(low, many) * step
    far = np.minimum(begin + step - 1, reach[segment])
    near = np.maximum(begin, (reach - windows + 1)[segment])
    core = reach[segment] - begin
    return segment, reach[segment] - far, far - near + 1, core, core - step + 1 + length


def _hot_pieces(hot: DataFrame, length: int) -> DataFrame:
    """(core, whole, key, segment, first, windows): hashes of the core and of all bytes of every piece."""

    def run(batches):
        for chunk in chunked(batches, "body"):
            data, offsets = byte_buffer(chunk.column(3))
            first, reach = (chunk.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            row, at, windows, low, high = pieces(reach, np.diff(offsets) - length + 1, length)
            hashes, base = SpanHash(data), offsets[:-1][row]
            core, whole = hashes.of(base + low, base + high), hashes.of(base + at, base + at + windows - 1 + length)
            yield pa.RecordBatch.from_arrays([
                pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), chunk.column(0).take(pa.array(row)),
                pa.array(first[row]), pa.array(first[row] + at), pa.array(windows),
            ], ["core", "whole", "key", "segment", "first", "windows"])

    return hot.mapInArrow(run, "core bigint, whole bigint, key binary, segment bigint, first bigint, windows bigint")


def _piece_windows(held: DataFrame, length: int) -> DataFrame:
    """(key, start, name) of the windows of the listed pieces."""

    def run(batches):
        for chunk in chunked(batches, "body"):
            data, offsets = byte_buffer(chunk.column(2))
            lists = chunk.column(3)
            row = np.repeat(np.arange(len(chunk)), lists.value_lengths().to_numpy())
            first, windows = (lists.flatten().field(i).to_numpy() for i in range(2))
            start, row = ragged(first, windows), np.repeat(row, windows)
            at = offsets[:-1][row] + start - chunk.column(1).to_numpy()[row]
            name = SpanHash(data).of(at, at + length)
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(row)), pa.array(start), pa.array(name.view(np.int64))], ["key", "start", "name"])

    return held.mapInArrow(run, "key binary, start bigint, name bigint")


def _counted_runs(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated runs among segments of hot anchors: pieces by their hashes, windows of those that are equal in part."""
    hot = bodies.where(F.col("n") > HOT).select("key", F.col("first").cast("bigint").alias("segment"), "reach", "body")
    cut = staged(_hot_pieces(hot, length), "pieces")
    place = F.xxhash64("key", "first")
    wholes = staged(cut.groupBy("core", "whole").agg(F.min(place).alias("a"), F.max(place).alias("b")), "wholes")
    # Pieces that stand once are taken out, by their only place: the place takes part in the key, so that none is hot.
    alone = wholes.where("a = b").select("core", "whole", F.col("a").alias("place"))
    same = cut.withColumn("place", place).join(alone, ["core", "whole", "place"], "left_anti")
    runs = same.select("key", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    mixed = staged(wholes.groupBy("core").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high").select("core"), "mixed")
    # One place of each whole stands for the others, whose windows are all repeated.
    chosen = cut.withColumn("a", place).join(wholes.join(mixed, "core").select("core", "whole", "a"), ["core", "whole", "a"])
    listed = chosen.groupBy("key", "segment").agg(F.collect_set(F.struct("first", "windows")).alias("listed"))
    held = hot.join(listed, ["key", "segment"]).select("key", "segment", "body", "listed")
    windows = staged(_piece_windows(held, length), "windows")
    start = F.xxhash64("key", "start")
    once = windows.groupBy("name").agg(F.min(start).alias("place"), F.max(start).alias("b")).where("place = b").select("name", "place")
    twice = windows.withColumn("place", start).join(once, ["name", "place"], "left_anti")
    return runs.unionByName(twice.select("key", "start", (F.col("start") + length).alias("end")))


def find_repeats(documents: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, spans): the repeated byte ranges of every distinct text, by the md5 of the text; copies are left out.

    Whole copies repeat throughout and are told by their count (see `remove_repeats`); their
    text still takes part for others.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = documents.select(F.unhex(F.md5(body)).alias("key"), body.alias("text"))
    anchors = staged(_anchors(keyed, length), "anchors")
    place = F.xxhash64("key", "first")
    # Stored, so that both sides of the join below are dealt out alone and a hot anchor's rows can be split.
    shared = staged(
        anchors.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a <> b").select("gram", "n"), "shared")
    wanted = anchors.join(shared, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "first", "windows", "reach", "n")).alias("wanted"))
    bodies = staged(_bodies(keyed.join(wanted, "key").select("key", "text", "wanted"), length), "segments")
    runs = _sorted_runs(bodies, length).unionByName(_counted_runs(bodies, length))
    return runs.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(documents: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_text to every row.

    A byte goes if a string of `length` bytes that covers it starts anywhere else in the
    table. All places are judged on the input, so all copies go, the first too, and a row
    that stands twice (repeated rows as well) loses everything from `length` bytes on.
    kept_text leaves out characters of which only some bytes remain.
    Null and empty texts have no bytes. Columns with the added names are replaced. Windows
    are compared by 64-bit hashes of their bytes, texts by md5.
    """
    mark = len(written())
    documents = documents.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_text")
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    copies = documents.select(key.alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__copies")).where("__copies > 1")
    spans = find_repeats(documents, text, length).withColumnRenamed("key", "__key").withColumnRenamed("spans", "__spans")
    facts = staged(copies.join(spans, "__key", "full"), "repeats")
    del spans
    release(documents.sparkSession, written(mark)[:-1])
    tidy(documents.sparkSession)
    held = documents.withColumn("__key", key).join(facts, "__key", "left")
    names = held.columns
    at = {n: names.index(n) for n in (text, "__spans", "__copies")}

    def run(chunk):
        data, offsets = byte_buffer(chunk.column(at[text]))
        raw = data.tobytes()
        sizes, gone, spans, kept = [], [], [], []
        for a, b, found, copies in zip(offsets[:-1].tolist(), offsets[1:].tolist(), chunk.column(at["__spans"]).to_pylist(), chunk.column(at["__copies"]).to_pylist()):
            size = b - a
            if copies and size >= length:
                merged = [(0, size)]
            else:
                merged = []
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                    else:
                        merged.append((s, e))
            edges = [0, *(x for m in merged for x in m), size]
            kept.append(b"".join(raw[a + s:a + e] for s, e in zip(edges[::2], edges[1::2])))
            sizes.append(size)
            spans.append(len(merged))
            gone.append(size - len(kept[-1]))
        return [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]

    long = T.LongType()
    out = map_rows(held, run, [("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept", T.BinaryType()), ("kept_text", T.StringType())], text)
    return out.drop("__key", "__spans", "__copies")
