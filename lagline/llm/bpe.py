"""Byte-pair encoding of many pre-tokens at once.

Two tiers. A minimal perfect hash finds pre-tokens that are vocabulary entries as a whole.
The distinct rest is merged from linked bytes: short ones in lockstep over arrays (each
step takes every word's best pair, the leftmost of equals), long ones one by one with a
heap of pairs, so that no length costs more than n log n.
"""

from __future__ import annotations

import heapq
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np

from lagline.llm.kit import U64, SpanHash, mix, ragged

NONE = np.int32(np.iinfo(np.int32).max)
LOCKSTEP_BYTES = 96

# Unicode's White_Space characters.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


class PerfectHash:
    """Hash-and-displace: a minimal perfect hash of distinct uint64 keys, with its values.

    Buckets of two keys and more, largest first, look for a displacement that puts all of
    their keys into free slots; buckets of one key name one of the slots left over.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.buckets, np.int64)
        taken, slot_of = np.zeros(n, bool), np.zeros(n, np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            for b in np.flatnonzero(sizes == size):
                own = order[ends[b] - size:ends[b]]
                shift, width = 0, 8
                while True:
                    tries = np.arange(shift, shift + width)
                    slots = self._slot(keys[own][None, :], tries[:, None])
                    good = ~taken[slots].any(axis=1)
                    if size > 1 and good.any():
                        ordered = np.sort(slots, axis=1)
                        good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                    if good.any():
                        break
                    shift, width = shift + width, min(4 * width, 4096)
                pick = int(np.argmax(good))
                self.shift[b] = shift + pick
                taken[slots[pick]] = True
                slot_of[own] = slots[pick]
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.shift[single] = -1 - free
        slot_of[order[ends[single] - 1]] = free
        self.keys, self.values = np.zeros(max(n, 1), np.uint64), np.zeros(max(n, 1), np.int32)
        self.keys[slot_of], self.values[slot_of] = keys, values

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys % U64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            moved = keys + (shift.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)
            return (mix(moved) % U64(max(self.n, 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NONE for a key that was not built in."""
        if not self.n:
            return np.full(len(keys), NONE, np.int32)
        shift = self.shift[self._bucket(keys)]
        slot = np.where(shift < 0, -1 - shift, self._slot(keys, np.maximum(shift, 0)))
        return np.where(self.keys[slot] == keys, self.values[slot], NONE)


@dataclass
class Merges:
    """Which pair of symbols merges at which rank, and into what."""

    pairs: PerfectHash
    rank: np.ndarray  # by pair number
    made: np.ndarray

    @classmethod
    def build(cls, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray) -> Merges:
        keys = left.astype(np.uint64) << U64(32) | right.astype(np.uint64)
        return cls(PerfectHash(keys, np.arange(len(keys), dtype=np.int32)), rank.astype(np.int32), made.astype(np.int32))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = self.pairs.find(left.astype(np.uint64) << U64(32) | right.astype(np.uint64))
        known = number != NONE
        safe = np.where(known, number, 0)
        return np.where(known, self.rank[safe], NONE), self.made[safe]


def merge_lockstep(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word (a run of `lengths` symbols) to the end; the symbols left and their counts."""
    done_symbols, done_words = [], []
    word = np.arange(len(lengths))
    rank, made = _pair_ranks(symbols, lengths, merges)
    while len(word):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        best = np.minimum.reduceat(rank, starts)
        live = best != NONE
        if not live.all():
            gone = np.repeat(~live, lengths)
            done_symbols.append(symbols[gone])
            done_words.append(np.repeat(word[~live], lengths[~live]))
            symbols, rank, made = symbols[~gone], rank[~gone], made[~gone]
            word, lengths, best = word[live], lengths[live], best[live]
            if not len(word):
                break
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        hit = np.flatnonzero(rank == np.repeat(best, lengths))
        of = np.searchsorted(starts, hit, "right") - 1
        first = np.concatenate([[True], of[1:] != of[:-1]])
        hit = hit[first]  # one place for each live word, the leftmost
        symbols[hit] = made[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
        symbols, rank, made = symbols[keep], rank[keep], made[keep]
        lengths = lengths - 1
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ends = starts + lengths - 1
        right = at < ends
        rank[at[~right]] = NONE
        x = at[right]
        rank[x], made[x] = merges.find(symbols[x], symbols[x + 1])
        x = at[at > starts] - 1
        rank[x], made[x] = merges.find(symbols[x], symbols[x + 1])
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    words = np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(words, minlength=int(words.max()) + 1)


def _pair_ranks(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    rank, made = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths) - 1] = True
    x = np.flatnonzero(~last)
    rank[x], made[x] = merges.find(symbols[x], symbols[x + 1])
    return rank, made


def merge_heap(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """One word by a heap of (rank, place) over linked symbols."""
    n = len(symbols)
    ranks, made = _pair_ranks(symbols, np.array([n]), merges)
    symbols, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(int(r), i, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, made)) if r != NONE]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r, m = merges.find(np.array([symbols[i]]), np.array([symbols[j]]))
            if r[0] != NONE:
                heapq.heappush(heap, (int(r[0]), i, symbols[i], symbols[j], int(m[0])))

    while heap:
        _, i, left, right, m = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = m, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return np.array([s for s in symbols if s >= 0], np.int32)


@dataclass
class Codec:
    """Whole-word table, merges, and the first symbol of a byte inside and at the end of a word."""

    whole: PerfectHash
    merges: Merges
    inner: np.ndarray
    final: np.ndarray

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[start:end], one after another, and how many each has.

        Pre-tokens are told apart by a 64-bit hash of their bytes and length.
        """
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, first, which = np.unique(SpanHash(data).of(start, end), return_index=True, return_inverse=True)
        single = self.whole.find(keys)
        miss = np.flatnonzero(single == NONE)
        ids, counts = self._merged(data, start[first[miss]], end[first[miss]])
        per = np.ones(len(keys), np.int64)
        per[miss] = counts
        begin = np.zeros(len(keys), np.int64)
        begin[miss] = len(keys) + np.cumsum(counts) - counts
        hits = np.flatnonzero(single != NONE)
        begin[hits] = hits
        pool = np.concatenate([np.where(single == NONE, 0, single), ids]).astype(np.int32)
        return pool[ragged(begin[which], per[which])], per[which]

    def _merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = end - start
        symbols = self.inner[data[ragged(start, lengths)]]
        if len(lengths):
            symbols[np.cumsum(lengths) - 1] = self.final[data[end - 1]]
        long = lengths > LOCKSTEP_BYTES
        if not long.any():
            return merge_lockstep(symbols, lengths, self.merges)
        pieces: list[np.ndarray] = [None] * len(lengths)
        offsets = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(long):
            pieces[i] = merge_heap(symbols[offsets[i]:offsets[i] + lengths[i]], self.merges)
        short = np.flatnonzero(~long)
        ids, counts = merge_lockstep(symbols[np.repeat(~long, lengths)], lengths[short], self.merges)
        for i, piece in zip(short, np.split(ids, np.cumsum(counts)[:-1])):
            pieces[i] = piece
        return np.concatenate(pieces), np.array([len(p) for p in pieces])


def whole_table(tokens: list[bytes], ids: list[int]) -> PerfectHash:
    """Tier one: entries by the hash that `encode` gives their bytes."""
    data = np.frombuffer(b"".join(tokens), np.uint8)
    end = np.cumsum([len(t) for t in tokens])
    start = end - np.array([len(t) for t in tokens])
    return PerfectHash(SpanHash(data).of(start, end), np.array(ids, np.int32))


_CLASSES: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _CLASSES = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        _CLASSES[WHITE_SPACE] = SPACE
    return _CLASSES


def code_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text, and the byte offset of each in its UTF-8 form (one more at the end)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return points, np.concatenate([[0], np.cumsum(width)])


def pre_tokens(points: np.ndarray, edges: np.ndarray, with_spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens in code points; `edges` are row starts, which no token crosses.

    Runs of letters, of numbers and of other characters, and the seven English contractions.
    With spaces (as in `public_tokenizers.PATTERN`) a run takes a space before it along and white
    space is kept; without, numbers stand alone, one character each, and white space goes.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[points]
    fresh = np.zeros(n + 1, bool)  # a token starts here
    fresh[1:n] = kind[1:] != kind[:-1]
    row = np.zeros(n + 1, bool)
    row[edges[edges < n]] = True
    row[0] = True
    fresh |= row
    fresh[n] = True
    if not with_spaces:
        fresh[:n] |= kind == NUMBER
    else:
        # The last white space of a run stands alone, or joins what follows if it is a plain space.
        blank = kind == SPACE
        last = np.flatnonzero(blank & np.concatenate([~blank[1:], [False]]) & ~row[1:])
        fresh[last] = True
        plain = last[points[last] == 32]
        fresh[plain + 1] = False
    quote = np.flatnonzero((points == 39) & fresh[:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        rows = np.append(np.flatnonzero(row[:n]), n)
        limit = rows[np.searchsorted(rows, quote, "right")]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (quote + 1 < limit)
        two = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        two &= quote + 2 < limit
        for which, size in ((one, 2), (two & ~one, 3)):
            at = quote[which]
            fresh[at + 1] = False
            fresh[at + size] = True
    start = np.flatnonzero(fresh[:n])
    end = np.append(start[1:], n)
    if not with_spaces:
        keep = kind[start] != SPACE
        start, end = start[keep], end[keep]
    return start, end
