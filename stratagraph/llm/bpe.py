"""Byte-pair merging as vectorised rounds over flat numpy arrays.

A batch of words is one flat array of symbols with word lengths. Words are first
cut where no merge can cross: between two symbols that no rule brings together.
Each round looks up the rank of every adjacent pair, takes the minimum of (rank,
position) over each word's segment, and merges in all words at once; then the
arrays are compacted. A word leaves when none of its pairs has a rank.

A word's leftmost pair of least rank is always merged. The other pairs of that
rank follow in the same round, leftmost first where they overlap, unless a merge to
their left makes a pair that ranks no later ("loud") and is so near that what
follows from it could reach them: no symbol is longer than `reach` first symbols.
So the order is that of the sequential algorithm wherever order matters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHIFT = 22  # symbols are below 2**22
NONE = np.int64(1) << 30


class Pairs:
    """(left, right) -> rank and merged symbol, as sorted arrays."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.int64) << SHIFT) | np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rank = np.append(np.asarray(rank, np.int64)[order], NONE)
        self.merged = np.append(np.asarray(merged, np.int64)[order], -1)
        self._rules(np.asarray(left, np.int64)[order], np.asarray(right, np.int64)[order])

    def _rules(self, left: np.ndarray, right: np.ndarray) -> None:
        """crossed: adjacent first symbols that a rule can bring together; quiet: by rank, whether all rules of what it makes rank later; reach: see above."""
        merged, rank = self.merged[:-1], self.rank[:-1]
        size = int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1
        first, last = np.arange(size), np.arange(size)
        while True:
            f, e = first[left], last[right]
            if (first[merged] == f).all() and (last[merged] == e).all():
                break
            first[merged], last[merged] = f, e
        self.crossed = np.unique((last[left] << SHIFT) | first[right])
        long = np.ones(size, np.int64)
        while (long[merged] < long[left] + long[right]).any():
            np.maximum.at(long, merged, long[left] + long[right])
        self.reach = 2 * int(long.max(initial=1)) + 2
        soonest = np.full(size, NONE)
        np.minimum.at(soonest, left, rank)
        np.minimum.at(soonest, right, rank)
        self.quiet = np.ones(int(rank.max(initial=0)) + 1, bool)
        np.logical_and.at(self.quiet, rank, soonest[merged] > rank)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where no merge can join the first symbols a and b."""
        if not len(self.crossed):
            return np.ones(len(a), bool)
        key = (a << SHIFT) | b
        at = np.searchsorted(self.crossed, key)
        at[at == len(self.crossed)] = 0
        return self.crossed[at] != key

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, the last index where there is none."""
        key = (a << SHIFT) | b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, at, len(self.key))


def _together(at: np.ndarray, sym: np.ndarray, word: np.ndarray, pair: np.ndarray, rank: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Which of the pairs at these places, those of least rank in their words, are merged in one round."""
    n = len(at)
    k = np.arange(n)
    new = np.flatnonzero(np.r_[True, np.diff(at) != 1][:n])  # runs of overlapping pairs
    run = np.repeat(new, np.diff(np.r_[new, n]))
    good = (k - run) % 2 == 0
    odd = np.flatnonzero(~pairs.quiet[rank])
    if not len(odd):
        return good
    place, made = at[odd], pairs.merged[pair[at]]
    end = len(sym) - 1
    right, left, before = np.minimum(place + 2, end), np.maximum(place - 1, 0), np.maximum(odd - 2, 0)
    loud = np.zeros(n, bool)
    loud[odd] = (word[right] == word[place]) & (right == place + 2) & (pairs.rank[pairs.find(made[odd], sym[right])] <= rank[odd])
    loud[odd] |= (word[left] == word[place]) & (left < place) & (pairs.rank[pairs.find(sym[left], made[odd])] <= rank[odd])
    loud[odd] |= (at[before] == place - 2) & (word[at[before]] == word[place]) & (pairs.rank[pairs.find(made[before], made[odd])] <= rank[odd])
    last = np.r_[-1, np.maximum.accumulate(np.where(loud, k, -1))[:-1]]  # the loud pair to the left
    clear = (last < 0) | (word[at[last]] != word[at]) | (at - at[last] > pairs.reach)
    return good & clear & clear[run]


def _merge_block(sym: np.ndarray, lens: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    n = len(lens)
    word = np.repeat(np.arange(n), lens)
    none = len(pairs.key)
    pair = np.full(len(sym), none, np.int64)
    same = word[1:] == word[:-1]
    pair[:-1] = np.where(same, pairs.find(sym[:-1], sym[1:]), none)
    out_sym, out_word = [], []
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        rank = pairs.rank[pair]
        least = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), first)
        open_ = (least >> 32) < NONE
        size = np.diff(np.r_[first, len(sym)])
        keep = np.ones(len(sym), bool)
        if not open_.all():
            closed = ~np.repeat(open_, size)
            out_sym.append(sym[closed])
            out_word.append(word[closed])
            keep = ~closed
        at = np.flatnonzero(rank == np.repeat(np.where(open_, least >> 32, -1), size))
        at = at[_together(at, sym, word, pair, rank[at], pairs)]
        sym[at] = pairs.merged[pair[at]]
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, word, pair = sym[keep], word[keep], pair[keep]
        if not len(sym):
            break
        at = moved[at]
        right = np.minimum(at + 1, len(sym) - 1)
        pair[at] = np.where((right > at) & (word[right] == word[at]), pairs.find(sym[at], sym[right]), none)
        at = at[(at > 0) & (word[np.maximum(at - 1, 0)] == word[at])]
        pair[at - 1] = pairs.find(sym[at - 1], sym[at])
    if not out_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, word = np.concatenate(out_sym), np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n)


def merge_words(sym: np.ndarray, lens: np.ndarray, pairs: Pairs, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words; returns the flat symbols and the new lengths."""
    if not len(sym):
        return np.zeros(0, np.int64), np.zeros(len(lens), np.int64)
    word = np.repeat(np.arange(len(lens)), lens)
    starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | pairs.apart(sym[:-1], sym[1:])])
    ends = np.r_[starts[1:], len(sym)]
    out, counts = [], []
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + block, side="right")), i + 1)
        a, b = _merge_block(sym[starts[i] : ends[j - 1]].copy(), ends[i:j] - starts[i:j], pairs)
        out.append(a)
        counts.append(b)
        i = j
    return np.concatenate(out), np.bincount(word[starts], weights=np.concatenate(counts), minlength=len(lens)).astype(np.int64)


def binary(data: np.ndarray | bytes, starts: np.ndarray) -> pa.Array:
    """A binary array over data, with the elements' starts and the end of the last."""
    starts = np.ascontiguousarray(starts, np.int64)
    buf = pa.py_buffer(data)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), buf])


def parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_binary array without nulls, the offsets from 0."""
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def offsets(lens: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lens)].astype(np.int64)


def gather(flat: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenate the segments of flat that which names, repeats included."""
    off = offsets(lens)[:-1]
    n = lens[which]
    out = offsets(n)
    return flat[np.arange(out[-1]) - np.repeat(out[:-1] - off[which], n)]
