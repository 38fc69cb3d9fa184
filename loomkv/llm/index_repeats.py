"""op1: passages that repeat across documents, by matching statistics from a compressed FM-index of each shard.

The Burrows-Wheeler transform of a shard of loomkv.llm.repeats is kept as a wavelet tree of packed bits
with a count for every 64 of them. All segments of the shard are streamed through it together, from right to
left: a step of backward search puts a word before the match, and where no second document has the longer
one, the match gives way to its parent interval. That gives at every word the length of the longest match,
up to MIN_WORDS, with a passage that stands in two documents; the intervals at MIN_WORDS are reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomkv.llm import repeats as R

ORACLE = R.ORACLE
U64 = np.uint64


class WaveletTree:
    """Occurrences of a symbol before a place; the levels' nodes lie side by side, zeros before ones."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.bits)):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed)))[:-1].astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        lo, hi = np.zeros(len(symbols), np.int64), places
        for k, level in enumerate(reversed(range(self.bits))):
            words, counts = self.words[k], self.counts[k]
            ones = [counts[x >> 6] + np.bitwise_count(words[x >> 6] & ((U64(1) << (x & 63).astype(U64)) - U64(1))) for x in (lo, hi)]
            one = (symbols >> level) & 1 == 1
            lo, hi = (np.where(one, self.zeros[k] + n, x - n) for x, n in zip((lo, hi), ones))
        return hi - lo


def _nearest_smaller(value: np.ndarray) -> np.ndarray:
    """The last place before each one with a smaller value, or -1; places in between have values not smaller than its own."""
    at = np.arange(len(value)) - 1
    low = np.append(value, -2)
    todo = np.flatnonzero(low[at] >= value)
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[low[at[todo]] >= value[todo]]
    return at


def statistics(shard: R.Shard) -> tuple[np.ndarray, np.ndarray]:
    """At every position of the text the length, up to MIN_WORDS, of the longest match that stands in two documents, and the first row of its interval."""
    sa = shard.suffixes()
    last = shard.text[sa - 1]
    tree = WaveletTree(last)
    size = len(sa)
    before = np.searchsorted(shard.text[sa], np.arange(int(shard.text.max()) + 2))
    prefixes = np.append(R.bounded_prefixes(last, R.MIN_WORDS), -1)
    prefixes[0] = -1
    up = _nearest_smaller(prefixes)
    down = size - _nearest_smaller(prefixes[::-1])[::-1]
    owner = shard.owner[sa]
    lo, hi = shard.lo[owner], shard.hi[owner]
    mixed = np.append(0, np.cumsum((lo < hi)))
    changes = np.append(0, np.cumsum(np.append(False, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))

    def parent(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows left to right - 1: the next wider interval and the length that its rows share."""
        k = np.where(prefixes[left] >= prefixes[right], left, right)
        depth = prefixes[k]
        return np.where(depth < 0, 0, up[k]), np.where(depth < 0, size, down[k]), np.maximum(depth, 0)

    length, row = np.zeros(size, np.int32), np.zeros(size, np.int64)
    lane = np.arange(shard.m)
    place = shard.ends - 2
    left, right, depth = np.zeros(shard.m, np.int64), np.full(shard.m, size), np.zeros(shard.m, np.int64)
    while len(lane):
        full = depth == R.MIN_WORDS
        while full.any():  # give up the last word, to find the interval of the next gram
            at = np.flatnonzero(full)
            l, r, d = parent(left[at], right[at])
            wide = d >= R.MIN_WORDS - 1
            left[at[wide]], right[at[wide]] = l[wide], r[wide]
            depth[at] = R.MIN_WORDS - 1
            full = np.zeros(len(lane), bool)
        symbol = shard.text[place]
        l, r = before[symbol] + tree.rank(symbol, left), before[symbol] + tree.rank(symbol, right)
        good = (r > l) & ((mixed[r] > mixed[l]) | (changes[r] > changes[np.minimum(l + 1, r)]))
        stuck = ~good & (depth == 0)
        move = good | stuck
        depth[good] += 1
        left[good], right[good] = l[good], r[good]
        left[stuck], right[stuck] = 0, size
        length[place[move]], row[place[move]] = depth[move], left[move]
        back = np.flatnonzero(~move)
        left[back], right[back], depth[back] = parent(left[back], right[back])
        place = place - move
        keep = place >= shard.starts[lane]
        lane, place, left, right, depth = lane[keep], place[keep], left[keep], right[keep], depth[keep]
    heads = np.flatnonzero(prefixes[:-1] < R.MIN_WORDS)
    least = np.minimum.reduceat(lo, heads)
    return length, least[np.searchsorted(heads, row, side="right") - 1]


def by_statistics(shard: R.Shard) -> tuple[np.ndarray, np.ndarray]:
    length, first = statistics(shard)
    return length >= R.MIN_WORDS, first


def index_repeats(documents: DataFrame) -> DataFrame:
    """As loomkv.llm.repeats.repeats(): (doc_id, start_word, end_word, first_doc)."""
    return R.repeats(documents, by_statistics)


def op1_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
