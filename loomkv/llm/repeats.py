"""Passages of MIN_WORDS words or more that stand in two documents or more: what op1 and op7 share.

A gram is MIN_WORDS words on end. The least hash of its runs of ANCHOR words is its anchor, so that equal
grams have equal anchors wherever they stand. The grams of a document that follow each other with one
anchor form a segment, of MOST_GRAMS grams at most, and every gram is in exactly one segment; equal grams
meet in the shard of their anchor, and no document is compared to all others. Three kinds of segments:

- its anchor stands in one document only: nothing in it is repeated;
- it is the only text with its anchor and several documents hold it: all of it is repeated;
- other texts have its anchor too: they are searched together, by the method of the operator.

Copies of a segment are one row from the start, so that a passage in a third of all rows is a small
shard; texts of one anchor that still exceed HOT_BYTES are counted gram by gram instead, with partial sums
before the shuffle, to the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkv.llm import text as T
from loomkv.llm.shared import written

MIN_WORDS = 50
ANCHOR = 8
MOST_GRAMS = 128
SHARD_BYTES = 6 << 20
HOT_BYTES = 16 << 20
SLICE = 1 << 22
NOBODY = -(1 << 63)
C = T.U64(0x9E3779B97F4A7C15)
I64 = np.int64

ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {MIN_WORDS - 1}, 0))) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ')) AS gram FROM p),
r AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i, first_doc, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {MIN_WORDS}, true) AS new FROM g JOIN r USING (gram)),
k AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM h)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {MIN_WORDS} AS INTEGER) AS end_word, min(first_doc) AS first_doc FROM k GROUP BY doc_id, island"""


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum over g[i : i + width], by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        g = np.minimum(g[: len(g) - step], g[step:])
        done += step
    return g


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first word, grams, anchor, two hashes) of the segments of all rows of a slice."""
    starts, ends, first = T.words(data, offsets)
    h = T.word_hashes(data, starts, ends)
    n = len(h)
    empty = np.zeros(0, I64)
    if n < MIN_WORDS:
        return empty, empty, empty, empty, empty, empty
    g, size = h, 1
    while size < ANCHOR:
        g = T.mix(g[: len(g) - size] * C + g[size:])
        size *= 2
    v = _least(g, MIN_WORDS - ANCHOR + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = row[: len(v)] == row[MIN_WORDS - 1 :]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1 : len(v)] != row[: len(v) - 1]) | ~whole[:-1]
    at = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), len(v))
    runs = stop[np.searchsorted(stop, at, side="right")] - at
    pieces = -(-runs // MOST_GRAMS)
    begin = np.repeat(at, pieces) + T.ragged(np.zeros(len(at), I64), pieces) * MOST_GRAMS
    grams = np.minimum(MOST_GRAMS, np.repeat(at + runs, pieces) - begin)
    one, two = np.zeros(len(begin), T.U64), np.zeros(len(begin), T.U64)
    for k in range(0, len(begin), 4096):
        b, m = begin[k : k + 4096], grams[k : k + 4096] + MIN_WORDS - 1
        x = h[T.ragged(b, m)] + T.ragged(np.zeros(len(b), I64), m).astype(T.U64) * C
        heads = np.cumsum(m) - m
        one[k : k + 4096] = np.add.reduceat(T.mix(x), heads)
        two[k : k + 4096] = np.add.reduceat(T.mix(x ^ T.U64(0xA5A5A5A55A5A5A5A)), heads)
    return row[begin], begin - first[row[begin]], grams, v[begin].view(I64), one.view(I64), two.view(I64)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch.column(2), SLICE):
            row, begin, grams, v, one, two = segments(data, offsets)
            at = pa.array(row + lo)
            yield pa.record_batch({"doc": batch.column(0).take(at), "t": batch.column(1).take(at), "s": pa.array(begin.astype(np.int32)), "n": pa.array(grams.astype(np.int32)), "v": pa.array(v), "a": pa.array(one), "b": pa.array(two)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments (s, n), joined by single spaces, out of each row's text."""
    for batch in batches:
        lists = batch.column(1)
        counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        s, n = flat.field("s").to_numpy().astype(I64), flat.field("n").to_numpy().astype(I64) + MIN_WORDS - 1
        ends = np.cumsum(counts)
        for lo, hi, data, offsets in T.slices(batch.column(0), SLICE):
            starts, stops, first = T.words(data, offsets)
            here = slice(ends[lo] - counts[lo], ends[hi - 1])
            word = s[here] + np.repeat(first[:-1], counts[lo:hi])
            x, y = starts[word], stops[word + n[here] - 1]
            plain = np.where(T.SPACE[data], 32, data).astype(np.uint8)
            texts = [plain[p:q].tobytes() for p, q in zip(x.tolist(), y.tolist())]
            yield pa.record_batch({**{k: flat.field(k).slice(here.start, here.stop - here.start) for k in ("v", "a", "b", "lo", "hi")}, "seg": pa.array(texts, pa.binary())})


class Shard:
    """The segments of one shard as numbers: a terminator of its own after each, then one number for each different word."""

    def __init__(self, texts: pa.Array, lo: np.ndarray, hi: np.ndarray) -> None:
        ((_, _, data, offsets),) = T.slices(texts.cast(pa.large_binary()).cast(pa.large_string()), 1 << 60)
        starts, ends, first = T.words(data, offsets)
        self.m, self.lo, self.hi = len(texts), lo, hi
        self.sizes = np.diff(first) + 1
        _, words = np.unique(T.word_hashes(data, starts, ends), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.text = np.empty(self.ends[-1], I64)
        self.text[self.ends - 1] = np.arange(self.m)
        self.text[T.ragged(self.starts, self.sizes - 1)] = words + self.m
        self.owner = np.repeat(np.arange(self.m), self.sizes)

    def suffixes(self) -> np.ndarray:
        """The suffix array, by prefix doubling over the suffixes that are not yet told apart."""
        size = len(self.text)
        order = np.argsort(self.text, kind="stable")
        rank, active, step = _first_ranks(self.text, order), order, 1
        sa = order.copy()
        while True:
            count = np.bincount(rank, minlength=size)
            active = active[count[rank[active]] > 1]
            if not len(active):
                sa[rank] = np.arange(size)
                return sa
            after = np.append(rank, 0)[np.minimum(active + step, size)]
            active = active[np.lexsort((after, rank[active]))]
            after = np.append(rank, 0)[np.minimum(active + step, size)]
            rank[active] = _next_ranks(rank[active], after)
            step *= 2


def _first_ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many suffixes have a smaller key; order sorts them by it."""
    head = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(len(key), I64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    return rank


def _next_ranks(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The ranks that group stands for, told apart further by key; both in sorted order."""
    at = np.arange(len(key))
    new = np.append(True, group[1:] != group[:-1])
    head = new | np.append(True, key[1:] != key[:-1])
    return group + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(new, at, 0))


def bounded_prefixes(last: np.ndarray, most: int) -> np.ndarray:
    """For each row of a Burrows-Wheeler transform the length of the prefix that its suffix shares with the row above, or `most` if not shorter.

    Breadth first: after round k the rows with a value below k bound the intervals of all strings of k symbols.
    One step of backward extension of all those intervals at once tells which rows bound those of k + 1: the row
    that a place of the transform leads to does, unless its interval holds an earlier place with the same symbol.
    """
    size = len(last)
    psi = np.argsort(last, kind="stable")
    symbol = last[psi]
    value = np.full(size, most, np.int32)
    open_ = np.flatnonzero(np.append(False, symbol[1:] == symbol[:-1]))
    value[np.append(True, symbol[1:] != symbol[:-1])] = 0
    bound = value == 0
    for k in range(1, most):
        if not len(open_):
            break
        interval = np.cumsum(bound, dtype=np.int32)
        split = interval[psi[open_]] != interval[psi[open_ - 1]]
        rows = open_[split]
        value[rows] = k
        bound[rows] = True
        open_ = open_[~split]
    return value


def flagged(shard: Shard, hits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, first gram, grams, least first) of the runs of text positions where hits."""
    at = np.flatnonzero(hits)
    owner = shard.owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    if not len(heads):
        e = np.zeros(0, I64)
        return e, e, e, e
    return owner[heads], at[heads] - shard.starts[owner[heads]], np.diff(np.append(heads, len(at))), np.minimum.reduceat(first[at], heads)


def repeats(documents: DataFrame, search: Callable[[Shard], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): the longest runs of words of each document whose grams all stand in other documents too.

    Words are runs of bytes other than ASCII white space, counted from 0; end_word is one past the last.
    first_doc is the smallest doc_id that holds one of the run's grams: where it is doc_id itself, this is
    the copy to keep. Grams that only one document repeats are none. Rows of one doc_id are one document,
    and so are all rows of a null doc_id, which comes before all others and is given as null. Null texts and
    those of fewer words have no rows. Other columns are neither read nor returned. search takes a shard and
    gives, for every position of its text, whether the gram there stands in two documents, and its first_doc.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc"), F.hash("text").alias("t"), "text").where("text is not null")
    # DISK_ONLY: two stages read these some 50 bytes a segment; a lost executor's part is computed again.
    found = docs.mapInArrow(_located, "doc long, t int, s int, n int, v long, a long, b long").persist(StorageLevel.DISK_ONLY)
    shared = found.groupBy("v").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("v")
    alike = written(found.join(shared, "v", "left_semi"))
    found.unpersist()
    texts = written(alike.groupBy("a", "b").agg(F.min("v").alias("v"), F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    known = texts.join(texts.groupBy("v").agg(F.count("*").alias("texts")), "v")
    places = written(alike.drop("v").join(known, ["a", "b"]))
    many = places.where("texts > 1").drop("texts")
    wanted = many.dropDuplicates(["a", "b"]).groupBy("doc", "t").agg(F.collect_list(F.struct("s", "n", "v", "a", "b", "lo", "hi")).alias("segments"))
    cut = docs.join(wanted, ["doc", "t"]).select("text", "segments").mapInArrow(_cut, "v long, a long, b long, lo long, hi long, seg binary")
    cut = written(cut.dropDuplicates(["a", "b"]))  # repeated rows of one text give its segments again
    sizes = cut.groupBy("v").agg(F.sum(F.length("seg")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    hot = sizes.where(F.col("bytes") > HOT_BYTES)
    shards = -(-total // SHARD_BYTES) or 1

    def searched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard = Shard(table["seg"].combine_chunks(), table["lo"].to_numpy(), table["hi"].to_numpy())
        owner, i, m, first = flagged(shard, *search(shard))
        at = pa.array(owner)
        return pa.table({"a": table["a"].take(at), "b": table["b"].take(at), "i": i.astype(np.int32), "m": m.astype(np.int32), "first_doc": first})

    schema = "a long, b long, i int, m int, first_doc long"
    common, parts = cut, []
    if not hot.isEmpty():
        common, crowded = cut.join(hot, "v", "left_anti"), cut.join(hot, "v", "left_semi")
        grams = written(crowded.mapInArrow(_grams, "a long, b long, i int, lo long, hi long, g long, h long"))
        twice = grams.groupBy("g", "h").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
        parts.append(grams.join(twice, ["g", "h"]).select("a", "b", "i", F.lit(1).alias("m"), "first_doc"))
    parts.append(common.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).groupBy("shard").applyInArrow(searched, schema))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    span = lambda df, i, m: df.select("doc", "t", (F.col("s") + i).alias("x"), (F.col("s") + i + m - 1 + MIN_WORDS).alias("y"), "first_doc")
    placed = span(places.where("texts = 1").withColumn("first_doc", F.col("lo")), F.lit(0), F.col("n"))
    placed = placed.unionByName(span(many.select("a", "b", "doc", "t", "s").join(hits, ["a", "b"]), F.col("i"), F.col("m")))
    order = Window.partitionBy("doc", "t").orderBy("x", "y")
    new = F.coalesce(F.col("x") > F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = placed.withColumn("new", new).withColumn("island", island).groupBy("doc", "t", "island").agg(F.min("x").alias("start_word"), F.max("y").alias("end_word"), F.min("first_doc").alias("first_doc"))
    return merged.select(F.nullif("doc", F.lit(NOBODY)).alias("doc_id"), "start_word", "end_word", F.nullif("first_doc", F.lit(NOBODY)).alias("first_doc"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each gram of segments."""
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch.column("seg").cast(pa.large_binary()).cast(pa.large_string()), 1 << 18):
            starts, ends, first = T.words(data, offsets)
            h = T.word_hashes(data, starts, ends)
            n = np.diff(first) - MIN_WORDS + 1
            g, k = np.zeros(max(0, len(h) - MIN_WORDS + 1), T.U64), np.zeros(max(0, len(h) - MIN_WORDS + 1), T.U64)
            for j in range(MIN_WORDS):
                x = h[j : j + len(g)]
                g, k = T.mix(g * C + x), T.mix(k * C + T.mix(x + C))
            at, rows = T.ragged(first[:-1], n), pa.array(np.repeat(np.arange(lo, hi), n))
            yield pa.record_batch({**{c: batch.column(c).take(rows) for c in ("a", "b")}, "i": pa.array(T.ragged(np.zeros(hi - lo, I64), n).astype(np.int32)), **{c: batch.column(c).take(rows) for c in ("lo", "hi")}, "g": pa.array(g[at].view(I64)), "h": pa.array(k[at].view(I64))})
