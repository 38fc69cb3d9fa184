"""op9: classes of near copies, by SimHash and meet-in-the-middle ball hashing.

A fingerprint has two halves of 64 bits: the signs of the sum, over a text's distinct words, of
square-root counts times bits of two hashes of the word. Words are runs of letters and digits in lower
case. Texts are linked if one of the halves differs in at most RADIUS bits and both together in at most
MOST. Halves within RADIUS = 8 bits differ by at most two in one of three blocks; there the balls of
radius one around the two meet in a middle, so every such pair is found by joining the 67 keys of each.
Colliding pairs are verified against the whole fingerprints. No bucket is capped.

Every join here has a merge hint: its sides grow with the input, and Spark's estimates of them are of explodes that
add no rows and of columns compressed in the cache or in Parquet, so that a broadcast could be more than the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm import text as T
from loomkv.llm.shared import checkpointed, deleted, fresh, partitions, written

RADIUS = 8
MOST = 18
BLOCKS = ((0, 22), (22, 21), (43, 21))
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
CHUNK = 1 << 15
#: Times the usual number of partitions for the balls, as each fingerprint becomes 134 rows.
GROWTH = 8
SLICE = 1 << 22
#: Pairs that a task of _stars() holds at once; and those that one task takes to its classes. Past these, stars come in parts and classes by rounds of joins.
HELD = 1 << 20
ONE_TASK = 1 << 21


def _signs(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    sums = np.zeros((n, 64), dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signed = (bits.astype(np.int32) * 2 - 1) * weights[k : k + CHUNK, None]
        heads = np.flatnonzero(np.append(True, rows[k : k + CHUNK][1:] != rows[k : k + CHUNK][:-1]))
        sums[rows[k : k + CHUNK][heads]] += np.add.reduceat(signed, heads, axis=0)
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(T.U64)


def fingerprints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Both halves, signed, of each row; a text without any word (null is the empty text) gets hashes of its bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    out = np.zeros((len(column), 2), dtype=T.U64)
    for lo, hi, _, _ in T.slices(column, SLICE):
        part = column.slice(lo, hi - lo)
        (_, _, raw, raw_offsets), (_, _, data, offsets) = next(T.slices(part, 1 << 60)), next(T.slices(pc.utf8_lower(part), 1 << 60))
        data = PLAIN[data]
        starts, ends, first = T.words(data, offsets)
        counts = np.diff(first)
        rows = np.repeat(np.arange(hi - lo), counts)
        hashes = T.word_hashes(data, starts, ends)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        weights = np.rint(256 * np.sqrt(np.diff(np.append(at, len(rows))))).astype(np.int32)
        hashes, rows = hashes[at], rows[at]
        bare = np.flatnonzero(counts == 0)
        whole = T.word_hashes(raw, raw_offsets[bare], raw_offsets[bare + 1])
        for half in range(2):
            fp = _signs(hashes, rows, weights, hi - lo)
            fp[bare] = whole
            out[lo:hi, half] = fp
            hashes, whole = T.mix(hashes + T.U64(0x9E3779B97F4A7C15)), T.mix(whole + T.U64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column(1))
        yield pa.record_batch({"doc_id": batch.column(0), "f": pa.array(fp[:, 0]), "g": pa.array(fp[:, 1])})


def _canonical(x: Column, own: Column, key: Column, half: int) -> Column:
    """Whether key is the one, of those that two fingerprints share in this half, that stands for the pair: in the first block
    that is near enough, the first one's own block changed in the lowest of two differing bits."""
    parts = [F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS]
    near = [F.bit_count(p) <= 2 for p in parts]
    block = F.when(near[0], 0).when(near[1], 1).otherwise(2)
    part = F.when(near[0], parts[0]).when(near[1], parts[1]).otherwise(parts[2])
    mine = F.when(near[0], F.shiftrightunsigned(own, 0).bitwiseAND(F.lit((1 << 22) - 1))).when(near[1], F.shiftrightunsigned(own, 22).bitwiseAND(F.lit((1 << 21) - 1))).otherwise(F.shiftrightunsigned(own, 43).bitwiseAND(F.lit((1 << 21) - 1)))
    low = F.when(F.bit_count(part) == 2, part.bitwiseAND(-part)).otherwise(F.lit(0))
    return key == mine.bitwiseXOR(low).bitwiseOR(F.shiftleft((block + 3 * half).cast("long"), 40))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): every linked pair, once and a < b, of the rows (c, f, g) of classes; no two rows have both halves equal."""
    keys = []
    for half, name in enumerate(("f", "g")):
        for b, (shift, width) in enumerate(BLOCKS):
            part = F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit((b + 3 * half) << 40))
            keys += [part, *(part.bitwiseXOR(F.lit(1 << i)) for i in range(width))]
    ball = classes.select("f", "g", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    a, b = ball.select("key", F.col("f").alias("fa"), F.col("g").alias("ga")), ball.select("key", F.col("f").alias("fb"), F.col("g").alias("gb"))
    x, y = F.col("fa").bitwiseXOR(F.col("fb")), F.col("ga").bitwiseXOR(F.col("gb"))
    df, dg = F.bit_count(x), F.bit_count(y)
    key = F.col("key")
    first = F.when(df <= RADIUS, _canonical(x, F.col("fa"), key, 0)).otherwise(_canonical(y, F.col("ga"), key, 1))
    less = (F.col("fa") < F.col("fb")) | ((F.col("fa") == F.col("fb")) & (F.col("ga") < F.col("gb")))
    found = a.hint("merge").join(b, "key").where((df + dg <= MOST) & (F.least(df, dg) <= RADIUS) & less & first).drop("key")
    with partitions(classes.sparkSession, GROWTH):
        found = checkpointed(found)
    ca, cb = (classes.select(F.col("c").alias(f"c{z}"), F.col("f").alias(f"f{z}"), F.col("g").alias(f"g{z}")) for z in "ab")
    return found.join(ca.hint("merge"), ["fa", "ga"]).join(cb.hint("merge"), ["fb", "gb"]).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the pairs, ascending, and for each the position of the smallest one that it is joined to by a chain of pairs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while ((up := label[label]) != label).any():
            label = up
        i, j = label[i], label[j]
        i, j = i[i != j], j[i != j]
    return nodes, label


def _pairs(a: np.ndarray, b: np.ndarray, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), CHUNK):
        yield pa.record_batch({names[0]: a[k : k + CHUNK], names[1]: b[k : k + CHUNK]})


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with the same classes as those given, and no more of them: each number with the least it is joined to here. One joined only to itself stays."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def least() -> tuple[np.ndarray, np.ndarray]:
        nodes, label = _least(*(np.concatenate(x) for x in zip(*held)))
        keep = (label != np.arange(len(nodes))) | (np.bincount(label, minlength=len(nodes)) == 1)
        return nodes[label[keep]], nodes[keep]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= HELD:
            held = [least()]
            if len(held[0][0]) >= HELD // 2:
                yield from _pairs(*held.pop(), ("a", "b"))
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    yield from _pairs(*least(), ("a", "b"))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if held:
        nodes, label = _least(*(np.concatenate(x) for x in zip(*held)))
        yield from _pairs(nodes, nodes[label], ("c", "class_id"))


def components(pairs: DataFrame) -> DataFrame:
    """(c, class_id) of every number in the pairs (a, b): the smallest number that it is joined to by a chain of pairs.

    Each task first makes stars of its pairs. Up to ONE_TASK of those go to one task, as each round of joins costs the
    driver a dozen jobs; more are joined in rounds."""
    spark, at = pairs.sparkSession, fresh(pairs.sparkSession)
    stars = written(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_stars, "a long, b long"), at)
    found = written(stars.coalesce(1).mapInArrow(_classes, "c long, class_id long")) if stars.count() <= ONE_TASK else _by_rounds(stars)
    deleted(spark, at)
    return found


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """components() of any number of pairs.

    Labels fall to the smallest of the neighbours' and then to their label's label, and what was a number's label falls with
    it, until none changes; without the last, rounds would be as many as a long chain in no order has links."""
    spark, at = pairs.sparkSession, fresh(pairs.sparkSession)
    both = pairs.select(F.col("a").alias("c"), F.col("b").alias("d")).unionByName(pairs.select(F.col("b").alias("c"), F.col("a").alias("d")))
    labels = written(both.groupBy("c").agg(F.least("c", F.min("d")).alias("l")), at)
    while True:
        near = both.hint("merge").join(labels.select(F.col("c").alias("d"), "l"), "d").groupBy("c").agg(F.min("l").alias("m"))
        fell = labels.hint("merge").join(near, "c").select("c", F.least("l", "m").alias("m"), F.col("l").alias("old"))
        up = labels.select(F.col("c").alias("m"), F.col("l").alias("up"))
        own = F.struct("c", F.least("m", "up").alias("l"), "old")
        hook = F.struct(F.col("old").alias("c"), F.least("m", "up").alias("l"), F.lit(None).cast("long").alias("old"))
        jumped = fell.hint("merge").join(up, "m").select(F.explode(F.array(own, hook)).alias("x")).groupBy("x.c").agg(F.min("x.l").alias("l"), F.max("x.old").alias("old"))
        before, at = at, fresh(spark)
        jumped = written(jumped, at)
        deleted(spark, before)
        labels = jumped.select("c", "l")
        if jumped.where("l <> old").isEmpty():
            return labels.withColumnRenamed("l", "class_id")


def near_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, links), one row for every row of documents.

    Rows of equal fingerprints are copies of one text; links counts the other texts that this one is
    linked to, and class_id is the smallest doc_id that a chain of links or copies leads to. A row alone
    has its own doc_id and links 0. Null and empty texts are copies of each other; a text without letters
    and digits is a copy only of the same bytes. A null doc_id stays null and is no class_id unless all
    of its class are null. Repeated rows stay. Other columns are neither read nor returned.
    """
    # DISK_ONLY: three later stages read these 24 bytes a row; a lost executor's part is computed again.
    from pyspark import StorageLevel

    fps = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, "doc_id long, f long, g long").persist(StorageLevel.DISK_ONLY)
    # Spread and cut here, so that the balls, 134 rows of each, are made by many tasks and shuffled once for both sides.
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = checkpointed(fps.groupBy("f", "g").agg(F.min("doc_id").alias("c")).repartition(spread, "c"))
    pairs = checkpointed(links(classes.where("c is not null")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    found = classes.hint("merge").join(ends.hint("merge").join(components(pairs), "c"), "c", "left").select("f", "g", F.coalesce("class_id", "c").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return fps.hint("merge").join(found, ["f", "g"]).select("doc_id", "class_id", "links")


def unique(documents: DataFrame) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, n_chars) whose doc_id is the class_id of near_copies(): one of each class.

    Rows of one doc_id are one document, and one of them stays. Rows of a null doc_id stay, less exact repeats of their text.
    """
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    kept = near_copies(docs.where("doc_id is not null")).where("doc_id = class_id").select("doc_id")
    return docs.hint("merge").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
