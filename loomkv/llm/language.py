"""op8: the language of every document, by cross-parsing against a suffix automaton per language.

Each language's automaton holds TRAIN_BYTES of labelled text. A document, in windows of WINDOW bytes, is
cut greedily into the longest phrases that occur in that text; the language that needs the fewest
phrases a byte wins, ties by name. All windows of a slice advance one byte at a time together, so that
a step over all of them is one gather from a transition table.

Letters count in lower case; whatever is no letter counts as a space. A text without any letter (null
and empty ones too) has no language. A text is rejected if it has none, or if even the best language
of each window, so that a text in two languages is none to reject, needs over MOST_RATE phrases a byte
and FREE phrases more: its phrases then are as short as those of random letters. FREE keeps short texts,
where a few odd words prove nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkv.llm import text as T

TRAIN_BYTES = 16384
TRAIN_ROWS = 64
MOST_LANGUAGES = 256
WINDOW = 256
SLICE = 1 << 23
MOST_RATE = 0.33
FREE = 8
STAY = 63
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:192] = 27 + np.arange(64) % 34
SYMBOL[192:256] = 61
SYMBOL[0xC3], SYMBOL[0xC4] = 62, 60


def symbols(data: np.ndarray) -> np.ndarray:
    return SYMBOL[data]


def automaton(train: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence of symbols below STAY, 64 for each state.

    An entry is 64 times the next state, or where there is none, that of the start state plus one: the
    phrase ends and the symbol begins the next one. A symbol that never occurs is a phrase of its own: it
    leads to the last state, from which every symbol begins the next.
    """
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in train.tolist():
        cur = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    start = np.full(64, len(following) * 64, np.int32)
    following.append({})
    for c, to in following[0].items():
        start[c] = to * 64
    table = np.tile(start | 1, (len(following), 1))
    for state, edges in enumerate(following):
        for c, to in edges.items():
            table[state, c] = to * 64
    table[0] = start
    table[:, STAY] = np.arange(len(following), dtype=np.int32) * 64
    return np.ascontiguousarray(table.ravel())


def phrases(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each row for each table, and for the best table of each of its windows; no phrase crosses the end of a window."""
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    first = np.cumsum(windows) - windows
    out = np.zeros((len(sizes), len(tables)), np.int64)
    fewest = np.zeros(len(sizes), np.int64)
    if not windows.sum():
        return out, fewest
    starts = offsets[:-1].repeat(windows) + T.ragged(np.zeros(len(sizes), np.int64), windows) * WINDOW
    ends = np.minimum(starts + WINDOW, offsets[1:].repeat(windows))
    padded = np.concatenate([symbols(data), np.full(WINDOW, STAY, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]
    short = np.flatnonzero(ends - starts < WINDOW)
    lanes[short] = np.where(np.arange(WINDOW) < (ends - starts)[short, None], lanes[short], STAY)
    lanes = np.ascontiguousarray(lanes.T)
    rows, least = np.flatnonzero(windows), np.full(len(starts), WINDOW, np.int32)
    for k, table in enumerate(tables):
        state, count = np.zeros(len(starts), np.int32), np.ones(len(starts), np.int32)
        for step in lanes:
            state &= -64
            state |= step
            np.take(table, state, out=state, mode="clip")
            count += state & 1
        out[rows, k] = np.add.reduceat(count, first[rows])
        least = np.minimum(least, count)
    fewest[rows] = np.add.reduceat(least, first[rows])
    return out, fewest


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def judge(column: pa.Array, names: list[str], tables: list[np.ndarray]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """The language of each text, or None; its phrases a byte; whether it is accepted."""
    found: list[str | None] = []
    rates, good = [], []
    for lo, hi, data, offsets in T.slices(lowered(column), SLICE):
        (counts, fewest), sizes = phrases(data, offsets, tables), np.diff(offsets)
        letters, full = np.zeros(hi - lo, bool), np.flatnonzero(sizes)
        if len(full) and names:
            letters[full] = np.logical_or.reduceat(SYMBOL[data] > 0, offsets[full])
        best = counts.argmin(axis=1) if names else np.zeros(hi - lo, np.int64)
        found += [names[k] if has else None for k, has in zip(best.tolist(), letters.tolist())]
        least = counts[np.arange(hi - lo), best] if names else sizes
        rates.append(np.where(letters, least / np.maximum(sizes, 1), 1.0))
        good.append(letters & (fewest <= MOST_RATE * sizes + FREE))
    return found, np.concatenate([np.zeros(0), *rates]), np.concatenate([np.zeros(0, bool), *good])


def models(labelled: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Automata of the languages that label rows with letters, from the TRAIN_ROWS rows a language of lowest hash of doc_id."""
    many = labelled.select("lang").distinct().count()
    if many > MOST_LANGUAGES:
        raise ValueError(f"{many} languages: over the {MOST_LANGUAGES} whose automata may be sent to each worker")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = labelled.where("lang is not null and doc_id is not null").select("lang", "doc_id").distinct().withColumn("rank", rank).where(F.col("rank") <= TRAIN_ROWS).drop("rank")
    rows = labelled.select("doc_id", "lang", F.substring("text", 1, TRAIN_BYTES).alias("text")).join(F.broadcast(ids), ["lang", "doc_id"])
    texts = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").toArrow()
    by: dict[str, bytes] = {}
    for lang, text in zip(texts["lang"].to_pylist(), lowered(texts["text"]).to_pylist() if texts.num_rows else []):
        by[lang] = by.get(lang, b"") + text.encode() + b" "
    usable = {k: s for k, v in sorted(by.items()) if (s := symbols(np.frombuffer(v[:TRAIN_BYTES], np.uint8))).any()}
    return list(usable), [automaton(s) for s in usable.values()]


def language(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, language, rate, accepted), one row for every row of documents, whole texts.

    labelled (doc_id, lang, text) defaults to documents; rows of it without lang, doc_id or letters teach
    nothing. A null or empty text and one without letters get a null language, rate 1 and accepted 0, and
    so do all texts if nothing is taught. A null doc_id stays null and repeated rows stay. Over
    MOST_LANGUAGES labels raise ValueError. Other columns are neither read nor returned.
    """
    names, tables = models(documents if labelled is None else labelled)
    sent = documents.sparkSession.sparkContext.broadcast((names, tables))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rate, good = judge(batch.column(1), *sent.value)
            yield pa.record_batch({"doc_id": batch.column(0), "language": pa.array(found, pa.string()), "rate": pa.array(np.round(rate, 6)), "accepted": pa.array(good.astype(np.int32))})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, language string, rate double, accepted int")


def accepted(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, n_chars) that language() accepts, with its language as lang."""
    sent = documents.sparkSession.sparkContext.broadcast(models(documents if labelled is None else labelled))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _, good = judge(batch.column(1), *sent.value)
            batch = batch.set_column(2, "lang", pa.array(found, batch.schema.field(2).type))
            yield batch.filter(pa.array(good))

    docs = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), "source", "n_chars")
    return docs.mapInArrow(rows, docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
