"""op5: toxicity of every document, by a factorization machine over its distinct hashed words.

Beside a weight each word has FACTORS factors, and every pair of words of a text adds the product of
theirs: so an insult together with a group that it is aimed at can weigh more than the two alone.

Training takes at most TRAIN_ROWS labelled documents, those of the lowest hash of doc_id, and of their words
those in MIN_DOCS of them or more whose toxic share is LEAST_Z standard deviations off the mean's, the
MOST_WORDS farthest off. The counts are taken by the workers, and only chosen words are collected: that
bounds the model that is sent to them. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm import text as T
from loomkv.llm.near_copies import PLAIN
from loomkv.llm.shared import checkpointed

TRAIN_ROWS = 8000
LEAST = 0.3
MIN_DOCS = 4
LEAST_Z = 4.0
MOST_WORDS = 50_000
FACTORS = 4
EPOCHS = 150
RATE = 0.1
FACTOR_RATE = 0.01
L2 = 1e-4


def features(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of each row, in order of both."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, T.U64)]
    for lo, hi, data, offsets in T.slices(pc.utf8_lower(column), 1 << 22):
        data = PLAIN[data]
        starts, ends, first = T.words(data, offsets)
        h, r = T.word_hashes(data, starts, ends), np.repeat(np.arange(lo, hi), np.diff(first))
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        rows.append(r[new])
        hashes.append(h[new])
    return np.concatenate(rows), np.concatenate(hashes)


def _forward(rows: np.ndarray, at: np.ndarray, n: int, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the sums of the factors of each row."""
    sums = np.stack([np.bincount(rows, v[at, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, (v[at] ** 2).sum(1), n)
    return w0 + np.bincount(rows, w[at], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(vocabulary: np.ndarray, rows: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(sorted word hashes, bias, weights, factors) by full-batch Adagrad on the logistic loss; text rows[k] has word vocabulary[at[k]]."""
    n = len(y)
    w0, w = 0.0, np.zeros(len(vocabulary))
    v = np.random.default_rng(42).normal(0, 0.01, (len(vocabulary), FACTORS))
    g0, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(EPOCHS):
        z, sums = _forward(rows, at, n, w0, w, v)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        d0, dw, dv = gradient(rows, at, e, sums, w, v)
        g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
        w0 -= RATE * d0 / np.sqrt(g0)
        w -= RATE * dw / np.sqrt(gw)
        v -= FACTOR_RATE * dv / np.sqrt(gv)
    return vocabulary, w0, w, v


def gradient(rows: np.ndarray, at: np.ndarray, e: np.ndarray, sums: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """By bias, weights and factors, of errors e of the rows, with the penalty L2."""
    dv = np.stack([np.bincount(at, e[rows] * (sums[rows, f] - v[at, f]), len(w)) for f in range(v.shape[1])], axis=1)
    return e.sum(), np.bincount(at, e[rows], len(w)) + L2 * w, dv + L2 * v


def score(column: pa.Array | pa.ChunkedArray, model: tuple[np.ndarray, float, np.ndarray, np.ndarray]) -> np.ndarray:
    vocabulary, w0, w, v = model
    rows, hashes = features(column)
    if not len(vocabulary):
        return np.full(len(column), 1 / (1 + np.exp(-w0)))
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    z, _ = _forward(rows[known], at[known], len(column), w0, w, v)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, hashes = features(pc.fill_null(batch.column(2), ""))
        at = pa.array(rows)
        yield pa.record_batch({"doc_id": batch.column(0).take(at), "toxic": batch.column(1).take(at), "h": pa.array(hashes.view(np.int64))})


def trained(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    chosen = checkpointed(chosen)  # TRAIN_ROWS small rows at most: the bound of both broadcasts
    y = chosen.join(documents.select(F.col("doc_id").cast("long").alias("id")).join(F.broadcast(chosen.select("id")), "id", "left_semi"), "id", "left_semi").orderBy("id").toPandas()
    if not len(y):
        return None
    n, share = len(y), float(y["toxic"].mean())
    words = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "toxic", "text").mapInArrow(_words, "doc_id long, toxic int, h long").distinct()
    words = checkpointed(words)
    z = (F.sum("toxic") - F.count("*") * share) / F.sqrt(F.greatest(F.count("*") * share * (1 - share), F.lit(1e-9)))
    telling = words.groupBy("h").agg(F.count("*").alias("n"), F.abs(z).alias("z")).where((F.col("n") >= MIN_DOCS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "h").limit(MOST_WORDS)
    found = words.join(telling.select("h"), "h").select("doc_id", "h").orderBy("doc_id", "h").toPandas()
    vocabulary, at = np.unique(found["h"].to_numpy().view(np.uint64), return_inverse=True)
    return fit(vocabulary, np.searchsorted(y["id"].to_numpy(), found["doc_id"].to_numpy()), at, y["toxic"].to_numpy().astype(float))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic), one row for every row of documents, whole texts.

    labels is (doc_id, toxic); of several labels of one doc_id the largest counts, nulls do not. If no
    document has one, score and toxic are null. Rows of one doc_id train as one text. A null text scores as
    the empty one, a null doc_id stays null, repeated rows stay. toxic is 1 from a score of LEAST on. Other columns are
    neither read nor returned.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trained(documents, labels))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                nothing = pa.nulls(batch.num_rows)
                yield pa.record_batch({"doc_id": batch.column(0), "score": nothing.cast(pa.float64()), "toxic": nothing.cast(pa.int32())})
                continue
            p = score(pc.fill_null(batch.column(1), ""), sent.value)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(np.round(p, 6)), "toxic": pa.array((p >= LEAST).astype(np.int32))})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double, toxic int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
