"""op2: exact nearest neighbours of query vectors among all vectors, by multi-resolution segment statistics.

Cut into segments, two vectors x and y are at least sqrt(sum of length * ((mean x - mean y)**2 + (deviation x -
deviation y)**2)) apart. The bound over one segment, then 2, 4 and so on, drops a candidate as soon as it
exceeds the k-th smallest distance known; what survives is measured exactly. The known distances start with
those of the candidates of the lowest bounds, so the result is that of brute force, ties by id.

The queries of the registered query are the rows whose vec_id is divisible by EVERY, against all rows.
Blocks of queries meet blocks of rows, QUERY_BLOCK and ROW_BLOCK of them, so that no task holds more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 10
EVERY = 100
QUERY_BLOCK = 2048
ROW_BLOCK = 16384
CHUNK = 128
SLACK = 1e-9

ORACLE = f"""
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
WHERE rank <= {K}"""


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of their lengths: their Euclidean distance is the bound."""
    cuts = np.arange(segments + 1) * x.shape[1] // segments
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(out, axis=1)


def _levels(size: int) -> list[int]:
    """Segments of each resolution, coarse to fine; two values or more in a segment."""
    return [1 << k for k in range(max(1, size.bit_length())) if (1 << k) * 2 <= size] or ([1] if size else [])


def top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, distance) of the k nearest candidates of another id, ties by id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    levels = _levels(q.shape[1])
    coarse = [(statistics(q, n), statistics(c, n)) for n in levels]
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(q), CHUNK):
        ids, own = q_ids[lo : lo + CHUNK], q[lo : lo + CHUNK]
        alive = ids[:, None] != c_ids[None, :]
        known = np.full(len(ids), np.inf)
        for (a, b), last in zip(coarse, [*[False] * (len(levels) - 1), True]):
            a = a[lo : lo + CHUNK]
            if alive.mean() > 0.05:
                bound = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
                bound[~alive] = np.inf
            else:
                bound = np.full(alive.shape, np.inf)
                i, j = np.nonzero(alive)
                bound[i, j] = ((a[i] - b[j]) ** 2).sum(1)
            if alive.shape[1] > k:
                likely = np.argpartition(bound, k - 1, axis=1)[:, :k]
                exact = ((own[:, None, :] - c[likely]) ** 2).sum(2)
                exact[~np.take_along_axis(alive, likely, 1)] = np.inf
                known = np.minimum(known, exact.max(1))
            limit = np.where(np.isfinite(known), known, np.inf)
            scale = (a * a).sum(1) + (b * b).sum(1).max(initial=0)
            alive &= bound <= (limit + SLACK * (1 + scale))[:, None]
        i, j = np.nonzero(alive)
        distance = np.concatenate([np.zeros(0), *(np.sqrt(((own[i[s : s + 16384]] - c[j[s : s + 16384]]) ** 2).sum(1)) for s in range(0, len(i), 16384))])
        best = np.lexsort((c_ids[j], distance, i))
        i, j, distance = i[best], j[best], distance[best]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((ids[i[keep]], c_ids[j[keep]], distance[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(t: pa.Table) -> np.ndarray:
    column = t["embedding"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cell(left: pa.Table, right: pa.Table) -> pa.Table:
    a, b, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if left.num_rows and right.num_rows:
        a, b, d = top_k(left["vec_id"].to_numpy(), _matrix(left), right["vec_id"].to_numpy(), _matrix(right))
    return pa.table({"vec_id": a, "neighbor_id": b, "d": d})


def nearest(queries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the K nearest rows of another vec_id of every query, both (vec_id, embedding).

    Rows without vec_id or embedding, and those with a null in it, are left out on either side; vectors are
    compared to those of their own length only. Repeated rows each count as candidates; repeated queries are
    one query. Fewer than K others give fewer rows. Other columns are neither read nor returned.
    """
    usable = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)"
    columns = [F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("n")]
    left, right = queries.where(usable).select(*columns).dropDuplicates(["vec_id", "embedding"]), embeddings.where(usable).select(*columns)
    wide, high = (-(-x.count() // n) or 1 for x, n in ((left, QUERY_BLOCK), (right, ROW_BLOCK)))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = left.select("*", place(wide).alias("q"), every(high).alias("c")), right.select("*", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(high)).cast("int").alias("c"), every(wide).alias("q"))
    found = left.groupBy("q", "c", "n").cogroup(right.groupBy("q", "c", "n")).applyInArrow(_cell, "vec_id long, neighbor_id long, d double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= K).select("vec_id", "rank", "neighbor_id", F.round("d", 6).alias("distance"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table.where(F.pmod("vec_id", F.lit(EVERY)) == 0), table)
