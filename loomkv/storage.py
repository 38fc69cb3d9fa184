"""Functions of the block store that are of use on tables: checksums, splits and parity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_SHARDS = 6


def checksum(data: Column) -> Column:
    """SHA-256 of text or bytes, in hexadecimal."""
    return F.sha2(data, 256)


def verified(data: Column, expected: Column) -> Column:
    """Whether the checksum is the expected one, in either case of letters; false if either is null."""
    return F.coalesce(checksum(data) == F.lower(expected), F.lit(False))


def splits(sizes: DataFrame, block: int) -> DataFrame:
    """(id, block, offset, length) of rows (id, bytes): consecutive blocks, the last one shorter; a file of no bytes has none."""
    n = F.ceil(F.col("bytes") / F.lit(block)).cast("int")
    rows = sizes.where("bytes > 0").select("id", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    offset = F.col("block").cast("long") * block
    return rows.select("id", "block", offset.alias("offset"), F.least(F.lit(block).cast("long"), F.col("bytes") - offset).alias("length"))


def parity(data: bytes, shards: int = DATA_SHARDS) -> bytes:
    """The exclusive or of the shards into which data is cut, the last padded with zeros."""
    if not data:
        raise ValueError("no data to encode")
    size = -(-len(data) // shards)
    return np.bitwise_xor.reduce(np.frombuffer(data.ljust(size * shards, b"\0"), np.uint8).reshape(shards, size)).tobytes()


def restored(shards: list[bytes | None], parity_shard: bytes | None, size: int) -> bytes:
    """The data of size bytes from its shards, of which one at most may be lost."""
    lost = [k for k, s in enumerate(shards) if s is None]
    if len(lost) > 1 or (lost and parity_shard is None):
        raise ValueError(f"shards {lost} cannot be rebuilt")
    if lost:
        rows = [np.frombuffer(s, np.uint8) for s in (*shards, parity_shard) if s is not None]
        shards = [np.bitwise_xor.reduce(rows).tobytes() if s is None else s for s in shards]
    return b"".join(shards)[:size]


def with_parity(documents: DataFrame) -> DataFrame:
    """(doc_id, parity) in hexadecimal; null for null and empty texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parity(t.encode()).hex() if t else None for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "parity": pa.array(made, pa.string())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, parity string")
