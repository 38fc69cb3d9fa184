import hashlib

import pytest
from pyspark.sql import functions as F

from loomkv import storage


def test_checksum(spark):
    df = spark.createDataFrame([(1, "x", hashlib.sha256(b"x").hexdigest().upper()), (2, "", "00"), (3, None, None)], "id int, text string, want string")
    got = df.select(storage.checksum(F.col("text")).alias("c"), storage.verified(F.col("text"), F.col("want")).alias("ok")).collect()
    assert got[0].c == hashlib.sha256(b"x").hexdigest() and [r.ok for r in got] == [True, False, False] and got[2].c is None


def test_splits(spark):
    df = spark.createDataFrame([("a", 10), ("b", 4), ("c", 0), ("d", 8)], "id string, bytes long")
    got = sorted(tuple(r) for r in storage.splits(df, 4).collect())
    assert got == [("a", 0, 0, 4), ("a", 1, 4, 4), ("a", 2, 8, 2), ("b", 0, 0, 4), ("d", 0, 0, 4), ("d", 1, 4, 4)]


@pytest.mark.parametrize("size", [1, 5, 6, 7, 100])
def test_any_one_lost_shard_comes_back(size):
    data = bytes((7 * k + 3) % 256 for k in range(size))
    n = -(-size // 6)
    shards = [data.ljust(6 * n, b"\0")[k * n : k * n + n] for k in range(6)]
    p = storage.parity(data)
    for lost in range(6):
        assert storage.restored([None if k == lost else s for k, s in enumerate(shards)], p, size) == data
    assert storage.restored(shards, None, size) == data
    with pytest.raises(ValueError):
        storage.restored([None, None, *shards[2:]], p, size)
    with pytest.raises(ValueError):
        storage.restored([None, *shards[1:]], None, size)
    with pytest.raises(ValueError):
        storage.parity(b"")


def test_parity_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "abcdef")], "doc_id long, text string")
    assert {r.doc_id: r.parity for r in storage.with_parity(df).collect()} == {1: None, 2: None, None: "07"}
