"""Named jobs over lines: a mapper, maybe a combiner, a reducer and a number of reducers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv import sources
from loomkv.functions import atoi, fnv1a32, partition_of, words


def map_words(records: DataFrame) -> DataFrame:
    return words(records, "value", "key").select("key", F.lit("1").alias("value"))


def map_kv(records: DataFrame) -> DataFrame:
    return sources.read_kv(records.select(F.col("value").alias("line")))


def map_identity(records: DataFrame) -> DataFrame:
    return records.select("key", "value")


def reduce_sum(pairs: DataFrame) -> DataFrame:
    """(key, value): the sum, as a string, of the values that are integers; 0 for a key without any. A sum beyond 64 bits raises.

    The optimizer sums before the shuffle too, which is what a combiner is for.
    """
    return pairs.groupBy("key").agg(F.coalesce(F.sum(atoi(F.col("value"))), F.lit(0)).cast("string").alias("value"))


def reduce_identity(pairs: DataFrame) -> DataFrame:
    return pairs.select("key", "value")


Step = Callable[[DataFrame], DataFrame]
MAPPERS: dict[str, Step] = {"wordcount": map_words, "sumbykey": map_kv, "identity": map_identity}
REDUCERS: dict[str, Step] = {"sum": reduce_sum, "wordcount": reduce_sum, "sumbykey": reduce_sum, "identity": reduce_identity}
COMBINERS: dict[str, Step | None] = {"": None, "sum": reduce_sum, "wordcount": reduce_sum, "sumbykey": reduce_sum}


def _named(kind: str, table: dict, name: str):
    if name not in table:
        raise ValueError(f"unknown {kind}: {name}")
    return table[name]


def get_mapper(name: str) -> Step:
    return _named("mapper", MAPPERS, name)


def get_reducer(name: str) -> Step:
    return _named("reducer", REDUCERS, name)


def get_combiner(name: str) -> Step | None:
    """None for the empty name."""
    return _named("combiner", COMBINERS, name)


def partitioned(pairs: DataFrame, n: int) -> DataFrame:
    """Rows in n partitions by the FNV-1a hash of their keys, each sorted by key."""
    part = partition_of(fnv1a32("key"), n)
    return pairs.withColumn("part", part).repartitionById(max(1, n), F.col("part")).sortWithinPartitions("part", "key").drop("part")


def run(records: DataFrame, mapper: str, reducer: str) -> DataFrame:
    return get_reducer(reducer)(get_mapper(mapper)(records))


def run_job(spark: SparkSession, job: str, path: str, output: str, num_reducers: int = 1, codec: str = "") -> None:
    """Runs a job over text files and writes one file, sorted by key, for each of num_reducers partitions. Job names are those of mappers."""
    mapper, reducer = get_mapper(job), get_reducer(job)
    records = sources.text_records(spark, path) if job == "identity" else sources.text_lines(spark, path).select(F.lit("").alias("key"), F.col("line").alias("value"))
    sources.write_lines(partitioned(reducer(mapper(records)), num_reducers), output, codec)
