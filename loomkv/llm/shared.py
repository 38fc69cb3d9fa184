"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; only where it names none, a new temporary one (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, which holds less than a checkpoint, and like one stays there for as long as the folder is kept.

    Its statistics are those of the files; a checkpoint keeps the estimate of its plan, and in a loop of joins that number's digits double each time."""
    df.write.parquet(at := at or fresh(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(at)


def deleted(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def partitions(spark: SparkSession, factor: int) -> Iterator[None]:
    """So many times the session's shuffle partitions, for actions inside that multiply their rows before a shuffle; AQE still joins small ones and splits skewed ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(int(before) * factor))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
