"""Readers and writers of lines and of tab-separated keys and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.functions import after_tab, before_tab

CODECS = {"": "none", "none": "none", "gzip": "gzip"}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files: cut at line feeds only, one carriage return before them dropped; blank lines are rows."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("line"))


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): each line under its byte offset in its file, a decimal string. Offsets are true ones in files with carriage returns too."""
    formats = ("org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    pairs = spark.sparkContext.newAPIHadoopFile(path, *formats, conf={"textinputformat.record.delimiter": "\n"})
    rows = spark.createDataFrame(pairs, "offset long, value string")
    return rows.select(F.col("offset").cast("string").alias("key"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def read_kv(lines: DataFrame) -> DataFrame:
    """(key, value) of (line), cut at the first tab; lines without one are dropped. Columns beside line stay."""
    rest = [c for c in lines.columns if c not in ("line", "key", "value")]
    return lines.where(F.instr("line", "\t") > 0).select(*rest, before_tab(F.col("line")).alias("key"), after_tab(F.col("line")).alias("value"))


def parse_line(lines: DataFrame) -> DataFrame:
    """(key, value) of (line), cut at the first tab; a line without one is a key with the empty value. A null line stays null."""
    rest = [c for c in lines.columns if c not in ("line", "key", "value")]
    value = F.when(F.col("line").isNotNull(), F.coalesce(after_tab(F.col("line")), F.lit("")))
    return lines.select(*rest, before_tab(F.col("line")).alias("key"), value.alias("value"))


def last_wins(lines: DataFrame, order: str) -> DataFrame:
    """(key, value) of (line, order): the value that comes last for each key. Partial maxima meet, not lists of values."""
    return read_kv(lines).groupBy("key").agg(F.max_by("value", order).alias("value"))


def formatted(rows: DataFrame) -> DataFrame:
    """(line) of (key, value): key, tab, value, as they are; nulls write as nothing."""
    return rows.select(F.concat(F.coalesce("key", F.lit("")), F.lit("\t"), F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("line"))


def write_lines(rows: DataFrame, path: str, codec: str = "", mode: str = "overwrite") -> None:
    """Writes (key, value) as lines, one file a partition; codec is none or gzip."""
    if codec not in CODECS:
        raise ValueError(f"unknown compression codec: {codec}")
    formatted(rows).write.mode(mode).option("lineSep", "\n").option("compression", CODECS[codec]).text(path)
