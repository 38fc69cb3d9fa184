import pytest
from pyspark.sql import functions as F

from loomkv import functions as fn


def values(spark, column, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    rows = ['"(Hello, world!)"', "don't -a- ...", "x y　z\u0085w\u000bv u", "", None, "Straße ÉTÉ", "ΣΑΣ İx", "[{a}]b;c:"]
    assert values(spark, fn.tokens(F.col("v")), rows) == [["hello", "world"], ["don't", "-a-"], ["x", "y", "z", "w", "v", "u"], [], None, ["straße", "été"], ["σασ", "ix"], ["a}]b;c"]]


def test_atoi(spark):
    rows = ["+7", "-3", " 12 ", "1.5", "1_0", "", "9" * 20, "1\t2", "9223372036854775807", "-9223372036854775808", "9223372036854775808", None, "0012", "٣", "7\n"]
    assert values(spark, fn.atoi(F.col("v")), rows) == [7, -3, None, None, None, None, None, None, 2**63 - 1, -(2**63), None, None, 12, None, None]


KEYS = ["", "a", "distributed", "hadoop", "namenode", "computing", "datanode", "mapreduce", "été", "漢字", "😀", "x" * 300]


def test_hashes_of_any_key(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    def poly(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & (2**64 - 1)
        return h >> 1

    assert values(spark, fn.fnv1a32("v"), KEYS) == [fnv(k) for k in KEYS]
    assert values(spark, fn.hash31("v"), KEYS) == [poly(k) for k in KEYS]
    assert values(spark, fn.partition_of(fn.fnv1a32("v"), 2), KEYS[2:8]) == [0, 0, 0, 1, 1, 1]
    assert values(spark, fn.partition_of(fn.fnv1a32("v"), 0), KEYS[:2]) == [0, 0]


def test_tabs(spark):
    rows = ["a\tb", "no tab", "\tx", "k\tv\tw", "", None, "k\t"]
    assert values(spark, fn.before_tab(F.col("v")), rows) == ["a", "no tab", "", "k", "", None, "k"]
    assert values(spark, fn.after_tab(F.col("v")), rows) == ["b", None, "x", "v\tw", None, None, ""]


@pytest.mark.parametrize("word,want", [("ABC", "abc"), ("ÀÉ", "àé"), ("Σ", "σ"), ("İ", "i")])
def test_simple_lower(spark, word, want):
    assert values(spark, fn.simple_lower(F.col("v")), [word]) == [want]
