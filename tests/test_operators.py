import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomkv import plans, sources
from loomkv.__main__ import main
from loomkv.functions import fnv1a32
from loomkv.operators import jobs
from loomkv.operators.keyed import KeyedFrame


def files(path):
    return sorted(p for p in path.iterdir() if p.name.startswith("part-"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_map_filter_flat_map(spark):
    kf = KeyedFrame.from_lines(spark, ["hello world", "go", ""], 2)
    assert kf.collect() == [("0", "hello world"), ("2", ""), ("1", "go")]
    words = kf.flat_map(lambda k, v: F.transform(F.filter(F.split(v, " "), lambda w: w != ""), lambda w: F.struct(w.alias("key"), k.alias("value"))))
    assert rows(words.df.select("key", "value")) == [("go", "1"), ("hello", "0"), ("world", "0")]
    assert rows(words.map(lambda k, v: (F.upper(k), v)).filter(lambda k, v: v == "0").df.select("key", "value")) == [("HELLO", "0"), ("WORLD", "0")]
    same = kf.flat_map_py(lambda k, v: [(w, k) for w in v.split()]).map_py(lambda k, v: (k.upper(), v))
    assert rows(same.df.select("key", "value")) == [("GO", "1"), ("HELLO", "0"), ("WORLD", "0")]


def test_reduce_by_key(spark):
    kf = KeyedFrame.from_rows(spark, [("a", "2"), ("b", "6"), ("a", "7"), ("c", "raw")], 2)
    numbers = kf.filter(lambda k, v: k != "c")
    assert rows(numbers.reduce_by_key("sum").df) == [("a", 9), ("b", 6)]
    assert rows(numbers.reduce_by_key("count").df) == [("a", 2), ("b", 1)]
    assert rows(kf.reduce_by_key("min").df) == [("a", "2"), ("b", "6"), ("c", "raw")]
    assert rows(kf.reduce_by_key("first").df) == [("a", "2"), ("b", "6"), ("c", "raw")]
    assert rows(kf.reduce_by_key("last").df) == [("a", "7"), ("b", "6"), ("c", "raw")]
    joined = [("a", "2+7"), ("b", "6"), ("c", "raw")]
    assert rows(kf.reduce_by_key(lambda a, b: F.concat(a, F.lit("+"), b)).df) == joined
    assert rows(kf.reduce_by_key_py(lambda a, b: f"{a}+{b}").df) == joined
    with pytest.raises(ValueError):
        kf.reduce_by_key("median")
    with pytest.raises(ValueError):
        KeyedFrame(kf.df).reduce_by_key("first")


def test_order_is_by_partition_then_place(spark):
    kf = KeyedFrame.from_rows(spark, [("k", str(i)) for i in range(7)], 3)
    assert kf.group_by_key().collect() == [("k", "0,3,6,1,4,2,5")]
    assert kf.group_values().first()["values"] == ["0", "3", "6", "1", "4", "2", "5"]
    placed = kf.df.select("value", F.spark_partition_id().alias("p")).collect()
    assert all(int(r.value) % 3 == r.p for r in placed)


def test_group_and_count_by_key(spark):
    kf = KeyedFrame.from_rows(spark, [("color", "red"), ("size", "large"), ("color", "blue")], 1)
    assert sorted(kf.group_by_key().collect()) == [("color", "red,blue"), ("size", "large")]
    assert rows(kf.count_by_key()) == [("color", 2), ("size", 1)] and kf.count() == 3
    assert [r.key for r in kf.sorted_keys().collect()] == ["color", "size"]


def test_empty_and_many(spark):
    none = KeyedFrame.from_rows(spark, [], 3)
    assert none.count() == 0 and none.collect() == [] and none.reduce_by_key("sum").count() == 0
    many = KeyedFrame.from_rows(spark, ((f"key-{i % 100:03d}", "1") for i in range(10_000)), 4)
    assert rows(many.reduce_by_key("sum").df) == [(f"key-{i:03d}", 100) for i in range(100)]


def test_registries():
    assert jobs.get_mapper("wordcount") is jobs.map_words and jobs.get_reducer("sum") is jobs.get_reducer("sumbykey") and jobs.get_combiner("") is None
    for get in (jobs.get_mapper, jobs.get_reducer, jobs.get_combiner):
        with pytest.raises(ValueError, match="unknown"):
            get("nothing")


def test_sums_skip_what_is_no_integer_and_keep_the_key(spark):
    df = spark.createDataFrame([("a", "+7"), ("a", "1.5"), ("b", " 1"), ("c", "9223372036854775807")], "key string, value string")
    assert rows(jobs.reduce_sum(df)) == [("a", "7"), ("b", "0"), ("c", "9223372036854775807")]
    with pytest.raises(Exception, match="(?i)overflow"):
        jobs.reduce_sum(df.union(spark.createDataFrame([("c", "1")], df.schema))).collect()


def test_word_count_job_against_one_loop(spark, tmp_path):
    random.seed(42)
    words = "the quick brown fox jumps over lazy dog data (node) Block, don't".split()
    text = "\n".join(" ".join(random.choices(words, k=random.randint(5, 14))) for _ in range(3000))
    (tmp_path / "in").write_text(text)
    want = Counter(w for w in (x.strip(".,!?;:\"'()[]{}").lower() for x in text.split()) if w)
    assert main(["--job", "wordcount", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--num-reducers", "1"]) == 0
    (part,) = files(tmp_path / "out")
    got = [line.split("\t") for line in part.read_text().splitlines()]
    assert {k: int(v) for k, v in got} == want and [k for k, _ in got] == sorted(want)


def test_sum_job_with_two_reducers(spark, tmp_path):
    keys = ["distributed", "hadoop", "namenode", "computing", "datanode", "mapreduce"]
    (tmp_path / "in").write_text("".join(f"{k}\t{v}\n" for v in range(1, 6) for k in keys) + "no tab\n")
    jobs.run_job(spark, "sumbykey", str(tmp_path / "in"), str(tmp_path / "out"), 2)
    parts = [p.read_text().split("\n")[:-1] for p in files(tmp_path / "out")]
    assert parts == [[f"{k}\t15" for k in sorted(keys[:3])], [f"{k}\t15" for k in sorted(keys[3:])]]


def test_identity_job_orders_offsets_as_strings(spark, tmp_path):
    (tmp_path / "in").write_text("abcdefgh\nx\ny\n" + "z" * 100 + "\nw\n")
    jobs.run_job(spark, "identity", str(tmp_path / "in"), str(tmp_path / "out"), 1, "gzip")
    got = rows(sources.read_kv(sources.text_lines(spark, str(tmp_path / "out"))))
    assert got == [("0", "abcdefgh"), ("11", "y"), ("114", "w"), ("13", "z" * 100), ("9", "x")]


def test_unknown_job(spark, tmp_path, capsys):
    assert main(["--job", "sort", "--input", "x", "--output", str(tmp_path / "out")]) == 1 and "unknown mapper" in capsys.readouterr().err


def test_partitions_hold_all_rows_sorted(spark):
    df = spark.range(5000).select(F.concat(F.lit("é"), F.col("id") % 700).alias("key"), F.col("id").cast("string").alias("value"))
    got = jobs.partitioned(df, 5).select("key", "value", F.spark_partition_id().alias("p"), fnv1a32("key").alias("h")).collect()
    assert len(got) == 5000 and all(r.h % 5 == r.p for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.p].append(r.key)
    assert all(keys == sorted(keys) for keys in by.values())


def test_one_shuffle_with_partial_sums(spark):
    from loomkv.catalogue import QUERIES

    for name in ("mr_wordcount", "mr_combiner_two_level", "rdd_reduce_by_key_sum", "rdd_reduce_by_key_first", "rdd_count_by_key"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert plans.exchanges(df) == ["hashpartitioning"] and plans.partial_aggregates(df) == 1, name
        assert plans.stages(df) == [{"id": 0, "shuffle": True}, {"id": 1, "shuffle": False}]
    assert plans.exchanges(QUERIES["rdd_filter"](spark, "/root/testdata/sf0.001")) == []
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plans.physical(QUERIES["rdd_filter"](spark, "/root/testdata/sf0.001"))
    for name in ("rdd_round_robin", "rdd_from_lines", "mr_identity_offsets"):
        assert "hashpartitioning" in plans.exchanges(QUERIES[name](spark, "/root/testdata/sf0.001"))
