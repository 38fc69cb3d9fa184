import gzip

import pytest
from pyspark.sql import functions as F

from loomkv import sources
from loomkv.operators import order


def files(path):
    return sorted(p for p in path.iterdir() if p.name.startswith("part-"))


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\r\n\nlone\rcr\nlast\r")
    assert [r.line for r in sources.text_lines(spark, str(tmp_path / "a")).collect()] == ["one", "", "lone\rcr", "last"]
    got = sorted((int(r.key), r.value) for r in sources.text_records(spark, str(tmp_path / "a")).collect())
    assert got == [(0, "one"), (5, ""), (6, "lone\rcr"), (14, "last")]


def test_both_rules_of_tabs(spark):
    df = spark.createDataFrame([(1, "k\tv"), (2, "none"), (3, "\tx"), (4, "k\tb\tc"), (5, None)], "id int, line string")
    assert [tuple(r) for r in sources.read_kv(df).orderBy("id").collect()] == [(1, "k", "v"), (3, "", "x"), (4, "k", "b\tc")]
    assert [tuple(r) for r in sources.parse_line(df).orderBy("id").collect()] == [(1, "k", "v"), (2, "none", ""), (3, "", "x"), (4, "k", "b\tc"), (5, None, None)]
    assert {r.key: r.value for r in sources.last_wins(df, "id").collect()} == {"k": "b\tc", "": "x"}
    assert sources.read_kv(df.limit(0)).count() == 0


@pytest.mark.parametrize("codec", ["", "none", "gzip"])
def test_written_lines_come_back(spark, tmp_path, codec):
    df = spark.createDataFrame([("a", "1"), ("b", "x\ty"), ("", "z"), ("n", None)], "key string, value string").coalesce(1)
    sources.write_lines(df, str(tmp_path / "out"), codec)
    (part,) = files(tmp_path / "out")
    data = gzip.decompress(part.read_bytes()) if codec == "gzip" else part.read_bytes()
    assert data == b"a\t1\nb\tx\ty\n\tz\nn\t\n"
    got = sources.read_kv(sources.text_lines(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, got.collect())) == [("", "z"), ("a", "1"), ("b", "x\ty"), ("n", "")]


def test_unknown_codec(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown compression codec"):
        sources.write_lines(spark.createDataFrame([], "key string, value string"), str(tmp_path / "out"), "lz9")


@pytest.mark.parametrize("ids", [range(50), [7**k for k in range(18)], [5], [], [3, 3, 1, -4, None]])
@pytest.mark.parametrize("rows", [1, 3, 65536])
def test_sums_before_in_any_stretches(spark, monkeypatch, ids, rows):
    monkeypatch.setattr(order, "ROWS", rows)
    df = spark.createDataFrame([(i, (i or 0) % 5 + k % 2) for k, i in enumerate(ids)], "id long, size long")
    got = sorted((tuple(r) for r in order.with_sum_before(df, "id", F.col("size"), "size").collect()), key=lambda r: (r[2], r[1]))
    total, want = 0, []
    for i, s in sorted(((i, (i or 0) % 5 + k % 2) for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((i, s, total))
        total += s
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_and_offsets_of_texts(spark):
    df = spark.createDataFrame([(2, "b\r\nc"), (1, "é\n"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.number, r.offset, r.line) for r in order.lines_of(df).collect())
    assert got == [(0, 0, "é"), (1, 3, ""), (2, 4, "b"), (3, 6, "c"), (4, 8, "")]
