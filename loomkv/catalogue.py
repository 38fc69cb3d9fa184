
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv import sources, storage
from loomkv.functions import CUTSET, WIDE_SPACE, fnv1a32, hash31, partition_of, tokens, words
from loomkv.operators import jobs
from loomkv.operators.keyed import KeyedFrame
from loomkv.operators.order import lines_of, numbered

PARTS = 4
BLOCK = 4096
TOP = 100
SQL_CUTSET = CUTSET.replace("'", "''")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Lines out of events, in both dialects: whole numbers with and without a sign, values that are none, lines
#: without a tab, with two, and with nothing before it; the keys that start with "bad" have no number at all.
LINE = """CASE event_id % 8
  WHEN 0 THEN concat(event_type, chr(9), CAST(CAST(floor(value) AS BIGINT) AS {text}))
  WHEN 1 THEN concat(event_type, chr(9), '-', CAST(event_id AS {text}))
  WHEN 2 THEN concat(event_type, chr(9), '+', CAST(user_id AS {text}))
  WHEN 3 THEN concat(event_type, chr(9), CAST(event_id AS {text}), '.5')
  WHEN 4 THEN concat(event_type, chr(9), ' ', CAST(event_id AS {text}))
  WHEN 5 THEN concat('bad ', event_type, chr(9), event_type)
  WHEN 6 THEN concat(event_type, chr(9), '7', chr(9), CAST(event_id AS {text}))
  ELSE CASE WHEN event_id % 16 = 7 THEN event_type ELSE concat(chr(9), CAST(event_id AS {text})) END END"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.expr(LINE.format(text="STRING")).alias("line"))


def _keyed(df: DataFrame, key: str, value: str, order: str | None = None) -> KeyedFrame:
    return KeyedFrame(df.select(F.col(key).alias("key"), F.col(value).alias("value"), *([order] if order else [])), order)


def mr_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(_read(spark, sf_dir, "documents"), "text", "word").groupBy("word").agg(F.count("*").alias("n"))


def mr_wordcount_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the TOP words, by count and then by themselves."""
    return mr_wordcount(spark, sf_dir).orderBy(F.desc("n"), "word").limit(TOP)


def mr_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = jobs.run(_lines(spark, sf_dir).select(F.lit("").alias("key"), F.col("line").alias("value")), "sumbykey", "sumbykey")
    return pairs.select("key", F.col("value").alias("total"))


def mr_identity_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all texts, as of one file, under their offsets."""
    lines = lines_of(_read(spark, sf_dir, "documents")).select(F.col("offset").cast("string").alias("key"), F.col("line").alias("value"))
    return jobs.run(lines, "identity", "identity")


def mr_identity_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of offsets as strings: "10" comes before "9"."""
    return mr_identity_offsets(spark, sf_dir).orderBy("key")


def mr_group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _keyed(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber").group_values()
    return grouped.select(F.col("key").alias("l_orderkey"), F.size("values").alias("n"), F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("parts"))


def mr_sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_read(spark, sf_dir, "events"), "event_type", "event_id").sorted_keys().select(F.col("key").alias("event_type"))


def mr_combiner_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grouping: the partial sums of each task are the combiner's level, and one shuffle does for both."""
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))


def mr_hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mr_wordcount(spark, sf_dir).select("word", partition_of(fnv1a32("word"), PARTS).alias("part"), "n")


def rdd_hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mr_wordcount(spark, sf_dir).select("word", partition_of(hash31("word"), PARTS).alias("part"), "n")


def mr_partition_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in PARTS partitions by the hash of their keys, each sorted by key."""
    counts = mr_wordcount(spark, sf_dir).select("word", "n", partition_of(fnv1a32("word"), PARTS).alias("part"))
    return counts.repartitionById(PARTS, F.col("part")).sortWithinPartitions("part", "word")


def text_read_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_kv(_lines(spark, sf_dir))


def text_parse_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.parse_line(_lines(spark, sf_dir))


def text_read_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.last_wins(_lines(spark, sf_dir), "event_id")


def text_write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.formatted(mr_wordcount(spark, sf_dir).select(F.col("word").alias("key"), F.col("n").alias("value")))


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    return storage.splits(sizes, BLOCK).withColumnRenamed("id", "doc_id")


def rdd_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.pmod("before", F.lit(PARTS)).cast("int").alias("part"))


def rdd_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(_read(spark, sf_dir, "documents")).select(F.col("number").cast("string").alias("key"), F.col("line").alias("value"))


def rdd_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _keyed(_read(spark, sf_dir, "documents"), "doc_id", "source").map(lambda k, v: (k, F.upper(v))).df
    return made.select(F.col("key").alias("doc_id"), F.col("value").alias("source"))


def rdd_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _keyed(_read(spark, sf_dir, "documents"), "doc_id", "text").flat_map(lambda k, v: F.transform(tokens(v), lambda w: F.struct(w.alias("key"), F.lit(1).alias("value"))))
    return pairs.df.select(F.col("key").alias("word"))


def rdd_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _read(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("key"), F.col("l_quantity").alias("value"))
    kept = KeyedFrame(kept).filter(lambda k, v: v > 25).df
    return kept.select("key.l_orderkey", "key.l_linenumber", F.col("value").alias("l_quantity"))


def _reduced(spark: SparkSession, sf_dir: str, merge: str, value: str, out: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col(value).cast("long").alias("value"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"))
    return KeyedFrame(rows, "at" if merge == "first" else None).reduce_by_key(merge).df.select(F.col("key").alias("l_returnflag"), F.col("value").alias(out))


def rdd_reduce_by_key_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "sum", "l_quantity", "total")


def rdd_reduce_by_key_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "min", "l_partkey", "least")


def rdd_reduce_by_key_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "max", "l_partkey", "most")


def rdd_reduce_by_key_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "first", "l_partkey", "first_part")


def rdd_group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _keyed(_read(spark, sf_dir, "nation"), "n_regionkey", "n_name", "n_nationkey").group_by_key()
    return grouped.df.select(F.col("key").alias("n_regionkey"), F.col("value").alias("nations"))


def rdd_count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_read(spark, sf_dir, "events"), "event_type", "event_id").count_by_key().withColumnRenamed("key", "event_type")


def rdd_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


def rdd_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def block_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", storage.checksum(F.col("text")).alias("checksum"))


def block_xor_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.with_parity(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (mr_wordcount, mr_wordcount_top, mr_sum_by_key, mr_identity_offsets, mr_identity_sort, mr_group_values, mr_sorted_keys, mr_combiner_two_level, mr_hash_partition, rdd_hash_partition, mr_partition_sort, text_read_kv, text_parse_line, text_read_last_wins, text_write_lines, split_plan, rdd_round_robin, rdd_from_lines, rdd_map, rdd_flat_map, rdd_filter, rdd_reduce_by_key_sum, rdd_reduce_by_key_min, rdd_reduce_by_key_max, rdd_reduce_by_key_first, rdd_group_by_key, rdd_count_by_key, rdd_count, rdd_collect, block_checksum, block_xor_parity)
}

WORDS = f"SELECT word FROM (SELECT lower(trim(w, '{SQL_CUTSET}')) AS word FROM (SELECT unnest(string_split_regex(text, '{WIDE_SPACE}')) AS w FROM documents)) WHERE word <> ''"
COUNTS = f"SELECT word, count(*) AS n FROM ({WORDS}) GROUP BY word"
LINES = f"SELECT event_id, {LINE.format(text='VARCHAR')} AS line FROM events"
KV = f"SELECT event_id, substr(line, 1, strpos(line, chr(9)) - 1) AS key, substr(line, strpos(line, chr(9)) + 1) AS value FROM ({LINES}) WHERE strpos(line, chr(9)) > 0"
DOC_LINES = """SELECT doc_id, pos, line, row_number() OVER w - 1 AS number, coalesce(sum(strlen(line) + 1) OVER (ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(list_transform(lines, lambda x: regexp_replace(x, '\\r$', ''))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WINDOW w AS (ORDER BY doc_id, pos)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
HASH31 = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(word, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616) // 2"
HEX = "hex(encode(text))"
BYTE = "('0x' || substr(h, 2 * (s * size + j) + 1, 2))::INTEGER"
ORACLE = {
    "mr_wordcount": COUNTS,
    "mr_wordcount_top": f"SELECT word, n FROM ({COUNTS}) ORDER BY n DESC, encode(word) LIMIT {TOP}",
    "mr_sum_by_key": f"SELECT key, CAST(coalesce(sum(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN TRY_CAST(value AS BIGINT) END), 0) AS VARCHAR) AS total FROM ({KV}) GROUP BY key",
    "mr_identity_offsets": f"SELECT CAST(off AS VARCHAR) AS key, line AS value FROM ({DOC_LINES})",
    "mr_identity_sort": f"SELECT CAST(off AS VARCHAR) AS key, line AS value FROM ({DOC_LINES}) ORDER BY key",
    "mr_group_values": "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey",
    "mr_sorted_keys": "SELECT DISTINCT event_type FROM events ORDER BY event_type",
    "mr_combiner_two_level": "SELECT l_returnflag, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag",
    "mr_hash_partition": f"SELECT word, CAST({FNV} % {PARTS} AS INTEGER) AS part, n FROM ({COUNTS})",
    "rdd_hash_partition": f"SELECT word, CAST(({HASH31}) % {PARTS} AS INTEGER) AS part, n FROM ({COUNTS})",
    "mr_partition_sort": f"SELECT word, n, CAST({FNV} % {PARTS} AS INTEGER) AS part FROM ({COUNTS}) ORDER BY part, word",
    "text_read_kv": KV,
    "text_parse_line": f"SELECT event_id, CASE WHEN strpos(line, chr(9)) > 0 THEN substr(line, 1, strpos(line, chr(9)) - 1) ELSE line END AS key, CASE WHEN strpos(line, chr(9)) > 0 THEN substr(line, strpos(line, chr(9)) + 1) ELSE '' END AS value FROM ({LINES})",
    "text_read_last_wins": f"SELECT key, arg_max(value, event_id) AS value FROM ({KV}) GROUP BY key",
    "text_write_lines": f"SELECT word || chr(9) || CAST(n AS VARCHAR) AS line FROM ({COUNTS})",
    "split_plan": f"SELECT doc_id, CAST(b AS INTEGER) AS block, b * {BLOCK} AS offset, least({BLOCK}, strlen(text) - b * {BLOCK}) AS length FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(strlen(text) / {BLOCK}) AS BIGINT))) AS b FROM documents)",
    "rdd_round_robin": f"SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {PARTS} AS INTEGER) AS part FROM documents",
    "rdd_from_lines": f"SELECT CAST(number AS VARCHAR) AS key, line AS value FROM ({DOC_LINES})",
    "rdd_map": "SELECT doc_id, upper(source) AS source FROM documents",
    "rdd_flat_map": WORDS,
    "rdd_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25",
    "rdd_reduce_by_key_sum": "SELECT l_returnflag, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag",
    "rdd_reduce_by_key_min": "SELECT l_returnflag, min(l_partkey) AS least FROM lineitem GROUP BY l_returnflag",
    "rdd_reduce_by_key_max": "SELECT l_returnflag, max(l_partkey) AS most FROM lineitem GROUP BY l_returnflag",
    "rdd_reduce_by_key_first": "SELECT l_returnflag, first(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS first_part FROM lineitem GROUP BY l_returnflag",
    "rdd_group_by_key": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY n_regionkey",
    "rdd_count_by_key": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "rdd_count": "SELECT count(*) AS n FROM lineitem",
    "rdd_collect": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "block_checksum": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "block_xor_parity": f"SELECT doc_id, CASE WHEN size > 0 THEN array_to_string(list_transform(range(0, size), lambda j: printf('%02x', list_reduce(list_transform(range(0, {storage.DATA_SHARDS}), lambda s: CASE WHEN s * size + j < n THEN {BYTE} ELSE 0 END), lambda a, b: xor(a, b)))), '') END AS parity FROM (SELECT doc_id, {HEX} AS h, strlen(text) AS n, CAST(ceil(strlen(text) / {storage.DATA_SHARDS}.0) AS BIGINT) AS size FROM documents)",
}
