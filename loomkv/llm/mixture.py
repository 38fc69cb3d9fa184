"""op4: a training mixture of sources to target weights, by capped water-filling.

Without other weights a source with n words weighs n ** TEMPERATURE. No source is repeated over MAX_EPOCHS
times: those that would be are clamped there and their excess goes to the others in proportion to their
weights, until it fits. In order of caps this is one level: every source holds the lower of level x weight
and its cap, all together as many words as the corpus, or all are at their caps. A document then comes
floor(epochs + u) times, u in [0, 1) from SEED and its doc_id, so that whole repetitions are sure and
the fractions of many documents add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkv.llm.shared import checkpointed

TEMPERATURE = 0.5
MAX_EPOCHS = 2.0
SEED = 42
SPACE = r"[ \t\n\r\f\x0B]+"
MOST_SENT = 100_000

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')), 0) AS words FROM documents),
g AS (SELECT source, CAST(sum(words) AS DOUBLE) AS n, sqrt(CAST(sum(words) AS DOUBLE)) AS w FROM d GROUP BY source HAVING sum(words) > 0),
o AS (SELECT *, {MAX_EPOCHS} * n AS cap, row_number() OVER (ORDER BY n / w, source) AS r, sum(n) OVER () AS budget FROM g),
s AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
l AS (SELECT max((budget - below) / rest) FILTER (WHERE (budget - below) / rest < cap / w) AS level FROM s),
e AS (SELECT source, round(least(cap, coalesce(level, cap / w) * w) / n, 6) AS epochs FROM s, l)
SELECT doc_id, source, CAST(words AS BIGINT) AS words, coalesce(epochs, 0) AS epochs, CAST(floor(coalesce(epochs, 0) + (((doc_id % 2147483648) * 2654435761 + {SEED}) % 4294967296) / 4294967296.0) AS BIGINT) AS copies
FROM d LEFT JOIN e USING (source)"""


def _words() -> Column:
    return F.greatest(F.coalesce(F.size(F.filter(F.split("text", SPACE), lambda x: x != "")), F.lit(0)), F.lit(0)).cast("long")


def epochs(groups: DataFrame) -> DataFrame:
    """(source, epochs) of (source, n, w): words and weights. The first source in order of caps to stay below its cap sets the level; the same sum from a later one is lower.

    Sources without words or weight are left out; the others may make up for the words of the latter."""
    order = Window.orderBy(F.col("n") / F.col("w"), "source")  # as many rows as sources: sums of all documents
    s = groups.where("n > 0").select("source", F.col("n").cast("double").alias("n"), F.col("w").cast("double").alias("w")).withColumn("cap", F.col("n") * MAX_EPOCHS)
    s = s.withColumn("budget", F.sum("n").over(Window.partitionBy())).where("w > 0")
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("budget") - F.col("below")) / F.col("rest")
    s = s.withColumn("level", F.max(F.when(level < F.col("cap") / F.col("w"), level)).over(Window.partitionBy()))
    return s.select("source", F.round(F.least("cap", F.coalesce("level", F.col("cap") / F.col("w")) * F.col("w")) / F.col("n"), 6).alias("epochs"))


def _shares(documents: DataFrame, weights: DataFrame | None) -> DataFrame:
    """epochs() of the documents' sources as (own_source, own_epochs); sent to all workers only up to MOST_SENT sources, else joined as it comes."""
    n = documents.select(F.coalesce("source", F.lit("")).alias("source"), _words().alias("words")).groupBy("source").agg(F.sum("words").alias("n"))
    groups = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))) if weights is None else n.join(weights.groupBy("source").agg(F.max("weight").alias("w")), "source", "left")
    found = checkpointed(epochs(groups)).select(F.col("source").alias("own_source"), F.col("epochs").alias("own_epochs"))
    return F.broadcast(found) if found.count() <= MOST_SENT else found


def _copies(own_epochs: Column) -> Column:
    u = F.pmod(F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(SEED), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return F.floor(F.coalesce(own_epochs, F.lit(0.0)) + u).cast("long")


def mixture(documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, words, epochs, copies), one row for every row of documents.

    weights (source, weight) are the targets; sources that it lacks, or gives no weight above 0, get no
    epochs. A null source is the source of the empty name, a null doc_id draws as 0, a null text has no words;
    a source without any words gets no epochs. Repeated rows are drawn alike but each for itself. If all
    sources reach their caps, fewer words than the corpus has come out. Other columns are neither read nor returned.
    """
    d = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _words().alias("words"))
    joined = d.join(_shares(documents, weights), F.col("source") == F.col("own_source"), "left")
    return joined.select("doc_id", "source", "words", F.coalesce("own_epochs", F.lit(0.0)).alias("epochs"), _copies(F.col("own_epochs")).alias("copies"))


def mixed(documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, n_chars), each as often as mixture() says."""
    d = documents.select("doc_id", "text", "lang", "source", "n_chars")
    joined = d.join(_shares(documents, weights), F.coalesce("source", F.lit("")) == F.col("own_source"), "left")
    return joined.withColumn("own_copy", F.explode(F.array_repeat(F.lit(1), _copies(F.col("own_epochs")).cast("int")))).select(*d.columns)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
