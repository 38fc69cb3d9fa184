"""Numbers of rows in an order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 65536


def with_sum_before(df: DataFrame, order: str, size: Column, *ties: str) -> DataFrame:
    """df with a column `before`: the sum of size over the rows that come earlier by the integer column order, and then by ties.

    Equally wide stretches of order, of ROWS rows on average, are summed each in a task of its own; only their
    totals, one row for each, are put in sequence by one task and joined back. Nulls count as the smallest value.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    if low is None:
        low = high = 0
    width = max(1, -(-(high - low + 1) // max(1, -(-n // ROWS))))
    stretch = F.floor((F.coalesce(order, F.lit(low)) - F.lit(low)) / F.lit(width)).cast("long")
    sized = df.withColumn("own_stretch", stretch).withColumn("own_size", size.cast("long"))
    inside = Window.partitionBy("own_stretch").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("own_stretch").agg(F.sum("own_size").alias("own_total"))
    base = totals.select(F.col("own_stretch").alias("base_stretch"), F.coalesce(F.sum("own_total").over(Window.orderBy("own_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("own_base"))
    summed = sized.withColumn("own_inside", F.coalesce(F.sum("own_size").over(inside), F.lit(0)))
    joined = summed.join(base, F.col("own_stretch") == F.col("base_stretch"))
    return joined.select(*df.columns, (F.col("own_base") + F.col("own_inside")).alias("before"))


def numbered(df: DataFrame, order: str, *ties: str) -> DataFrame:
    """df with a column `before`: how many rows come earlier."""
    return with_sum_before(df, order, F.lit(1), *ties)


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, at, line, number, offset): the lines of all texts in order of doc_id, as of one file in which a line feed follows every text.

    number counts lines from 0; offset adds up the bytes of lines, without one carriage return at their end,
    and one for each line feed. A null text has no lines.
    """
    split = documents.where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")).alias("lines"))
    sizes = split.select("doc_id", "lines", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1).alias("bytes"), F.size("lines").alias("n"))
    placed = with_sum_before(with_sum_before(sizes, "doc_id", F.col("bytes")).withColumnRenamed("before", "first_byte"), "doc_id", F.col("n"))
    rows = placed.select("doc_id", "first_byte", "before", F.posexplode("lines").alias("at", "line"))
    earlier = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.octet_length("line") + 1).over(earlier), F.lit(0))
    return rows.select("doc_id", "at", "line", (F.col("before") + F.col("at")).alias("number"), (F.col("first_byte") + inside).alias("offset"))
