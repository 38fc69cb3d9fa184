"""KeyedFrame: chains of map, filter, shuffle and actions over rows (key, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Merges with partial sums before the shuffle. first and last go by the order column.
NAMED = {
    "sum": lambda v, o: F.sum(v.cast("bigint")),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "count": lambda v, o: F.count("*"),
    "first": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, o),
}


class KeyedFrame:
    """Rows (key, value) in a DataFrame, and where order matters a column that holds it.

    Functions take and return Columns and so stay in the optimizer's hands; the methods that end in _py take
    plain Python functions and run them over Arrow batches.
    """

    def __init__(self, df: DataFrame, order: str | None = None) -> None:
        self.order = order
        self.df = df.select("key", "value", *([order] if order else []))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[tuple[str, str]], n: int = 1) -> KeyedFrame:
        """Rows dealt out to n partitions in turn; their order is by partition, then by place."""
        n = max(1, n)
        placed = [(k, v, i % n << 40 | i // n, i % n) for i, (k, v) in enumerate(rows)]
        df = spark.createDataFrame(placed, "key string, value string, position long, part int")
        return cls(df.repartitionById(n, F.col("part")).sortWithinPartitions("position"), "position")

    @classmethod
    def from_lines(cls, spark: SparkSession, lines: Iterable[str], n: int = 1) -> KeyedFrame:
        """Lines under their number, from 0, as a string."""
        return cls.from_rows(spark, ((str(i), x) for i, x in enumerate(lines)), n)

    def _with(self, df: DataFrame) -> KeyedFrame:
        return KeyedFrame(df, self.order)

    def _rest(self) -> list[str]:
        return [self.order] if self.order else []

    def map(self, f: Callable[[Column, Column], tuple[Column, Column]]) -> KeyedFrame:
        key, value = f(F.col("key"), F.col("value"))
        return self._with(self.df.select(key.alias("key"), value.alias("value"), *self._rest()))

    def flat_map(self, f: Callable[[Column, Column], Column]) -> KeyedFrame:
        """f gives an array of structs (key, value); none of them is a row less."""
        made = self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("made"), *self._rest())
        return self._with(made.select("made.key", "made.value", *self._rest()))

    def filter(self, f: Callable[[Column, Column], Column]) -> KeyedFrame:
        return self._with(self.df.where(f(F.col("key"), F.col("value"))))

    def reduce_by_key(self, merge: str | Callable[[Column, Column], Column]) -> KeyedFrame:
        """One row for each key. By name (see NAMED) values meet as partial results.

        A function of two Columns folds the key's values in order, which needs them all in one row: for keys with few values only.
        A key with a single value keeps it as it is, without a call of the function.
        """
        grouped = self.df.groupBy("key")
        if isinstance(merge, str):
            if merge not in NAMED:
                raise ValueError(f"unknown merge: {merge}")
            if merge in ("first", "last") and not self.order:
                raise ValueError(f"{merge} needs an order")
            return KeyedFrame(grouped.agg(NAMED[merge](F.col("value"), F.col(self.order) if self.order else None).alias("value")))
        lists = grouped.agg(self._list().alias("all"))
        return KeyedFrame(lists.select("key", F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), merge).alias("value")))

    def _list(self) -> Column:
        if not self.order:
            return F.collect_list("value")
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(self.order).alias("o"), F.col("value").alias("v")))), lambda x: x["v"])

    def group_values(self) -> DataFrame:
        """(key, values): an array for each key, in order if there is one. It must fit in a row."""
        return self.df.groupBy("key").agg(self._list().alias("values"))

    def group_by_key(self, separator: str = ",") -> KeyedFrame:
        """A key's values joined into one string, in order. A single string must hold them."""
        return KeyedFrame(self.group_values().select("key", F.array_join("values", separator).alias("value")))

    def sorted_keys(self) -> DataFrame:
        return self.df.select("key").distinct().orderBy("key")

    def count_by_key(self) -> DataFrame:
        return self.df.groupBy("key").agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[tuple[str, str]]:
        """All rows, on the driver: an action for small results."""
        df = self.df.orderBy(self.order) if self.order else self.df
        return [(r.key, r.value) for r in df.collect()]

    def map_py(self, f: Callable[[str, str], tuple[str, str]]) -> KeyedFrame:
        return self.flat_map_py(lambda k, v: [f(k, v)])

    def flat_map_py(self, f: Callable[[str, str], Iterable[tuple[str, str]]]) -> KeyedFrame:
        names = self._rest()

        def rows(batches):
            for batch in batches:
                made, at = [], []
                for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    for pair in f(k, v):
                        made.append(pair)
                        at.append(i)
                columns = {"key": pa.array([x[0] for x in made], pa.string()), "value": pa.array([x[1] for x in made], pa.string())}
                yield pa.record_batch({**columns, **{c: batch.column(2 + j).take(pa.array(at, pa.int64())) for j, c in enumerate(names)}})

        return self._with(self.df.mapInArrow(rows, "key string, value string" + "".join(f", {c} {self.df.schema[c].dataType.simpleString()}" for c in names)))

    def reduce_by_key_py(self, f: Callable[[str, str], str]) -> KeyedFrame:
        """Folds each key's values, in order, by a Python function; a key's values come to one task in batches."""
        order = self.order

        def fold(table: pa.Table) -> pa.Table:
            if order:
                table = table.sort_by(order)
            values = table["value"].to_pylist()
            total = values[0]
            for v in values[1:]:
                total = f(total, v)
            return pa.table({"key": table["key"].slice(0, 1), "value": pa.array([total], pa.string())})

        return KeyedFrame(self.df.groupBy("key").applyInArrow(fold, "key string, value string"))
