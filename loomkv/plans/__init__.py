"""What a DataFrame's plan will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> list[str]:
    """The partitioning of each shuffle in the plan as it stands before it runs; broadcasts are none."""
    return re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (\w+)", physical(df))


def stages(df: DataFrame) -> list[dict]:
    """One entry a stage, the last one that gives the result: whether a shuffle ends it."""
    n = len(exchanges(df))
    return [{"id": k, "shuffle": k < n} for k in range(n + 1)]


def partial_aggregates(df: DataFrame) -> int:
    """Aggregates that run before a shuffle."""
    return len(re.findall(r"functions=\[partial_", physical(df)))
