"""op7: passages that repeat across documents, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each shard of loomkv.llm.repeats gets a suffix array and its transform. Backward extension, breadth first,
yields the common prefixes of neighbouring suffixes by increasing value and stops at MIN_WORDS: the
neighbours not parted until then share a gram.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomkv.llm import repeats as R

ORACLE = R.ORACLE


def by_expansion(shard: R.Shard) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the shard's text: whether the gram there stands in two documents, and the smallest that holds it."""
    sa = shard.suffixes()
    prefixes = R.bounded_prefixes(shard.text[sa - 1], R.MIN_WORDS)
    heads = np.flatnonzero(prefixes < R.MIN_WORDS)
    owner = shard.owner[sa]
    least, most = np.minimum.reduceat(shard.lo[owner], heads), np.maximum.reduceat(shard.hi[owner], heads)
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(sa))))
    hits, first = np.zeros(len(sa), bool), np.zeros(len(sa), np.int64)
    long = shard.ends[owner] - 1 - sa >= R.MIN_WORDS
    hits[sa], first[sa] = (least < most)[group] & long, least[group]
    return hits, first


def suffix_repeats(documents: DataFrame) -> DataFrame:
    """As loomkv.llm.repeats.repeats(): (doc_id, start_word, end_word, first_doc)."""
    return R.repeats(documents, by_expansion)


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
