"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from loomkv.llm import bpe, index_repeats, language, mixture, near_copies, nearest, private, suffix_repeats, toxicity, webp

QUERIES = {f.__name__: f for f in (index_repeats.op1_index_repeats, nearest.op2_nearest, private.op3_private, mixture.op4_mixture, toxicity.op5_toxicity, bpe.op6_bpe, suffix_repeats.op7_suffix_repeats, language.op8_language, near_copies.op9_near_copies, webp.op10_media)}
ORACLE = {"op1_index_repeats": index_repeats.ORACLE, "op7_suffix_repeats": suffix_repeats.ORACLE, "op2_nearest": nearest.ORACLE, "op4_mixture": mixture.ORACLE}
