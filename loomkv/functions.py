"""Scalar functions of the engine as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTSET = ".,!?;:\"'()[]{}"
WIDE_SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_BYTES = "transform(filter(sequence(0, octet_length({k})), i -> i > 0), i -> cast(conv(hex(substring(encode({k}, 'UTF-8'), i, 1)), 16, 10) as bigint))"
_FNV = "aggregate(" + _BYTES + ", 2166136261L, (h, b) -> ((h ^ b) * 16777619L) & 4294967295L)"
_HASH31 = (
    "aggregate(transform(filter(split({k}, ''), c -> c <> ''), c -> cast(ascii(c) as bigint)), named_struct('hi', 0L, 'lo', 0L), "
    "(a, c) -> named_struct('hi', (a.hi * 31L + shiftrightunsigned(a.lo * 31L + c, 32)) & 4294967295L, 'lo', (a.lo * 31L + c) & 4294967295L), "
    "a -> shiftleft(a.hi, 31) | shiftrightunsigned(a.lo, 1))"
)


def fields(text: Column) -> Column:
    """Array of the runs of characters that are not Unicode white space; none empty."""
    return F.filter(F.split(text, WIDE_SPACE), lambda w: w != "")


def simple_lower(text: Column) -> Column:
    """Lower case character by character: no final sigma, no letter that becomes two."""
    each = F.array_join(F.transform(F.split(F.replace(text, F.lit("İ"), F.lit("i")), ""), F.lower), "")
    return F.when(text.rlike("[Σİ]"), each).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    """Array of word-count tokens: fields without marks at either end, in lower case, none empty."""
    return F.filter(F.transform(F.split(simple_lower(text), WIDE_SPACE), lambda w: F.btrim(w, F.lit(CUTSET))), lambda w: w != "")


def words(df: DataFrame, text: str, name: str) -> DataFrame:
    """One row (name) for each token; the same as exploding tokens(), with all but the split in generated code."""
    raw = df.select(F.explode(F.split(simple_lower(F.col(text)), WIDE_SPACE)).alias("raw"))
    return raw.select(F.btrim("raw", F.lit(CUTSET)).alias(name)).where(F.col(name) != "")


def atoi(text: Column) -> Column:
    """The 64-bit integer that text spells in full, with an optional sign; null for anything else, or beyond the range."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def before_tab(line: Column) -> Column:
    return F.split(line, "\t", 2)[0]


def after_tab(line: Column) -> Column:
    """What stands after the first tab, further tabs and all; null without one."""
    return F.get(F.split(line, "\t", 2), F.lit(1))


def fnv1a32(key: str) -> Column:
    """FNV-1a over the UTF-8 bytes of the column of that name, as a number of 32 bits; null for null."""
    return F.expr(_FNV.format(k=f"`{key}`"))


def hash31(key: str) -> Column:
    """The polynomial hash of base 31 over code points, wrapped at 64 bits and halved; null for null."""
    return F.expr(_HASH31.format(k=f"`{key}`"))


def partition_of(hashed: Column, n: int) -> Column:
    """The partition of a hash among n; 0 if there are none."""
    return F.pmod(hashed, F.lit(n)).cast("int") if n > 0 else F.lit(0)
