"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` is the same, and far faster, where every
    non-ASCII character is a lower-case letter; other strings take ``translate``."""
    return F.when(c.rlike(r"[^\x00-\x7F&&[^\p{Ll}]]"), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def strip_white(c: Column) -> Column:
    """Without the white space at both ends."""
    return F.trim(c, F.lit(WHITE))


def text_key(c: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: 128 bits that stand for a text."""
    first = F.xxhash64(c)
    return [first, F.xxhash64(F.lit(0x5EED), c)]


def joined_apart(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (each bigint ``key`` once) by the key's complement, by which neither
    is partitioned yet: so both sides get shuffles of their own, and adaptive execution can split
    the rows of a very frequent key among tasks, which it can't where a side comes from an aggregate."""
    keyed = one.select(F.bitwise_not(key).alias("_apart"), *(c for c in one.columns if c != key))
    return many.join(keyed, F.bitwise_not(many[key]) == F.col("_apart"), how).drop("_apart")
