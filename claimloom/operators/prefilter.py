"""Cohort filters for claim scans: a Bloom filter in front of the exact join.

The filter is an array of 64-bit words. A key sets PROBES bits of one word, so
it is built by one aggregate (`bit_or` by word, combined on the map side) and
asked by one array access in the filter above the claim scan. The array is a
scalar subquery of at most MAX_WORDS words; a cohort that needs more is
restricted by the exact join alone. Passing keys that are no members are
removed by that join, so results never depend on the filter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import names, restrict

PROBES = 5
#: 16 MB, sent to every task of the scan; enough for ten million keys at one percent.
MAX_WORDS = 1 << 21
#: Types whose equal values have equal hashes.
HASHED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)


def false_positives(keys: int, words: int) -> float:
    """Expected share of other keys that pass a filter of `keys` distinct keys.

    The keys of one word follow a Poisson law; each sets PROBES of its 64 bits.
    """
    load = keys / words
    if load == 0:
        return 0.0
    most = int(load + 12 * math.sqrt(load) + 12)
    return sum(
        math.exp(n * math.log(load) - load - math.lgamma(n + 1)) * (1 - (63 / 64) ** (PROBES * n)) ** PROBES
        for n in range(1, most + 1)
    )


def words_for(keys: int, rate: float) -> int | None:
    """Fewest words (a power of two) that keep false positives within `rate`; None beyond MAX_WORDS."""
    words = 1
    while false_positives(keys, words) > rate:
        words *= 2
        if words > MAX_WORDS:
            return None
    return words


def _word(keys: Sequence[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words)).cast("int")


def _mask(keys: Sequence[str]) -> Column:
    other = F.xxhash64(F.lit(PROBES), *keys)
    mask = F.lit(0).cast("long")
    for probe in range(PROBES):
        bit = F.shiftrightunsigned(other, 6 * probe).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def may_be_member(members: DataFrame, keys: str | Sequence[str], rate: float) -> Column | None:
    """Condition that holds for every member key, and for about `rate` of all others.

    Counts `members` (store them first if they are costly). None if the filter
    would exceed MAX_WORDS. A repeated member only makes the filter larger; an
    empty table of members lets nothing pass.
    """
    keys = names(keys)
    words = words_for(members.count(), rate)
    if words is None:
        return None
    empty = members.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    bits = (
        members.select(_word(keys, words).alias("word"), _mask(keys).alias("mask")).unionByName(empty)
        .groupBy("word").agg(F.bit_or("mask").alias("bits"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("entries"))
    )
    asked = F.get(bits.select(F.col("entries.bits")).scalar(), _word(keys, words))
    return asked.bitwiseAND(_mask(keys)) == _mask(keys)


def restrict_early(
    df: DataFrame, members: DataFrame, keys: str | Sequence[str], carry: Sequence[str] = (), rate: float = 0.01
) -> DataFrame:
    """`restrict`, but rows of other keys go at the scan, before the shuffle, except for about `rate` of them.

    Worth it where the cohort is a small part of the rows and too large for a
    broadcast join. Keys that differ in type on the two sides, or whose equal
    values may hash differently (floats, decimals), get the exact join alone,
    as does a cohort too large for the filter.
    """
    keys = names(keys)
    same = all(df.schema[k].dataType == members.schema[k].dataType and isinstance(df.schema[k].dataType, HASHED) for k in keys)
    passes = may_be_member(members, keys, rate) if same else None
    return restrict(df if passes is None else df.where(passes), members, keys, carry)
