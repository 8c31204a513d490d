"""Signed-bit votes in 64-bit lanes, inside whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits i and i + 32 of a hash, one in each half of a long; so 32 sums hold all 64 votes, up to 2**31 of weight.
LANES = (1 << 32) + 1


def votes(term_hash: Column, weight: Column | None = None) -> list[Column]:
    """32 sums named __v0.. that count, by weight, the hashes with each bit set. A null hash votes for nothing."""
    one = lambda i: F.shiftrightunsigned(term_hash, i).bitwiseAND(F.lit(LANES))
    return [F.sum(one(i) if weight is None else one(i) * weight).alias(f"__v{i}") for i in range(32)]


def majority(total: Column) -> Column:
    """The 64 bits that are set in over half of the total weight. Without any vote: zero."""
    low = [F.when(F.col(f"__v{i}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > total, F.lit(1 << i)) for i in range(32)]
    high = [F.when(F.shiftrightunsigned(F.col(f"__v{i}"), 32) * 2 > total, F.lit(1 << (i + 32) if i < 31 else -(1 << 63))) for i in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), [c.otherwise(F.lit(0).cast("long")) for c in low + high])


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
