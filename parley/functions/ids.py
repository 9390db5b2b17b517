"""Ids that look random, don't repeat, and are the same whenever a task runs again: a counter sent through a keyed permutation.

The permutation is a Feistel network over the two 32-bit halves of a 64-bit number: whatever its rounds do, different counters get
different ids. The counter is a row's own (a conversation's number and a place in it), so no state is shared and no draw depends
on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: multipliers of the rounds (odd, under 2^31) and half of a word (fixed values)
ROUNDS = (0x5851F42D, 0x6C078965, 0x4F1BBCDD, 0x27BB2EE7, 0x369DEA0F, 0x41C64E6D)
HALF = 0xFFFFFFFF


def counter(conv_id: Column, place: Column) -> Column:
    """One number for each pair of numbers under 2^32; others are an error, as they could meet."""
    fits = lambda x: (x >= 0) & (x <= HALF)
    packed = F.shiftleft(conv_id.cast("bigint"), 32).bitwiseOR(place.cast("bigint"))
    return F.when(fits(conv_id) & fits(place), packed).otherwise(F.raise_error(F.lit("an id's parts must be under 2^32")).cast("bigint"))


def random_id(number: Column, seed: int = 0) -> Column:
    """The id (bigint, any 64 bits) of a counter; seed gives another permutation."""
    number = number.cast("bigint")
    left, right = F.shiftrightunsigned(number, 32), number.bitwiseAND(F.lit(HALF))
    for i, by in enumerate(ROUNDS):
        mixed = right.bitwiseXOR(F.lit((seed * 0x9E3779B9 + i * 0x7F4A7C15) & HALF)) * F.lit(by)  # under 2^63
        mixed = mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 29)).bitwiseAND(F.lit(HALF))
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, 32).bitwiseOR(right)


def sql(number: str, seed: int = 0) -> str:
    """The same in DuckDB's SQL, for a number over 0 and under 2^63."""
    halves = f"[({number})::HUGEINT >> 32, ({number})::HUGEINT & {HALF}]"
    for i, by in enumerate(ROUNDS):
        key = (seed * 0x9E3779B9 + i * 0x7F4A7C15) & HALF
        halves = f"list_transform([list_transform([{halves}], lambda h: [h[1], h[2], xor(h[2], {key}::HUGEINT) * {by}])[1]], lambda h: [h[2], xor(h[1], xor(h[3], h[3] >> 29) & {HALF})])[1]"
    return f"list_transform([{halves}], lambda h: CASE WHEN h[1] >= 2147483648 THEN h[1] * 4294967296 + h[2] - 18446744073709551616::HUGEINT ELSE h[1] * 4294967296 + h[2] END::BIGINT)[1]"
