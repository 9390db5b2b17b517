"""Hashed byte n-grams and the bounded learning sample that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: odd multipliers of the rolling and the final hash
STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def hashed_ngrams(data: bytes, sizes: range, bits: int) -> list[np.ndarray]:
    """For each size the bucket (of 2**bits) of every n-gram of data."""
    byte = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, rolled = [], byte
    for n in range(2, sizes.stop):
        if len(byte) < n:
            break
        rolled = rolled[:-1] * STEP + byte[n - 1 :]
        if n in sizes:
            out.append((rolled * MIX + np.uint32(n)) * MIX >> np.uint32(32 - bits))
    return out


#: parts of a sample by hash, of which whole ones are taken
PARTS = 1024


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(PARTS))


def within(sizes: list[tuple[int, int, int]], max_rows: int, max_bytes: int) -> list[int]:
    """Parts (part, rows, bytes) in their order, each taken where both bounds still hold with it: never more than these."""
    taken, rows, size = [], 0, 0
    for part, n, own in sorted(sizes):
        if rows + n <= max_rows and size + own <= max_bytes:
            taken.append(part)
            rows, size = rows + n, size + own
    return taken


def sampled(key: Column, fraction: Column) -> Column:
    """True for about that fraction of the keys, the same ones each time."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < fraction * 1_000_000
