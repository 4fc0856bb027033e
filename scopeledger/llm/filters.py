"""Bitmaps of fixed size that tell tasks which strings cannot matter.

The size does not grow with the strings: a fuller bitmap only lets more of them
pass, so whoever uses one must settle the rest exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import ship

ship(__name__)

#: One megabyte.
BITS = 1 << 23
#: Bits in each piece that Spark's aggregate builds.
PIECE = 1 << 15
SEED = 42


def bitmap_of(df: DataFrame, *columns: Column) -> bytes:
    """Bits of all strings (or tuples of them) of ``df``; at most ``BITS / 8`` bytes reach the driver."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(BITS)) + 1  # positions of the aggregate count from 1
    rows = df.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    found = bytearray(BITS // 8)
    for piece, bits in rows.collect():
        at = (piece - 1) * PIECE // 8
        found[at:at + PIECE // 8] = bits
    return bytes(found)


def seed_of(first: str) -> int:
    """Hash of a tuple's first string, the seed for its second."""
    return xxhash.xxh64_intdigest(first.encode(), SEED)


def has(bits: bytes, value: bytes, seed: int = SEED) -> bool:
    slot = xxhash.xxh64_intdigest(value, seed) % BITS
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def digests(values: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(v, seed) for v in values), np.uint64, len(values))


def held(bits: bytes, found: np.ndarray) -> np.ndarray:
    """Which of many digests have their bit, as :func:`has` tells of one value."""
    slots = found % np.uint64(BITS)
    return (np.frombuffer(bits, np.uint8)[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
