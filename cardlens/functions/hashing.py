"""Stable integer hashes of a row key, reproducible in any SQL engine.

mix32(k, m) = ((k mod 2^32) * m) mod 2^32, computed on 16-bit halves so
no intermediate exceeds 2^49 (ANSI mode raises on BIGINT overflow).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplicative-hash constants and the 80/20 split cut.
SPLIT_MULT = 2654435761
SAMPLE_MULT = 2246822519
TWO32 = 4294967296
TRAIN_CUT = 3435973837  # ceil(0.8 * 2^32): hash < cut -> train


def mix32(key: Column, mult: int) -> Column:
    a = F.pmod(key.cast("long"), F.lit(TWO32))
    hi = F.shiftright(a, 16)
    lo = a.bitwiseAND(F.lit(65535))
    return F.pmod(F.pmod(hi * F.lit(mult), F.lit(65536)) * F.lit(65536) + lo * F.lit(mult), F.lit(TWO32))


def split_label(key: Column, train_fraction_cut: int = TRAIN_CUT) -> Column:
    """C12: 'train' / 'test' from the key alone -- stable under any repartition."""
    return F.when(mix32(key, SPLIT_MULT) < F.lit(train_fraction_cut), "train").otherwise("test")


def sample_hash(key: Column) -> Column:
    return mix32(key, SAMPLE_MULT)
