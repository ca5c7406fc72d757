"""The name hash that subsampling uses: mates share a name, so they stay together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def name_hash(name: Column) -> Column:
    """31-fold string hash of the bytes, in 32 bits."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(_MASK))


def mixed_hash(name: Column, seed: int) -> Column:
    """Six integer mixing steps over the seeded name hash. Each is a fold over one element, so no step's input is written out twice."""
    steps = (
        lambda k: (k + _MASK - (k * 32768).bitwiseAND(_MASK)).bitwiseAND(_MASK),
        lambda k: k.bitwiseXOR(F.shiftright(k, 10)),
        lambda k: (k + 8 * k).bitwiseAND(_MASK),
        lambda k: k.bitwiseXOR(F.shiftright(k, 6)),
        lambda k: (k + _MASK - (k * 2048).bitwiseAND(_MASK)).bitwiseAND(_MASK),
        lambda k: k.bitwiseXOR(F.shiftright(k, 16)),
    )
    out = F.array(name_hash(name).bitwiseXOR(F.lit(seed).cast("long")))
    for step in steps:
        out = F.transform(out, step)
    return out[0]


def keep_fraction(name: Column, fraction: Column | float, seed: int) -> Column:
    fraction = F.lit(float(fraction)) if isinstance(fraction, (int, float)) else fraction
    return mixed_hash(name, seed).bitwiseAND(0xFFFFFF) / 16777216.0 < fraction


def keep_fraction_fast(name: Column, fraction: float, seed: int) -> Column:
    """Another deterministic subsample of whole pairs, cheaper than ``keep_fraction``."""
    return F.pmod(F.xxhash64(F.lit(seed), name), F.lit(1 << 24)) < int(fraction * (1 << 24))
