"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 26
EPS = 1e-6
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def r6(x: Column) -> Column:
    """Six decimals by one arithmetic that every engine shares."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def clean(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def unit(x: Column, low: Column, high: Column) -> Column:
    """Min-max to [0, 1]; a constant signal is all 0."""
    return F.least(F.greatest((x - low) / (high - low + F.lit(EPS)), F.lit(0.0)), F.lit(1.0))


def level(x: Column, levels: int = LEVELS) -> Column:
    """Quantisation level of a value in [0, 1]."""
    return F.least(F.floor(x * levels), F.lit(levels - 1).cast("long"))


def letter(q: Column) -> Column:
    return F.substring(F.lit(LETTERS), q.cast("int") + 1, F.lit(1))


def letter_level(c: Column) -> Column:
    return (F.instr(F.lit(LETTERS), c) - 1).cast("long")


def denormalised(q: Column, low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The value a level stands for: level / (levels - 1) of the range, without the epsilon of `unit`."""
    return q / F.lit(float(levels - 1)) * (high - low) + low


def hash32(key: Column, seed: int = 42) -> Column:
    """A multiplicative hash in [0, 2^32) from integer arithmetic only; draws keyed by it do not depend on partitions.

    key * 2654435761 + seed modulo 2^32, in 16-bit halves so that no key overflows.
    """
    wide = key.cast("long")
    high, low = F.shiftright(wide, 16).bitwiseAND(F.lit(0xFFFF)), wide.bitwiseAND(F.lit(0xFFFF))
    return F.pmod((high * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536) + low * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))


def uniform(seed: int, *key: Column) -> Column:
    """A draw in (0, 1) from a digest of the key; draws of different seeds are unrelated."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
