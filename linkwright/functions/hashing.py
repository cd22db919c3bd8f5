"""Deterministic folds and samples from md5, without 128-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(text: Column, modulus: int) -> Column:
    """md5 of a string as a number, modulo ``modulus``: its 32-bit quarters by Horner's rule."""
    digest, step = F.md5(text.cast("binary")), pow(16, 8, modulus)
    out = F.lit(0).cast("long")
    for i in range(4):
        out = (out * step + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % modulus
    return out


def fold_of(entity_id: Column, folds: int = 5) -> Column:
    return md5_mod(entity_id, folds).cast("int")


def dropped(entity_id: Column, rate: float, salt: str) -> Column:
    """True for a share ``rate`` of ids, independent of the fold."""
    return md5_mod(F.concat(entity_id, F.lit("|" + salt)), 10_000) < rate * 10_000
