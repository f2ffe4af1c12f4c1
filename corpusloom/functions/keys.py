"""Pseudo-random keys that depend on the row alone, never on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(c: str | Column, seed: int | str) -> Column:
    """md5 of id and seed as text: any engine gives the same order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(col.cast("string"), F.lit(str(seed))))


def seeded_uniform(c: str | Column, seed: int | str) -> Column:
    """Uniform in (0, 1]: the first 52 bits of the seeded hash."""
    bits = F.conv(F.substring(seeded_hash(c, seed), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 1) / F.lit(float(2 ** 52))


def weighted_key(c: str | Column, weight: Column, seed: int | str) -> Column:
    """Efraimidis-Spirakis key; the k smallest are a weighted sample without replacement."""
    return -F.ln(seeded_uniform(c, seed)) / weight
