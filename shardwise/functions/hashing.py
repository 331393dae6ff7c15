"""Repeatable draws: every random choice is a function of the row key."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int, purpose: str, *key: str | Column) -> Column:
    """Hex digest that orders rows like a seeded shuffle, the same on every run and partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[p.cast("string") for p in parts]))


def uniform(digest: Column, start: int = 1) -> Column:
    """A number in (0, 1] from eight hex digits of a digest."""
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 1.0) / F.lit(float(2**32))


def normal(digest: Column, scale: float = 1.0) -> Column:
    """A normal draw (Box-Muller) from sixteen hex digits of a digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(digest, 1)))
    return F.lit(scale) * radius * F.cos(F.lit(2.0 * math.pi) * uniform(digest, 9))
