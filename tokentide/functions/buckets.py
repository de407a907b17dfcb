"""Length ranges and context limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Range:
    """Token counts from ``low`` up to but without ``high`` (open when None)."""

    label: str
    low: int
    high: int | None

    def holds(self, tokens: Column) -> Column:
        inside = tokens >= self.low
        return inside if self.high is None else inside & (tokens < self.high)


# The ranges of a token profile, closed at the upper thousand.
PROFILE_RANGES = (
    Range("<=8k", 0, 8_001),
    Range("8k-16k", 8_001, 16_001),
    Range("16k-32k", 16_001, 32_001),
    Range("32k-64k", 32_001, 64_001),
    Range("64k-128k", 64_001, 128_001),
    Range("128k-256k", 128_001, 256_001),
    Range("256k-512k", 256_001, 512_001),
    Range("512k-1M", 512_001, 1_000_001),
    Range(">1M", 1_000_001, None),
)
# Upper bounds (exclusive) of the comparison's length buckets.
LENGTH_BOUNDS = (2_000, 8_000, 16_000, 32_000, 64_000, 128_000, 256_000, 512_000, 1_000_000)
# Context limits a row may exceed.
CONTEXT_LIMITS = (128_000, 256_000, 512_000, 1_000_000)
# Fixed value: the long-context limit of a counted row.
LONG_CONTEXT = 1_000_000


def length_bucket(tokens: Column, bounds: Sequence[int] = LENGTH_BOUNDS) -> Column:
    """Index of the first bound above ``tokens``; ``len(bounds)`` when there is none."""
    chain = F
    for index, bound in enumerate(bounds):
        chain = chain.when(tokens < bound, F.lit(index))
    return chain.otherwise(F.lit(len(bounds)))


def short_number(value: int) -> str:
    """1000000 as 1M, 2000 as 2k, anything else in full."""
    for unit, suffix in ((1_000_000, "M"), (1_000, "k")):
        if value % unit == 0:
            return f"{value // unit}{suffix}"
    return str(value)


def bucket_names(bounds: Sequence[int] = LENGTH_BOUNDS) -> list[str]:
    """Labels ``<2k``, ``2k–8k``, ..., ``>=1M``, one more than there are bounds."""
    marks = [short_number(bound) for bound in bounds]
    between = [f"{low}–{high}" for low, high in zip(marks, marks[1:])]
    return [f"<{marks[0]}", *between, f">={marks[-1]}"]


def bucket_label(index: Column, bounds: Sequence[int] = LENGTH_BOUNDS) -> Column:
    """Label of a bucket index."""
    return F.element_at(F.array(*map(F.lit, bucket_names(bounds))), index + 1)
