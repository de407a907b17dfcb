"""Small helpers for frames whose columns may clash with those an operator adds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Rows of long texts go through Python in slices of this many, whatever the Arrow batch holds.
SLICE_ROWS = 256


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, added: Iterable[str]) -> tuple[list[Column], list[Column]]:
    """The columns of ``df`` that no added one replaces, under names nobody uses, and back again.

    Names compare without case. The columns stay columns, so those that the caller of an
    operator never reads are pruned before any shuffle.
    """
    taken = {name.lower() for name in added}
    kept = [name for name in df.columns if name.lower() not in taken]
    away = [column(name).alias(f"_in{at}") for at, name in enumerate(kept)]
    return away, [F.col(f"_in{at}").alias(name) for at, name in enumerate(kept)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices that bound what Python holds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``: a coarse step, then those of one step.

    The bounds are one literal text each time, since a plan of a literal per bound is slow to build.
    """
    step = isqrt(len(bounds)) + 1
    number = lambda part, low: F.size(F.filter(part, lambda bound: bound <= low))

    def array(values: list[int]) -> Column:
        listed = F.split(F.lit(",".join(map(str, values))), ",") if values else F.array()
        return listed.cast("array<long>")

    coarse = number(array(bounds[step - 1 :: step]), value) * step
    return coarse + number(F.slice(array(bounds), coarse + 1, F.lit(step)), value)
