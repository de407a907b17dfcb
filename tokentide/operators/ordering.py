"""Positions, running totals and exact quantiles that never gather a group in one task.

A plain ``row_number`` over a group, or ``percentile`` over a column, puts a whole
group in one task. For positions and totals rows are sorted over range partitions, one small
row per partition and group carries what stands before it, and only those are summed in a
window over all. Quantiles need no order of rows: values are counted in buckets whose order is
known, and only the buckets that hold a wanted rank are divided again. A group holding most of
the table is spread like any other, and a table of any size takes the same way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.schema import require_absent
from tokentide.session import materialize

_FIRST_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _with_keys(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, list[str]]:
    """Order expressions as columns, or a sort would evaluate them at every comparison."""
    named = [F.col(key) if isinstance(key, str) else key for key in order]
    keys = {f"_order_{i}": key for i, key in enumerate(named)}
    return df.withColumns(keys), list(keys)


def _sorted_blocks(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted over range partitions, with ``_at`` (increasing) and its ``_block``.

    Written out, since range bounds are sampled anew each time a sort is planned.
    """
    keyed, keys = _with_keys(df, order)
    ordered = keyed.orderBy(*groups, *keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    return materialize(ordered, "sorted").withColumn("_block", F.shiftright("_at", _FIRST_BITS))


def _join_blocks(rows: DataFrame, blocks: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with the columns of their (group, block); null groups match themselves."""
    keyed = blocks.select(
        *[F.col(name).alias(f"_key_{i}") for i, name in enumerate(groups)],
        F.col("_block").alias("_key_block"),
        *[name for name in blocks.columns if name not in (*groups, "_block")],
    )
    match = F.col("_block") == F.col("_key_block")
    for i, name in enumerate(groups):
        match = match & F.col(name).eqNullSafe(F.col(f"_key_{i}"))
    keys = [f"_key_{i}" for i in range(len(groups))]
    return rows.join(keyed, match).drop("_key_block", *keys)


def with_running_total(
    df: DataFrame,
    order: Sequence[str | Column],
    value: Column,
    groups: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Add the sum of ``value`` over the rows that come before each row in its group.

    All columns of ``df`` are sorted and written once, so pass keys rather than texts.
    Sorting samples its input: materialize ``df`` before if it is costly to compute.
    """
    require_absent(df, [name])
    rows = _sorted_blocks(df.withColumn("_value", value), groups, order)
    blocks = rows.groupBy(*groups, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = W.partitionBy(*groups).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(*groups, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*groups, "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    placed = _join_blocks(summed, starts, groups)
    return placed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_at", "_block", "_start", "_inside", "_value")


def with_position(
    df: DataFrame,
    order: Sequence[str | Column],
    groups: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row in its group under a total order.

    All columns of ``df`` are sorted and written once, so pass keys rather than texts.
    Sorting samples its input: materialize ``df`` before if it is costly to compute.
    """
    require_absent(df, [name])
    rows = _sorted_blocks(df, groups, order)
    blocks = rows.groupBy(*groups, "_block").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = W.partitionBy(*groups).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        *groups,
        "_block",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    placed = _join_blocks(rows, starts, groups)
    return placed.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_block", "_shift")


# Buckets of a value: so many to a doubling at first, then so many equal parts of one that is
# looked into again. After a look and three divisions a bucket is narrower than any two doubles.
_PER_DOUBLING, _PARTS, _LOOKS = 4_096, 65_536, 4
_NAN_BUCKET = 1 << 40


def _magnitude(value: str) -> str:
    """SQL of a bucket number that never falls as a value rises; NaN has the last, infinities their own."""
    steps = f"greatest(least(log2(abs({value})), 1025D), -1075D) * {_PER_DOUBLING}"
    size = f"(CAST(floor({steps}) AS BIGINT) + {1076 * _PER_DOUBLING})"
    return (
        f"CASE WHEN isnan({value}) THEN {_NAN_BUCKET}L WHEN {value} > 0 THEN {size}"
        f" WHEN {value} < 0 THEN -{size} WHEN {value} = 0 THEN 0L END"
    )


def _buckets(stacked: DataFrame, part: Sequence[str]) -> DataFrame:
    """Rows, smallest and largest value of each bucket, and the rows in buckets before it."""
    folded = stacked.groupBy(*part, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    # Bounded by the range of doubles: as many rows as buckets, some ten thousand in common data.
    through = W.partitionBy(*part).orderBy("bucket")
    return folded.withColumns(
        {"before": F.sum("n").over(through) - F.col("n"), "total": F.sum("n").over(W.partitionBy(*part))}
    )


def _ranks(quantile: float, total: int) -> tuple[int, int]:
    exact = quantile * (total - 1)
    return math.floor(exact), math.ceil(exact)


def exact_quantiles(
    df: DataFrame, measures: Mapping[str, tuple[Column, Sequence[float]]]
) -> DataFrame:
    """Exact quantiles of several measures as (measure, quantile, value).

    The value at ``q`` interpolates linearly at rank ``q * (n - 1)`` of the values that
    are not null; NaN sorts last. A measure without values has no row.

    Values are counted by order of magnitude; the buckets that hold a wanted rank, two for
    each quantile at most, are divided into equal parts and counted again, until each holds one
    value, which takes four looks at most. Nothing is sorted but bucket numbers. ``df`` is read
    at each look: write it before if it is costly to compute.
    """
    names = list(measures)
    spark = df.sparkSession
    narrow = df.select(*[column.cast("double").alias(f"v{i}") for i, (column, _) in enumerate(measures.values())])
    probes = [sorted({float(q) for q in quantiles}) for _, quantiles in measures.values()]

    # Expressions over many literals are written as SQL: one text instead of a call for each.
    def stacked(entries: Sequence[str]) -> DataFrame:
        return narrow.select(F.expr(f"inline(array({', '.join(entries)}))")).where("bucket IS NOT NULL")

    def entry(i: int, parent: str, bucket: str) -> str:
        return f"named_struct('m', {i}, 'parent', {parent}, 'bucket', {bucket}, 'value', v{i})"

    def per_measure(lists: Sequence[Sequence[float | int]], kind: str) -> str:
        listed = (f"CAST(array({', '.join(f'{x!r}D' if kind == 'double' else f'{x}L' for x in own)}) AS array<{kind}>)" for own in lists)
        return f"element_at(array({', '.join(listed)}), m + 1)"

    first = _buckets(stacked([entry(i, "0", _magnitude(f"v{i}")) for i in range(len(names))]), ["m"])
    inside = "{0} >= before AND {0} < before + n".format
    low_rank, high_rank = "floor(q * (total - 1))", "ceil(q * (total - 1))"
    hit = f"exists({per_measure(probes, 'double')}, q -> {inside(low_rank)} OR {inside(high_rank)})"
    found = first.where(hit).collect()
    totals = {row.m: row.total for row in found}
    wanted = {m: sorted({rank for q in probes[m] for rank in _ranks(q, total)}) for m, total in totals.items()}
    values: dict[tuple[int, int], float] = {}
    for _ in range(_LOOKS):
        parents: list[list] = [[] for _ in names]
        for row in found:
            ranks = [rank for rank in wanted[row.m] if row.before <= rank < row.before + row.n]
            if row.low == row.high or math.isnan(row.low):
                values |= {(row.m, rank): row.low for rank in ranks}
            elif ranks:
                parents[row.m].append((row.low, row.high, row.before))
        if not any(parents):
            break
        entries = []
        for i, own in enumerate(parents):
            if own:
                cases = [f"WHEN v{i} >= {low!r}D AND v{i} <= {high!r}D THEN" for low, high, _ in own]
                parent = " ".join(f"{case} {at}" for at, case in enumerate(cases))
                part = " ".join(
                    f"{case} CAST(floor((v{i} - {low!r}D) / {high - low!r}D * {_PARTS}) AS BIGINT)"
                    for case, (low, high, _) in zip(cases, own)
                )
                entries.append(entry(i, f"CASE {parent} END", f"CASE {part} END"))
        starts = per_measure([[before for _, _, before in own] for own in parents], "bigint")
        ranks = per_measure([wanted.get(m, []) for m in range(len(names))], "bigint")
        divided = _buckets(stacked(entries), ["m", "parent"]).withColumn("before", F.expr(f"before + get({starts}, parent)"))
        found = divided.where(f"exists({ranks}, r -> {inside('r')})").collect()
    rows = []
    for m, total in totals.items():
        for q in probes[m]:
            low, high = (values[m, rank] for rank in _ranks(q, total))
            share = q * (total - 1) - math.floor(q * (total - 1))
            rows.append(f"({m}, {q!r}D, double('{low if low == high else low + (high - low) * share!r}'))")
    if not rows:
        return spark.createDataFrame([], "measure string, quantile double, value double")
    told = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(m, quantile, value)")
    return told.select(F.element_at(F.array(*map(F.lit, names)), F.col("m") + 1).alias("measure"), "quantile", "value")


def nth_smallest(df: DataFrame, column: str, n: int) -> int | None:
    """The ``n``-th smallest whole number of a column, counted from 1; null if there are fewer.

    Numbers are counted by their leading bits in which they differ, 16 at a time, so the range
    of ids decides how often the column is read, five times at most, and nothing is sorted.
    """
    numbers = df.select(F.col(column).cast("long").alias("value")).where("value IS NOT NULL")
    total, low, high = numbers.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
    if n < 1 or total < n:
        return None
    while low != high:
        # Numbers of both signs differ in the first bit, which an arithmetic shift keeps in order.
        differing = 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
        here = numbers.where(F.col("value").between(low, high))
        bucket = F.shiftright("value", max(0, differing - 16))
        counted = _buckets(here.withColumns({"bucket": bucket, "m": F.lit(0)}), ["m"])
        own = counted.where((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).first()
        n, low, high = n - own.before, own.low, own.high
    return low
