"""Token-length profiles over all rows, by group, by input, and by both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tokentide.functions.buckets import LONG_CONTEXT, PROFILE_RANGES, Range
from tokentide.functions.numbers import mean, share
from tokentide.schema import require_columns


def token_profile(
    df: DataFrame,
    tokens: str,
    group: str | None = None,
    input_id: str | None = None,
    ranges: Sequence[Range] = PROFILE_RANGES,
    limit: int = LONG_CONTEXT,
) -> DataFrame:
    """One row per level: ``all``, ``group``, ``input`` and ``input_group``.

    Rows with a null count are left out; rows with a null group are in no group. A
    negative count (a failed row) is in ``total``, ``min`` and ``max``, adds nothing to
    ``sum`` and lies in no range. ``by_range`` lists (range, rows) in range order.

    Rows are folded to one state per (input, group) first and the levels are merged from
    these states, so the table is not multiplied by the number of levels. A group column
    the table lacks gives no groups.
    """
    require_columns(df, [tokens] + ([input_id] if input_id else []))
    count = F.col(tokens)
    has_group = group is not None and group in df.columns
    states = (
        df.where(count.isNotNull())
        .select(
            (F.col(input_id) if input_id else F.lit(0)).alias("input_id"),
            (F.col(group) if has_group else F.lit(None).cast("string")).alias("group"),
            count.alias("_tokens"),
        )
        .groupBy("input_id", "group")
        .agg(*_states(F.col("_tokens"), ranges, limit))
    )
    # An empty table still has an overall row.
    nothing = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(None).cast(states.schema["input_id"].dataType).alias("input_id"),
        F.lit(None).cast(states.schema["group"].dataType).alias("group"),
        *[
            F.lit(None if name in ("min", "max") else 0).cast(states.schema[name].dataType).alias(name)
            for name in states.columns[2:]
        ],
    )
    levels = [[]]
    if has_group:
        levels.append([F.col("group")])
    if input_id:
        levels.append([F.col("input_id")])
    if input_id and has_group:
        levels.append([F.col("input_id"), F.col("group")])
    merged = (
        states.unionByName(nothing)
        .groupingSets(levels, F.col("input_id"), F.col("group"))
        .agg(
            F.grouping("input_id").alias("_all_inputs"),
            F.grouping("group").alias("_all_groups"),
            *[
                (F.min(name) if name == "min" else F.max(name) if name == "max" else F.sum(name)).alias(name)
                for name in states.columns[2:]
            ],
        )
        .where((F.col("_all_inputs") == 1) | F.col("input_id").isNotNull())
        .where((F.col("_all_groups") == 1) | F.col("group").isNotNull())
    )
    level = (
        F.when(F.col("_all_inputs") + F.col("_all_groups") == 2, "all")
        .when(F.col("_all_inputs") == 1, "group")
        .when(F.col("_all_groups") == 1, "input")
        .otherwise("input_group")
    )
    by_range = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(r.label).alias("range"), F.col(f"_range_{i}").alias("rows"))
            for i, r in enumerate(ranges)
        ]
    )
    return merged.select(
        level.alias("level"),
        "input_id",
        "group",
        "total",
        F.col("sum").alias("sum_tokens"),
        F.coalesce("min", F.lit(0)).alias("min_tokens"),
        F.coalesce("max", F.lit(0)).alias("max_tokens"),
        mean(F.col("sum"), F.col("total")).alias("mean_tokens"),
        "over_limit",
        by_range.alias("by_range"),
    )


def _states(count: Column, ranges: Sequence[Range], limit: int) -> list[Column]:
    """Mergeable aggregates of a profile."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.sum(F.greatest(count, F.lit(0))).alias("sum"),
        F.min(count).alias("min"),
        F.max(count).alias("max"),
        F.count_if(count > limit).alias("over_limit"),
        *[F.count_if(r.holds(count)).alias(f"_range_{i}") for i, r in enumerate(ranges)],
    ]


def token_histogram(profile: DataFrame) -> DataFrame:
    """Rows and share per length range for every row of a profile, empty ranges included."""
    return profile.select(
        "level", "input_id", "group", "total", F.explode("by_range").alias("r")
    ).select(
        "level",
        "input_id",
        "group",
        F.col("r.position").alias("position"),
        F.col("r.range").alias("range"),
        F.col("r.rows").alias("rows"),
        share(F.col("r.rows"), F.col("total")).alias("share"),
    )


def category_frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per category, most frequent first; a null counts as ``""``."""
    require_columns(df, [column])
    counted = df.groupBy(F.coalesce(column, F.lit("")).alias("category")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    total = counted.agg(F.sum("rows")).scalar()
    return counted.select(
        "category", "rows", share(F.col("rows"), total).alias("share")
    ).orderBy(F.desc("rows"), "category")


def head_and_tail(df: DataFrame, row_id: str, columns: Sequence[str], count: int = 5) -> DataFrame:
    """The first and the last ``count`` rows with their row ids, in row order.

    A table shorter than twice ``count`` shows a row in both parts.
    """
    shown = df.select(F.col(row_id).alias("row_id"), *columns)
    first = shown.orderBy("row_id").limit(count).withColumn("part", F.lit("first"))
    last = shown.orderBy(F.desc("row_id")).limit(count).withColumn("part", F.lit("last"))
    return first.unionByName(last).orderBy("part", "row_id")
