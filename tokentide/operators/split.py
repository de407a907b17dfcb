"""Two-way split of a table at a token threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokentide.functions.buckets import LONG_CONTEXT
from tokentide.schema import require_absent, require_columns

LOW, HIGH = "low", "high"


def within(tokens: Column, threshold: int = LONG_CONTEXT) -> Column:
    """Whether a row belongs to the low side; a null count is 0."""
    return F.coalesce(tokens, F.lit(0)) <= threshold


def with_band(
    df: DataFrame, tokens: str, threshold: int = LONG_CONTEXT, name: str = "band"
) -> DataFrame:
    """All columns plus the side of the split."""
    require_columns(df, [tokens])
    require_absent(df, [name])
    return df.withColumn(name, F.when(within(F.col(tokens), threshold), LOW).otherwise(HIGH))


def split(df: DataFrame, tokens: str, threshold: int = LONG_CONTEXT) -> tuple[DataFrame, DataFrame]:
    """The rows up to the threshold and the rows above it, columns unchanged."""
    require_columns(df, [tokens])
    low = within(F.col(tokens), threshold)
    return df.where(low), df.where(~low)
