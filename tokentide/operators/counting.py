"""Token counts and the long-context flag as new columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tokentide.functions.buckets import LONG_CONTEXT
from tokentide.functions.tokenizers import Tokenizer
from tokentide.schema import require_absent, require_type, valid_tag

FAILED = -1


def token_count(text: Column, tokenizer: Tokenizer) -> Column:
    """Tokens of a text as int: a null text counts as empty, a failed one as -1."""
    counted = tokenizer.count(F.coalesce(text, F.lit("")))
    return F.coalesce(counted.cast("int"), F.lit(FAILED))


def over_limit(tokens: Column, limit: int = LONG_CONTEXT) -> Column:
    """Whether a count exceeds the limit."""
    return tokens > F.lit(limit)


def count_tokens(
    df: DataFrame, text: str, tokenizer: Tokenizer, tag: str, limit: int = LONG_CONTEXT
) -> DataFrame:
    """All columns plus ``{tag}_input_tokens`` and ``{tag}_over_1m``, in that order."""
    tokens, over = f"{valid_tag(tag)}_input_tokens", f"{tag}_over_1m"
    require_type(df, text, T.StringType)
    require_absent(df, [tokens, over])
    counted = df.select("*", token_count(F.col(text), tokenizer).alias(tokens))
    return counted.select("*", over_limit(F.col(tokens), limit).alias(over))


def count_with_all(df: DataFrame, text: str, tokenizers: Sequence[Tokenizer]) -> DataFrame:
    """All columns plus one long count column per tokenizer, named after it."""
    require_type(df, text, T.StringType)
    require_absent(df, [tokenizer.name for tokenizer in tokenizers])
    return df.select(
        "*",
        *[
            token_count(F.col(text), tokenizer).cast("long").alias(tokenizer.name)
            for tokenizer in tokenizers
        ],
    )
