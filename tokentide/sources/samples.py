"""Benchmark samples: prompt, truth set, problem type, optional token count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tokentide.functions.answers import as_set
from tokentide.operators.ordering import nth_smallest
from tokentide.schema import require_type
from tokentide.sources.tables import with_row_id

# The columns of a sample table; the name of the count column is a parameter.
PROMPT, ANSWERS, PROBLEM_TYPE = "prompt", "answer_nodes", "problem_type"
INPUT_TOKENS = "input_tokens"


def read_samples(
    spark: SparkSession, path: str, max_samples: int | None = None, tokens: str = INPUT_TOKENS
) -> DataFrame:
    """Samples of a table in file order, cut to the first ``max_samples`` if given."""
    samples = as_samples(with_row_id(spark.read.parquet(path)), tokens=tokens)
    # Row ids are positions, so the first rows are a filter.
    return samples if max_samples is None else samples.where(F.col("row_id") < max_samples)


def as_samples(table: DataFrame, row_id: str = "row_id", tokens: str = INPUT_TOKENS) -> DataFrame:
    """(row_id, prompt, truth, problem_type, input_tokens) of a sample table.

    A null truth list is the empty set, a null prompt or type is the empty string, and
    the token column may be missing.
    """
    for column in (PROMPT, PROBLEM_TYPE):
        require_type(table, column, T.StringType)
    require_type(table, ANSWERS, T.ArrayType)
    counts = F.lit(None).cast("int")
    if tokens in table.columns:
        require_type(table, tokens, T.IntegerType)
        counts = F.col(tokens)
    return table.select(
        F.col(row_id).cast("long").alias("row_id"),
        F.coalesce(PROMPT, F.lit("")).alias("prompt"),
        as_set(F.col(ANSWERS)).alias("truth"),
        F.coalesce(PROBLEM_TYPE, F.lit("")).alias("problem_type"),
        counts.alias("input_tokens"),
    )


def of_type(samples: DataFrame, problem_type: str = "all") -> DataFrame:
    """Samples of one problem type (``all`` keeps every one), with their row ids."""
    if problem_type == "all":
        return samples
    return samples.where(F.col("problem_type") == problem_type)


def first_samples(samples: DataFrame, count: int) -> DataFrame:
    """The first ``count`` samples in row order, of samples that may be filtered.

    Row ids alone are counted for the last id that is taken; all ids up to it are a filter
    that reaches the scan. Rows that repeat that id come with it.
    """
    if count < 1:
        return samples.limit(0)
    last = nth_smallest(samples, "row_id", count)
    return samples if last is None else samples.where(F.col("row_id") <= last)
