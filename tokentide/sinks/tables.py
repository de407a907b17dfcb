"""Parquet outputs: counted tables and two-way splits."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokentide.functions.buckets import LONG_CONTEXT
from tokentide.functions.tokenizers import Tokenizer
from tokentide.operators.counting import count_tokens
from tokentide.operators.split import HIGH, LOW, with_band
from tokentide.schema import valid_tag

SIDE = "split_side"  # partition column of a written split


def counted_path(path: str, tag: str) -> str:
    """``{stem}.{tag}_tokens.parquet`` beside the input."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}{PurePosixPath(name).stem}.{valid_tag(tag)}_tokens.parquet"


def write_counted(
    spark: SparkSession, path: str, text: str, tokenizer: Tokenizer, tag: str, output: str | None = None
) -> str:
    """Count a parquet table and write it with its two new columns; returns the output path."""
    target = output or counted_path(path, tag)
    count_tokens(spark.read.parquet(path), text, tokenizer, tag).write.parquet(target)
    return target


def write_split(
    df: DataFrame, tokens: str, output: str, threshold: int = LONG_CONTEXT
) -> dict[str, int]:
    """Write both sides of a split below ``output`` in one pass; returns rows per side.

    The sides are ``split_side=low`` and ``split_side=high`` with the input's columns,
    none of which may be called split_side. A side without rows is an empty table. The counts come from the written files' footers.
    """
    spark = df.sparkSession
    with_band(df, tokens, threshold, SIDE).write.partitionBy(SIDE).parquet(output)
    found = spark.read.schema(f"{SIDE} string").parquet(output).groupBy(SIDE).count()
    rows = {LOW: 0, HIGH: 0} | {row[SIDE]: row["count"] for row in found.collect()}
    for side, count in rows.items():
        if count == 0:
            df.where(F.lit(False)).write.parquet(f"{output}/{SIDE}={side}")
    return rows


def read_band(spark: SparkSession, output: str, band: str) -> DataFrame:
    """One side of a written split, with the input's columns only."""
    return spark.read.parquet(f"{output}/{SIDE}={band}")
