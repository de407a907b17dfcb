"""Text corpora: counted files, natural order, groups and chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tokentide.functions.paths import natural_key, range_label, top_level
from tokentide.functions.tokenizers import Tokenizer
from tokentide.operators.align import TokenizerSet
from tokentide.operators.compare import _ratios, group_totals
from tokentide.operators.counting import count_with_all
from tokentide.operators.ordering import with_position
from tokentide.schema import checked_count


def count_files(
    files: DataFrame, tokenizers: Sequence[Tokenizer], group: Callable[[Column], Column] = top_level
) -> DataFrame:
    """(path, group, chars, one count per tokenizer) of rows (path, text).

    A text some tokenizer fails on is an error.
    """
    counted = count_with_all(
        files.select("path", group(F.col("path")).alias("group"), F.char_length("text").cast("long").alias("chars"), "text"),
        "text",
        tokenizers,
    )
    return counted.select(
        "path",
        "group",
        "chars",
        *[checked_count(F.col(f"`{t.name}`"), t.name).alias(t.name) for t in tokenizers],
    )


def in_natural_order(items: DataFrame) -> DataFrame:
    """Items sorted by group and, inside a group, by natural path order."""
    keyed = items.withColumn("_key", natural_key(F.col("path")))
    return keyed.orderBy("group", "_key", "path").drop("_key")


def details(items: DataFrame, tokenizers: TokenizerSet) -> DataFrame:
    """Per file: characters, counts and ratios to the primary, in natural order."""
    return in_natural_order(
        items.select("group", "path", "chars", *[F.col(f"`{n}`") for n in tokenizers.names], *_ratios(tokenizers))
    )


def file_groups(items: DataFrame, tokenizers: TokenizerSet) -> DataFrame:
    """Per group: files, characters, totals and ratios; no grand total."""
    return group_totals(items, tokenizers, "group", sums=["chars"], grand_total=False)


def with_chunk(items: DataFrame, size: int) -> DataFrame:
    """Add the position in natural order inside the group and the chunk of ``size`` files."""
    if size < 1:
        raise ValueError(f"chunk size must be at least 1, got {size}")
    placed = with_position(items, [natural_key(F.col("path")), "path"], groups=["group"])
    return placed.withColumn("chunk", F.floor(F.col("position") / size))


def chunk_totals(items: DataFrame, tokenizers: TokenizerSet, size: int) -> DataFrame:
    """Per chunk of ``size`` files: labels of the first and last file, totals and ratios."""
    grouped = (
        with_chunk(items, size)
        .groupBy("group", "chunk")
        .agg(
            F.min_by("path", "position").alias("_first"),
            F.max_by("path", "position").alias("_last"),
            F.count(F.lit(1)).alias("items"),
            F.sum("chars").alias("chars"),
            *[F.sum(f"`{name}`").alias(name) for name in tokenizers.names],
        )
    )
    return grouped.select(
        "group",
        "chunk",
        range_label(F.col("group"), F.col("_first")).alias("first"),
        range_label(F.col("group"), F.col("_last")).alias("last"),
        "items",
        "chars",
        *[F.col(f"`{name}`") for name in tokenizers.names],
        *_ratios(tokenizers),
    )
