"""Alignment of one count table per tokenizer into one row per item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokentide.schema import parse_dataset, parse_named
from tokentide.sources.tables import read_counts


@dataclass(frozen=True)
class TokenizerSet:
    """The compared tokenizers in order: name to count column, and the primary one."""

    columns: Mapping[str, str]
    primary: str

    @classmethod
    def of(cls, columns: Mapping[str, str] | Sequence[str], primary: str | None = None) -> TokenizerSet:
        """From a mapping, from ``NAME=COLUMN`` texts, or from names that are columns.

        At least two tokenizers with different names and columns; the primary defaults
        to the first.
        """
        if isinstance(columns, Mapping):
            pairs = list(columns.items())
        else:
            pairs = [
                parse_named(entry, "NAME=COLUMN") if "=" in entry else (entry, entry) for entry in columns
            ]
        if len(pairs) < 2:
            raise ValueError("at least two tokenizers are needed")
        for values in zip(*pairs):
            if len(set(values)) < len(values):
                raise ValueError(f"repeated tokenizer name or column in {values}")
        chosen = pairs[0][0] if primary is None else primary
        if chosen not in dict(pairs):
            raise ValueError(f"primary {chosen!r} is not among {[name for name, _ in pairs]}")
        return cls(dict(pairs), chosen)

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    @property
    def others(self) -> list[str]:
        return [name for name in self.columns if name != self.primary]


def dataset_paths(
    datasets: Mapping[str, Sequence[str]] | Sequence[str], tokenizers: TokenizerSet
) -> dict[str, list[str]]:
    """Label to paths, from a mapping or ``LABEL=path,...`` texts: one path per tokenizer."""
    if not isinstance(datasets, Mapping):
        datasets = dict(map(parse_dataset, datasets))
    for label, paths in datasets.items():
        if len(paths) != len(tokenizers.names):
            raise ValueError(
                f"dataset {label!r} has {len(paths)} paths for {len(tokenizers.names)} tokenizers"
            )
    return {label: list(paths) for label, paths in datasets.items()}


def align(
    tables: Mapping[str, Mapping[str, DataFrame]], tokenizers: TokenizerSet
) -> DataFrame:
    """One row per item: dataset, row_id, group (if any), one long count per tokenizer.

    ``tables`` gives per dataset and tokenizer the rows (row_id, tokens), with a
    ``label`` column in the first one if there is a group. All of them are stacked and
    meet in one shuffle on (dataset, row_id); an item some tokenizer lacks, or has
    twice, is an error.
    """
    stacked = None
    grouped = False
    for dataset, by_name in tables.items():
        for name in tokenizers.names:
            table = by_name[name]
            labelled = "label" in table.columns
            grouped |= labelled
            rows = table.select(
                F.lit(dataset).alias("dataset"),
                "row_id",
                F.lit(name).alias("_tokenizer"),
                "tokens",
                (F.col("label") if labelled else F.lit(None).cast("string")).alias("group"),
            )
            stacked = rows if stacked is None else stacked.unionByName(rows)
    if stacked is None:
        raise ValueError("no datasets")

    def of(name: str):
        return F.when(F.col("_tokenizer") == name, F.col("tokens"))

    complete = F.lit(True)
    for name in tokenizers.names:
        complete = complete & (F.count_if(F.col("_tokenizer") == name) == 1)
    gap = F.raise_error(
        F.concat_ws(" ", F.lit("row not counted once by every tokenizer:"), F.col("dataset"), F.col("row_id"))
    )
    # A text aggregate sorts its input, so the group takes part only if there is one.
    labels = [F.max("group").alias("group")] if grouped else []
    joined = stacked.groupBy("dataset", "row_id").agg(
        *labels,
        *[F.max(of(name)).alias(name) for name in tokenizers.names],
        complete.alias("_complete"),
    )
    checked = [
        F.when(F.col("_complete"), F.col(f"`{name}`")).otherwise(gap.cast("long")).alias(name)
        for name in tokenizers.names
    ]
    return joined.select("dataset", "row_id", *(["group"] if grouped else []), *checked)


def align_files(
    spark: SparkSession,
    datasets: Mapping[str, Sequence[str]] | Sequence[str],
    tokenizers: TokenizerSet,
    group: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Align parquet count tables, by file position or by a key column they carry.

    The group column, if any, is read from each dataset's first table.
    """
    tables = {
        dataset: {
            name: read_counts(
                spark, path, tokenizers.columns[name], key, group if name == tokenizers.names[0] else None
            )
            for name, path in zip(tokenizers.names, paths)
        }
        for dataset, paths in dataset_paths(datasets, tokenizers).items()
    }
    return align(tables, tokenizers)
