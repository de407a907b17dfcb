"""Parquet tables: row positions, tagged inputs, checked count and label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tokentide.operators.ordering import with_running_total
from tokentide.schema import checked_count, checked_label, require_absent, require_type
from tokentide.session import materialize


def read_table(
    spark: SparkSession, path: str, partitions: int | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """A parquet table with all its columns, read as it lies.

    Only if the caller gives a number of ``partitions`` are its rows dealt to so many by
    ``key`` (a unique key): for files of fewer splits than there are cores. Splits
    themselves are set by ``spark.sql.files.maxPartitionBytes``.
    """
    table = spark.read.parquet(path)
    return table if partitions is None else table.repartition(partitions, *key)


def with_row_id(table: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the 0-based position of each row of a parquet scan in file order.

    The position is the row's index in its own file plus the rows of the files before
    it by path. Counting rows per file reads no column data; the counts are summed over
    sorted blocks of files, so no task holds all of them, and are joined by the path, as
    Spark's own size check chooses.
    """
    require_absent(table, [name])
    path = F.col("_metadata.file_path")
    counts = materialize(table.select(path.alias("_path")).groupBy("_path").agg(F.count(F.lit(1)).alias("_rows")), "file-rows")
    # Written, so that its size is known where it is joined.
    offsets = materialize(
        with_running_total(counts, ["_path"], F.col("_rows"), name="_before").select("_path", "_before"), "file-offsets"
    )
    return (
        table.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_index"))
        .join(offsets, "_path", "left")
        .withColumn(name, F.col("_before") + F.col("_index"))
        .drop("_path", "_index", "_before")
    )


def tag_inputs(inputs: Sequence[DataFrame], name: str = "input_id") -> DataFrame:
    """Bag union of several inputs, each row tagged with the position of its input.

    The tag is the position, not the path, so an input given twice counts twice.
    """
    if not inputs:
        raise ValueError("no inputs")
    for frame in inputs:
        require_absent(frame, [name])
    tagged = [frame.withColumn(name, F.lit(index)) for index, frame in enumerate(inputs)]
    union = tagged[0]
    for frame in tagged[1:]:
        union = union.unionByName(frame)
    return union


def read_counts(
    spark: SparkSession, path: str, column: str, key: str | None = None, label: str | None = None
) -> DataFrame:
    """One count column of a table as (row_id, tokens), and a label column if named.

    Reads only these columns. Without ``key`` rows are identified by file position.
    A missing column, another type, or a null or negative count is an error.
    """
    table = spark.read.parquet(path)
    require_type(table, column, T.IntegerType)
    if label is not None:
        require_type(table, label, T.StringType)
    keyed = with_row_id(table) if key is None else table.withColumn("row_id", F.col(key))
    columns = [F.col("row_id"), checked_count(F.col(column), f"{path} {column}").alias("tokens")]
    if label is not None:
        columns.append(checked_label(F.col(label), f"{path} {label}").alias("label"))
    return keyed.select(*columns)
