"""Evaluation results as CSV, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tokentide.operators.evaluate import result_rows

_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_results(results: DataFrame, output: str) -> None:
    """Write the result file with its header."""
    result_rows(results).write.options(**_CSV).csv(output)


def once_per_sample(responses: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of responses (row_id, ..., ts) with the first of each sample that comes.

    A sample is remembered until the watermark passes ``late`` beyond its response, so state
    is bounded; responses without a sample or a time cannot be remembered and are left out, see
    :func:`untimed_responses`. The column ts goes.
    """
    timed = responses.where("row_id IS NOT NULL AND ts IS NOT NULL")
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["row_id"]).drop("ts")


def untimed_responses(responses: DataFrame) -> DataFrame:
    """The responses that :func:`once_per_sample` leaves out, for a stream of their own."""
    return responses.where("row_id IS NULL OR ts IS NULL")


def stream_results(results: DataFrame, output: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each result as its sample finishes; call ``start()`` on it."""
    return (
        result_rows(results)
        .writeStream.format("csv")
        .options(**_CSV)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
