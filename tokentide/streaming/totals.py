"""Running totals over finished samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokentide.operators.evaluate import with_average


def running_totals(finished: DataFrame) -> DataFrame:
    """One row over (sample_index, finished_at, prompt_tokens, completion_tokens, label).

    Completed samples, token sums (a missing usage adds 0), their integer average and
    the label of the sample that finished last. The same frame works on a stream in
    complete or update mode, where the state is this one row.
    """
    totals = finished.agg(
        F.count(F.lit(1)).alias("completed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.max_by("label", F.struct("finished_at", "sample_index")).alias("last_finished"),
    )
    return with_average(totals)
