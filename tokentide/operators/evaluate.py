"""Evaluation of model responses against set-valued truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.functions.answers import EXACT_F1, final_answer, set_score
from tokentide.functions.chat import chat_request, parsed_response, read_response
from tokentide.functions.numbers import fixed4

# The F1 ranges by their exclusive upper bound.
F1_RANGES = (("= 0", 0.001), ("(0, 0.5)", 0.5), ("[0.5, 0.8)", 0.8), ("[0.8, 1.0)", EXACT_F1), ("= 1.0", None))


def build_requests(
    samples: DataFrame, model: str, effort: str | None = None, stream: bool = False
) -> DataFrame:
    """(row_id, request): one chat request body per sample, for a batch inference job."""
    return samples.select("row_id", chat_request(F.col("prompt"), model, effort, stream).alias("request"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(row_id, content, reasoning, usage, error) of rows (row_id, status, body)."""
    parsed = responses.withColumn("_parsed", parsed_response(F.col("body")))
    read = read_response(F.col("status"), F.col("body"), F.col("_parsed"))
    return parsed.select("row_id", read.alias("r")).select("row_id", "r.*")


def score_responses(samples: DataFrame, parsed: DataFrame) -> DataFrame:
    """Evaluation results: every sample with its response, extracted set and scores.

    A sample without a response, or with a failed one, has an error, an empty
    prediction and zero scores. Of several responses to one sample one counts: a good
    one before a failed one, then the first by its content. The prompt takes no part,
    so it is not shuffled.
    """
    first = W.partitionBy("row_id").orderBy(F.col("error").isNotNull(), "content", "error", "reasoning")
    chosen = parsed.withColumn("_choice", F.row_number().over(first)).where("_choice = 1").drop("_choice")
    return _scored(_unprompted(samples).join(chosen, "row_id", "left"))


def score_arrivals(samples: DataFrame, parsed: DataFrame) -> DataFrame:
    """Evaluation results of the responses that have arrived, for a stream of them.

    Every response that arrives is a result, a second one to the same sample too, unless
    :func:`tokentide.sinks.results.once_per_sample` stands before.
    """
    return _scored(parsed.join(_unprompted(samples), "row_id"))


def _unprompted(samples: DataFrame) -> DataFrame:
    return samples.select("row_id", "problem_type", "truth", "input_tokens")


def _scored(joined: DataFrame) -> DataFrame:
    answered = F.col("content").isNotNull()
    results = joined.withColumn(
        "error", F.when(~answered, F.coalesce("error", F.lit("no response")))
    ).withColumn("predicted", final_answer(F.col("content")))
    scored = results.withColumn("_score", set_score(F.col("predicted"), F.col("truth")))
    failed = F.col("error").isNotNull()
    return scored.select(
        "row_id",
        "problem_type",
        "predicted",
        "truth",
        *[
            F.when(failed, F.lit(0.0)).otherwise(F.col(f"_score.{name}")).alias(name)
            for name in ("recall", "precision", "f1")
        ],
        F.coalesce("content", F.lit("")).alias("response"),
        "reasoning",
        "usage",
        "input_tokens",
        "error",
    )


def succeeded(results: DataFrame) -> DataFrame:
    """Results without an error."""
    return results.where(F.col("error").isNull())


def failed(results: DataFrame) -> DataFrame:
    """Results with an error."""
    return results.where(F.col("error").isNotNull())


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row: samples, errors, exact matches and their share, mean scores of successes."""
    good = F.col("error").isNull()

    def mean_of(name: str):
        return F.coalesce(F.avg(F.when(good, F.col(name))), F.lit(0.0)).alias(f"mean_{name}")

    counted = results.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~good).alias("errors"),
        F.count_if(good & (F.col("f1") >= EXACT_F1)).alias("exact_matches"),
        *[mean_of(name) for name in ("recall", "precision", "f1")],
    )
    successes = F.greatest(F.col("samples") - F.col("errors"), F.lit(1))
    return counted.select("*", (F.col("exact_matches") / successes * 100).alias("exact_share"))


def f1_histogram(results: DataFrame) -> DataFrame:
    """Successful results per F1 range, empty ranges included."""
    f1, good = F.col("f1"), F.col("error").isNull()
    low = None
    counts = []
    for label, high in F1_RANGES:
        inside = good
        if low is not None:
            inside = inside & (f1 >= low)
        if high is not None:
            inside = inside & (f1 < high)
        counts.append(F.count_if(inside).alias(label))
        low = high
    wide = results.agg(*counts)
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.lit(label).alias("f1_range"), F.col(f"`{label}`").alias("results"))
                    for i, (label, _) in enumerate(F1_RANGES)
                ]
            )
        ).alias("r")
    ).select("r.*")


def f1_by_type(results: DataFrame) -> DataFrame:
    """Successful results and mean F1 per problem type."""
    return succeeded(results).groupBy("problem_type").agg(
        F.count(F.lit(1)).alias("results"), F.avg("f1").alias("mean_f1")
    )


def defects(results: DataFrame, most: int | None = None) -> DataFrame:
    """Errors and inexact results in row order.

    With ``most``, a limit of a short listing, none at all if there are more than that.
    ``results`` is then read twice: write it before if it is costly to compute.
    """
    wrong = results.where(F.col("error").isNotNull() | (F.col("f1") < EXACT_F1))
    if most is None:
        return wrong.orderBy("row_id")
    # One row more than is shown tells whether there are too many. Only ids are ordered and
    # counted; the rows with their texts are fetched by them.
    head = wrong.select("row_id").orderBy("row_id").limit(most + 1)
    shown = head.withColumn("_shown", F.count(F.lit(1)).over(W.partitionBy())).where(F.col("_shown") <= most)
    return wrong.join(shown.select("row_id"), "row_id", "left_semi").orderBy("row_id")


def usage_totals(results: DataFrame) -> DataFrame:
    """One row: completed samples (failed ones too), token sums and their integer average."""
    summed = results.agg(
        F.count(F.lit(1)).alias("completed"),
        F.coalesce(F.sum("usage.prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("usage.completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )
    return with_average(summed)


def with_average(totals: DataFrame) -> DataFrame:
    """Add the integer average of tokens per completed sample, 0 when there is none."""
    average = F.expr("(prompt_tokens + completion_tokens) div completed")
    return totals.withColumn(
        "average_tokens", F.when(F.col("completed") > 0, average).otherwise(F.lit(0))
    )


def result_rows(results: DataFrame) -> DataFrame:
    """The 17 columns of the result file: formatted scores, joined sets, defaults filled in."""

    def one_line(text: str | Column):
        return F.regexp_replace(text, "\r\n|\r|\n", " ")

    def joined(name: str):
        return one_line(F.nullif(F.array_join(F.sort_array(name), ";"), F.lit("")))

    zero = F.lit(0).cast("long")
    usage = {
        "api_prompt_tokens": "prompt_tokens",
        "api_completion_tokens": "completion_tokens",
        "api_total_tokens": "total_tokens",
        "api_cache_hit_tokens": "cache_hit_tokens",
        "api_cache_miss_tokens": "cache_miss_tokens",
        "api_reasoning_tokens": "reasoning_tokens",
    }
    return results.select(
        F.col("row_id").alias("index"),
        one_line("problem_type").alias("problem_type"),
        *[fixed4(F.col(name)).alias(name) for name in ("recall", "precision", "f1")],
        one_line("error").alias("error"),
        one_line("response").alias("response"),
        one_line("reasoning").alias("reasoning_content"),
        joined("predicted").alias("predicted"),
        joined("truth").alias("ground_truth"),
        *[F.coalesce(F.col(f"usage.{field}"), zero).alias(name) for name, field in usage.items()],
        F.coalesce("input_tokens", F.lit(-1)).alias("local_input_tokens"),
    )
