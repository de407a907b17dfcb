"""Queries over response streams, in batch and as streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokentide.functions.numbers import per_second
from tokentide.operators.evaluate import parse_responses, result_rows, score_arrivals
from tokentide.plans.evaluating_queries import _RESULT_FILE_SQL, _samples, read_result_file, results
from tokentide.plans.inputs import RESPONSES_SQL, response_lines, responses, stream_lines, ticks
from tokentide.plans.jobs import evaluate_lines
from tokentide.plans.registry import query
from tokentide.session import materialize, scratch_path, state_settings
from tokentide.sinks.results import once_per_sample, stream_results
from tokentide.streaming.assemble import USAGE_FIELDS, as_responses, assemble, assemble_stream, ticks_from_lines
from tokentide.streaming.rates import (
    WINDOW_SECONDS, active_requests, live_rate, live_rate_stream, merge_active, request_states,
)
from tokentide.streaming.totals import running_totals

RATE_WINDOW = 6 * 3600.0  # the events are sparse


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a streaming query over everything there is, into a table."""
    spark = stream.sparkSession
    output = scratch_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
    )
    with state_settings(spark):
        running = writer.start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)


def _drain_batches(stream: DataFrame, label: str, mode: str, each: Callable[[DataFrame, int], None]) -> int:
    """Run a streaming query over everything there is, a function for each batch; the number of the last."""
    progress = scratch_path(stream.sparkSession, f"{label}-progress")
    last = -1

    def keep(result: DataFrame, batch: int) -> None:
        nonlocal last
        each(result, batch)
        last = batch

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", progress)
    with state_settings(stream.sparkSession):
        running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return last


def _drain_latest(stream: DataFrame, label: str) -> DataFrame:
    """Run a streaming query whose whole result is anew in every batch; the last one of them."""
    output = scratch_path(stream.sparkSession, label)
    last = _drain_batches(
        stream, label, "complete", lambda result, batch: result.write.mode("overwrite").parquet(f"{output}/{batch}")
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{output}/{last}")


BATCHES = 3


def _as_stream(table: DataFrame, label: str, batch: Column | None = None) -> DataFrame:
    """A table as a file stream of three micro-batches, by a number from 0 to 2 of each row."""
    spark = table.sparkSession
    path = scratch_path(spark, label)
    held = materialize(table.withColumn("_batch", F.lit(0) if batch is None else batch), f"{label}-rows")
    # A micro-batch takes as many files as tasks write at most, in the order they were written. Tasks
    # without rows write none, so empty files stand for theirs.
    files = max(1, held.rdd.getNumPartitions())
    for number in range(BATCHES):
        held.where(F.col("_batch") == number).drop("_batch").write.mode("append").parquet(path)
        written = len(spark.read.schema(table.schema).parquet(path).inputFiles())
        for _ in range(written, (number + 1) * files if number < BATCHES - 1 else 0):
            held.where(F.lit(False)).drop("_batch").write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def _third(table: DataFrame, name: str) -> Column:
    """Which third of a column's span a row lies in, for streams whose batches follow its order."""
    low, high = table.agg(F.min(name), F.max(name)).first()
    share = (F.col(name).cast("double") - F.lit(low).cast("double")) / F.nullif(F.lit(high).cast("double") - F.lit(low).cast("double"), F.lit(0.0))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BATCHES), F.lit(BATCHES - 1))


_ASSEMBLED_SQL = """WITH turns AS (SELECT * FROM conversations)
SELECT conv_id AS sample_index, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '') AS content,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'user'), '') AS reasoning,
  max(turn) AS prompt_tokens, max(turn) * 2 AS completion_tokens, max(turn) * 3 AS total_tokens FROM turns GROUP BY conv_id"""
_SHOWN_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def _flat(assembled: DataFrame) -> DataFrame:
    return assembled.select("sample_index", "content", "reasoning", *[F.col(f"usage.{n}") for n in USAGE_FIELDS])


def _shown(flat: DataFrame) -> DataFrame:
    return flat.select(
        "sample_index",
        "content",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in _SHOWN_USAGE],
    )


@query(_ASSEMBLED_SQL)
def assemble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_flat(assemble(stream_lines(spark, sf_dir))))


@query(_ASSEMBLED_SQL)
def assemble_lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _as_stream(_timed_lines(spark, sf_dir), "lines", F.pmod(F.col("seq") * 2, F.lit(BATCHES)))
    return _shown(_drain(assemble_stream(lines), "assembled"))


def _rate_sql(ticks: str, window: float) -> str:
    """Rates of ticks (sample_index, seq, micros, delta)."""
    return f"""WITH ticks AS ({ticks}),
windowed AS (SELECT *, sum(delta) OVER past AS chars, sum(delta) OVER recent AS recent_chars, count(*) OVER recent AS recent_ticks,
    min(micros) OVER recent AS first FROM ticks
  WINDOW past AS (PARTITION BY sample_index ORDER BY micros, seq ROWS UNBOUNDED PRECEDING),
    recent AS (PARTITION BY sample_index ORDER BY micros RANGE BETWEEN {int(window * 1_000_000)} PRECEDING AND CURRENT ROW)),
fresh AS (SELECT *, CASE WHEN recent_ticks >= 2 AND (micros - first) / 1000000.0::DOUBLE > 0.3
    THEN CAST(floor(recent_chars / ((micros - first) / 1000000.0::DOUBLE)) AS BIGINT) END AS rate FROM windowed),
rates AS (SELECT sample_index, seq, micros, CAST(chars AS BIGINT) AS chars, coalesce(last_value(rate IGNORE NULLS) OVER (
    PARTITION BY sample_index ORDER BY micros, seq ROWS UNBOUNDED PRECEDING), 0) AS chars_per_sec FROM fresh)
"""


_RATE_SQL = _rate_sql(
    """SELECT user_id AS sample_index, event_id AS seq, epoch_us(ts) AS micros,
    CAST(floor(coalesce(value, 0)) AS BIGINT) AS delta FROM events WHERE floor(coalesce(value, 0)) > 0""",
    RATE_WINDOW,
)


@query(_RATE_SQL + "SELECT * FROM rates")
def live_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rate(ticks(spark, sf_dir), RATE_WINDOW)


def _big_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bought = events.where((F.col("event_type") == "purchase") & (F.col("value") >= 300))
    return bought.select(F.col("user_id").alias("sample_index")).distinct()


def _finishing_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks as a stream, with a last one without characters for the samples that finish."""
    ticked = ticks(spark, sf_dir).withColumn("finished", F.lit(False))
    last = ticked.groupBy("sample_index").agg(F.max(F.struct("ts", "seq")).alias("last"))
    zero = F.lit(0)
    ends = last.join(_big_buyers(spark, sf_dir), "sample_index").select(
        "sample_index",
        (F.col("last.seq") + 1).alias("seq"),
        F.col("last.ts").alias("ts"),
        zero.alias("content_delta_chars"),
        zero.alias("reasoning_delta_chars"),
        F.lit(True).alias("finished"),
    )
    both = ticked.unionByName(ends)
    return _as_stream(both, "ticks", _third(both, "ts"))


@query(_RATE_SQL + "SELECT * FROM rates")
def live_rates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = live_rate_stream(_finishing_ticks(spark, sf_dir), RATE_WINDOW, idle="3650 days")
    return _drain(rates, "rates")


def _timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the conversations, a second apart."""
    return stream_lines(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))


_LINE_TICKS_SQL = """SELECT conv_id AS sample_index, turn AS seq, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS content_delta_chars,
  CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS reasoning_delta_chars, false AS finished FROM conversations WHERE length(text) > 0
UNION ALL SELECT conv_id, max(turn) + 1, 0, 0, true FROM conversations GROUP BY conv_id"""


@query(_LINE_TICKS_SQL)
def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of response lines."""
    return ticks_from_lines(_timed_lines(spark, sf_dir)).drop("ts")


@query(_LINE_TICKS_SQL)
def line_ticks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timed_lines(spark, sf_dir)
    return _drain(ticks_from_lines(_as_stream(lines, "tick-lines", F.pmod("seq", F.lit(BATCHES)))).drop("ts"), "line-ticks")


_LINE_RATES_SQL = _rate_sql(
    """SELECT conv_id AS sample_index, turn AS seq, (turn + 1700000000) * 1000000 AS micros,
    length(text) AS delta FROM conversations WHERE length(text) > 0""",
    WINDOW_SECONDS,
) + "SELECT * FROM rates"


@query(_LINE_RATES_SQL)
def line_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines to ticks to live rates."""
    return live_rate(ticks_from_lines(_timed_lines(spark, sf_dir)))


@query(_LINE_RATES_SQL)
def line_rates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timed_lines(spark, sf_dir)
    # Batches follow the time, as ticks that come late count when they come.
    arriving = _as_stream(lines, "rate-lines", _third(lines, "ts"))
    return _drain(live_rate_stream(ticks_from_lines(arriving)), "line-rates")


_FINISHED_SQL = "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value >= 300"


_ACTIVE_SQL = _RATE_SQL + f"""SELECT sample_index, arg_max(chars, (micros, seq)) AS chars, arg_max(chars_per_sec, (micros, seq)) AS chars_per_sec
FROM rates WHERE sample_index NOT IN ({_FINISHED_SQL}) GROUP BY sample_index"""


@query(_ACTIVE_SQL)
def active_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_requests(live_rate(ticks(spark, sf_dir), RATE_WINDOW), _big_buyers(spark, sf_dir))


@query(_ACTIVE_SQL)
def active_samples_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing kept up by a stream of request states, batch by batch."""
    folder = scratch_path(spark, "active")
    states = request_states(_finishing_ticks(spark, sf_dir), RATE_WINDOW, idle="3650 days", last_only=True)
    last = _drain_batches(states, "active", "update", merge_active(folder))
    return spark.read.parquet(f"{folder}/{last}")


@query(
    """SELECT user_id AS sample_index, CASE WHEN max(epoch_us(ts)) = min(epoch_us(ts)) THEN 0.0::DOUBLE
  ELSE sum(floor(coalesce(value, 0)))::BIGINT::DOUBLE / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE) END AS chars_per_second
FROM events GROUP BY user_id"""
)
def mean_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per second of each request's whole time, zero where no time has passed."""
    micros = F.unix_micros("ts")
    chars = (F.col("content_delta_chars") + F.col("reasoning_delta_chars")).cast("long")
    spans = ticks(spark, sf_dir).groupBy("sample_index").agg(
        F.sum(chars).alias("chars"), ((F.max(micros) - F.min(micros)) / 1_000_000).alias("seconds")
    )
    return spans.select("sample_index", per_second(F.col("chars"), F.col("seconds")).alias("chars_per_second"))


_STREAMED_SQL = (
    RESPONSES_SQL
    + """, streamed AS (SELECT *, row_id % 6 = 2 AS bad FROM results)
SELECT row_id, problem_type, array_to_string(predicted, ';') AS predicted, CASE WHEN bad THEN 0.0::DOUBLE ELSE recall END AS recall,
  CASE WHEN bad THEN 0.0::DOUBLE ELSE "precision" END AS "precision", CASE WHEN bad THEN 0.0::DOUBLE ELSE f1 END AS f1,
  CASE WHEN failed OR bad THEN '' ELSE response END AS response, CASE WHEN failed OR bad THEN '' ELSE lang END AS reasoning,
  CASE WHEN failed OR bad THEN 0 ELSE completion_tokens END AS completion_tokens,
  CASE WHEN bad THEN 'response usage is not valid' WHEN failed THEN 'no response' ELSE '' END AS error FROM streamed"""
)


def _scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "row_id",
        "problem_type",
        F.array_join("predicted", ";").alias("predicted"),
        "recall",
        "precision",
        "f1",
        "response",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("usage.completion_tokens", F.lit(0)).alias("completion_tokens"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(_STREAMED_SQL)
def score_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines assembled into responses and scored, by the job from lines to results."""
    return _scores(evaluate_lines(_samples(spark, sf_dir), response_lines(spark, sf_dir))["results"])


@query(_STREAMED_SQL + " WHERE NOT failed")
def score_streamed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: each sample is scored once its lines are complete."""
    timed = response_lines(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    assembled = assemble_stream(_as_stream(timed, "response-lines", F.pmod(F.col("seq") * 2, F.lit(BATCHES))))
    known = materialize(_samples(spark, sf_dir).drop("prompt"), "samples")
    return _scores(_drain(score_arrivals(known, as_responses(assembled)), "streamed-scores"))


_TOTALS_SQL = """SELECT count(*) AS completed, sum(l_linenumber)::BIGINT AS prompt_tokens,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS completion_tokens,
  ((sum(l_linenumber) + sum(CAST(l_quantity AS BIGINT))) // count(*))::BIGINT AS average_tokens,
  arg_max('#' || l_orderkey, (l_shipdate, l_orderkey)) AS last_finished FROM lineitem"""


def _finished(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("sample_index"),
        F.col("l_shipdate").alias("finished_at"),
        F.col("l_linenumber").cast("long").alias("prompt_tokens"),
        F.col("l_quantity").cast("long").alias("completion_tokens"),
        F.concat(F.lit("#"), "l_orderkey").alias("label"),
    )


@query(_TOTALS_SQL)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_totals(_finished(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


@query(_TOTALS_SQL)
def totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a stream, whose whole state and result is one row."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    return _drain_latest(running_totals(_finished(lines)), "totals")


@query(_RESULT_FILE_SQL)
def result_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file, appended to as responses arrive, some of them again in a later batch."""
    first = responses(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.pmod("row_id", F.lit(600)) + 1_700_000_000))
    number = F.pmod("row_id", F.lit(BATCHES - 1))
    again = first.where(F.col("row_id") % 3 == 0).select("*", (number + 1).alias("_number"))
    arriving = first.select("*", number.alias("_number")).unionByName(again)
    known = materialize(_samples(spark, sf_dir).drop("prompt"), "samples")
    stream = _as_stream(arriving, "responses", F.col("_number")).drop("_number")
    scored = score_arrivals(known, parse_responses(once_per_sample(stream)))
    output = scratch_path(spark, "result-stream")
    writer = stream_results(scored, output, scratch_path(spark, "result-stream-progress")).trigger(availableNow=True)
    with state_settings(spark):
        running = writer.start()
    running.awaitTermination()
    return read_result_file(spark, output, result_rows(results(spark, sf_dir)).schema)
