"""Queries over requests, responses, answers and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tokentide.functions.answers import final_answer
from tokentide.operators import evaluate
from tokentide.plans.inputs import RESPONSES_SQL, documents, response_text, responses, samples
from tokentide.plans.registry import query
from tokentide.session import materialize, scratch_path
from tokentide.sinks.results import write_results
from tokentide.sources.samples import as_samples, first_samples, of_type, read_samples


FILES = 4  # files that each split of a table is written to


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(samples(spark, sf_dir), row_id="doc_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_responses(_samples(spark, sf_dir), evaluate.parse_responses(responses(spark, sf_dir)))


def _joined(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({name: F.array_join(name, ";") for name in columns})


@query(RESPONSES_SQL + "SELECT row_id, text AS prompt, array_to_string(truth, ';') AS truth, problem_type,"
       " CAST(length(text) AS INTEGER) AS input_tokens FROM results")
def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_samples(spark, sf_dir), "truth")


@query(RESPONSES_SQL + "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, array_to_string(truth, ';') AS truth,"
       " problem_type FROM results ORDER BY row_id LIMIT 150")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first samples of a table of several files, cut by their position in it."""
    path = scratch_path(spark, "samples")
    table = samples(spark, sf_dir)
    # Four files for each split of the input, so that a file grows with the split and not with the table.
    files = FILES * max(1, table.rdd.getNumPartitions())
    table.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.parquet(path)
    return _joined(read_samples(spark, path, max_samples=150), "truth").select("row_id", "truth", "problem_type")


@query(RESPONSES_SQL + "SELECT row_id, problem_type FROM results WHERE problem_type = 'fr' ORDER BY row_id LIMIT 20")
def first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_samples(of_type(_samples(spark, sf_dir), "fr"), 20).select("row_id", "problem_type")


@query(
    """SELECT doc_id AS row_id, 'm' AS model, text AS prompt, 'user' AS role, 393216 AS max_tokens, 'high' AS effort,
  'enabled' AS thinking, true AS streamed, 0.0::DOUBLE AS temperature FROM documents"""
)
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies, read back from their JSON."""
    requests = evaluate.build_requests(_samples(spark, sf_dir), "m", effort="high", stream=True)
    body = F.from_json(
        "request",
        "model string, messages array<struct<role:string, content:string>>, temperature double,"
        " reasoning_effort string, thinking struct<type:string>, max_tokens int, stream boolean",
    )
    return requests.select("row_id", body.alias("b")).select(
        "row_id",
        F.col("b.model").alias("model"),
        F.col("b.messages")[0]["content"].alias("prompt"),
        F.col("b.messages")[0]["role"].alias("role"),
        F.col("b.max_tokens").alias("max_tokens"),
        F.col("b.reasoning_effort").alias("effort"),
        F.col("b.thinking.type").alias("thinking"),
        F.col("b.stream").alias("streamed"),
        F.col("b.temperature").alias("temperature"),
    )


@query(
    RESPONSES_SQL
    + """SELECT row_id, CASE WHEN failed THEN '' ELSE response END AS content, CASE WHEN failed THEN '' ELSE lang END AS reasoning,
  prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens, 0::BIGINT AS cache_hit_tokens,
  coalesce(error, '') AS error FROM results"""
)
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = evaluate.parse_responses(responses(spark, sf_dir))
    return parsed.select(
        "row_id",
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("content", "reasoning", "error")],
        *[
            F.coalesce(f"usage.{name}", F.lit(0)).alias(name)
            for name in ("prompt_tokens", "completion_tokens", "total_tokens", "cache_hit_tokens")
        ],
    )


@query(RESPONSES_SQL + "SELECT row_id AS doc_id, array_to_string(predicted, ';') AS predicted FROM results")
def extract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = documents(spark, sf_dir).select("doc_id", final_answer(response_text()).alias("predicted"))
    return _joined(answered, "predicted")


@query(
    RESPONSES_SQL
    + """SELECT row_id, problem_type, array_to_string(predicted, ';') AS predicted, array_to_string(truth, ';') AS truth,
  recall, "precision", f1, coalesce(error, '') AS error FROM results"""
)
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _joined(results(spark, sf_dir), "predicted", "truth")
    return scored.select(
        "row_id", "problem_type", "predicted", "truth", "recall", "precision", "f1",
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    RESPONSES_SQL
    + """SELECT count(*) AS samples, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND f1 >= 0.999) AS exact_matches,
  round(avg(recall) FILTER (NOT failed), 6) AS mean_recall, round(avg("precision") FILTER (NOT failed), 6) AS mean_precision,
  round(avg(f1) FILTER (NOT failed), 6) AS mean_f1,
  count(*) FILTER (NOT failed AND f1 >= 0.999)::DOUBLE / count(*) FILTER (NOT failed) * 100 AS exact_share FROM results"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluate.evaluation_summary(results(spark, sf_dir))
    return summary.withColumns({name: F.round(name, 6) for name in ("mean_recall", "mean_precision", "mean_f1")})


@query(
    RESPONSES_SQL
    + """, ranges(position, f1_range, low, high) AS (VALUES (0, '= 0', -1, 0.001), (1, '(0, 0.5)', 0.001, 0.5),
  (2, '[0.5, 0.8)', 0.5, 0.8), (3, '[0.8, 1.0)', 0.8, 0.999), (4, '= 1.0', 0.999, 2))
SELECT position, f1_range, (SELECT count(*) FROM results WHERE NOT failed AND f1 >= low::DOUBLE AND f1 < high::DOUBLE) AS results
FROM ranges"""
)
def f1_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.f1_histogram(results(spark, sf_dir))


@query(RESPONSES_SQL + "SELECT problem_type, count(*) AS results, round(avg(f1), 6) AS mean_f1 FROM results"
       " WHERE NOT failed GROUP BY problem_type")
def f1_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.f1_by_type(results(spark, sf_dir)).withColumn("mean_f1", F.round("mean_f1", 6))


_DEFECTS_SQL = RESPONSES_SQL + """, wrong AS (SELECT row_id, f1, coalesce(error, '') AS error FROM results WHERE failed OR f1 < 0.999)
SELECT * FROM wrong"""


def _listed(found: DataFrame) -> DataFrame:
    return found.select("row_id", "f1", F.coalesce("error", F.lit("")).alias("error"))


@query(_DEFECTS_SQL)
def eval_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect, in row order."""
    return _listed(evaluate.defects(results(spark, sf_dir)))


@query(_DEFECTS_SQL + " WHERE (SELECT count(*) FROM wrong) <= (SELECT count(*) FROM documents)")
def eval_defects_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short listing with a limit that the defects keep: as many as there are samples."""
    scored = materialize(results(spark, sf_dir), "scored")
    return _listed(evaluate.defects(scored, most=scored.count()))


@query(_DEFECTS_SQL + " WHERE (SELECT count(*) FROM wrong) <= 50")
def eval_defects_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short listing with the usual limit, which more defects than that leave empty."""
    return _listed(evaluate.defects(materialize(results(spark, sf_dir), "scored"), most=50))


@query(
    RESPONSES_SQL
    + """SELECT count(*) AS completed, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
  ((sum(prompt_tokens) + sum(completion_tokens)) // count(*))::BIGINT AS average_tokens FROM results"""
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.usage_totals(results(spark, sf_dir))


_RESULT_FILE_SQL = (
    RESPONSES_SQL
    + """SELECT row_id AS "index", problem_type, printf('%.4f', recall) AS recall, printf('%.4f', "precision") AS "precision",
  printf('%.4f', f1) AS f1, coalesce(error, '') AS error, CASE WHEN failed THEN '' ELSE replace(response, chr(10), ' ') END AS response,
  CASE WHEN failed THEN '' ELSE lang END AS reasoning_content, array_to_string(predicted, ';') AS predicted,
  array_to_string(truth, ';') AS ground_truth, prompt_tokens AS api_prompt_tokens, completion_tokens AS api_completion_tokens,
  prompt_tokens + completion_tokens AS api_total_tokens, 0::BIGINT AS api_cache_hit_tokens, 0::BIGINT AS api_cache_miss_tokens,
  0::BIGINT AS api_reasoning_tokens, CAST(length(text) AS INTEGER) AS local_input_tokens FROM results"""
)


def read_result_file(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A written result file with its own column types and empty text for nulls."""
    nullable = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    return spark.read.option("escape", '"').option("header", True).schema(nullable).csv(path).na.fill("")


@query(_RESULT_FILE_SQL)
def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file, written and read back."""
    output = scratch_path(spark, "results")
    scored = results(spark, sf_dir)
    write_results(scored, output)
    return read_result_file(spark, output, evaluate.result_rows(scored).schema)
