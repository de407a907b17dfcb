"""What the plans of the main operators read and shuffle."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.plans import plan_text
from tokentide.functions.tokenizers import PIECES, Bytes
from tokentide.operators import compare
from tokentide.operators.align import TokenizerSet
from tokentide.operators.counting import count_tokens, count_with_all
from tokentide.operators.evaluate import parse_responses, score_responses
from tokentide.operators.profile import category_frequency, token_profile
from tokentide.plans import evaluating_queries, stream_queries
from tokentide.session import scratch_path
from tokentide.sources.samples import as_samples, of_type
from tokentide.sources.tables import read_counts, read_table


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    spark.range(100).select(
        F.col("id").alias("row_id"),
        F.lit("long text").alias("prompt"),
        F.array(F.lit("a")).alias("answer_nodes"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("problem_type"),
        F.col("id").cast("int").alias("n"),
        (F.col("id") + 1).cast("int").alias("m"),
    ).write.parquet(path)
    return path


def scanned(plan: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>\s*$", plan, re.M)]


def test_profile_reads_counts_and_groups_only(spark, table):
    plan = plan_text(token_profile(spark.read.parquet(table), "n", "problem_type"))
    assert scanned(plan) == [{"n", "problem_type"}]
    # One shuffle folds the rows; the levels are expanded after it.
    fold, expand = plan.rindex("Exchange hashpartitioning"), plan.index("Expand")
    assert expand < fold


def test_counting_has_no_shuffle(spark, table):
    assert "Exchange" not in plan_text(count_with_all(spark.read.parquet(table), "prompt", [PIECES, Bytes()]))
    assert "Exchange" not in plan_text(count_tokens(spark.read.parquet(table), "prompt", PIECES, "p"))


def test_a_table_is_dealt_only_on_request(spark, table):
    assert "REPARTITION" not in plan_text(read_table(spark, table))
    assert "REPARTITION" in plan_text(read_table(spark, table, 7, ["row_id"]))


def test_count_column_scan_is_projected(spark, table):
    assert scanned(plan_text(read_counts(spark, table, "n", key="row_id"))) == [{"n", "row_id"}]


def test_scoring_does_not_read_prompts(spark, rows, table):
    samples = of_type(as_samples(spark.read.parquet(table), tokens="n"), "x")
    responses = rows([(0, 200, "{}")], "row_id long, status int, body string")
    plan = plan_text(score_responses(samples, parse_responses(responses)))
    assert all("prompt" not in columns for columns in scanned(plan)) and scanned(plan)
    typed = as_samples(spark.read.parquet(table)).where(F.col("row_id") < 5)
    assert "PushedFilters: [IsNotNull(row_id), LessThan(row_id,5)]" in plan_text(typed)


def test_comparison_totals_scan_once(spark, table):
    items = spark.read.parquet(table).select(F.col("n").cast("long").alias("A"), F.col("m").cast("long").alias("B"))
    plan = plan_text(compare.comparison_totals(items, TokenizerSet.of(["A", "B"])))
    assert scanned(plan) == [{"n", "m"}] and plan.count("Exchange") == 1


def test_frequency_reads_one_column(spark, table):
    assert all(columns == {"problem_type"} for columns in scanned(plan_text(category_frequency(spark.read.parquet(table), "problem_type"))))


def copies(rows, folder, count):
    """A folder of tables with ``count`` documents and conversations, in several splits."""
    texts = [(n, f"text {n}", "fr" if n % 2 else "de", "web") for n in range(count)]
    rows(texts, "doc_id long, text string, lang string, source string").repartition(6).write.parquet(f"{folder}/documents.parquet")
    turns = [(n, turn, "user", f"turn {turn} of {n}") for n in range(count // 4) for turn in range(4)]
    rows(turns, "conv_id long, turn long, role string, text string").repartition(6).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture
def small_splits(spark):
    """Splits of one file each, as those of a large table."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def files_of(spark, path):
    return spark.read.parquet(path).inputFiles()


def test_batches_of_a_stream_are_written_by_all_tasks(spark, rows, tmp_path, small_splits):
    """Each micro-batch is one number's rows, whatever their number, and no task has a whole one."""
    table = spark.createDataFrame([(n, 0 if n < 80 else 1 if n == 80 else 2) for n in range(120)], "n long, b long").repartition(6)
    stream = stream_queries._as_stream(table, "parts", F.col("b"))
    found = {}
    stream_queries._drain_batches(
        stream, "parts", "append", lambda frame, number: found.update({number: (frame.select("b").distinct().collect(), frame.rdd.getNumPartitions())})
    )
    assert [[row.b for row in found[number][0]] for number in range(3)] == [[0], [1], [2]]
    assert found[0][1] > 1


def test_first_rows_come_from_more_files_for_more_splits(spark, rows, tmp_path, small_splits, monkeypatch):
    folder, paths = copies(rows, tmp_path, 200), []
    monkeypatch.setattr(evaluating_queries, "scratch_path", lambda spark, label: paths.append(scratch_path(spark, label)) or paths[-1])
    found = evaluating_queries.first_rows(spark, folder).orderBy("row_id").collect()
    assert [(row.row_id, row.problem_type) for row in found] == [(n, "fr" if n % 2 else "de") for n in range(150)]
    assert len(files_of(spark, paths[0])) > 4
