"""The toolkit's jobs end to end, each from tables or files to result frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tokentide.functions.paths import top_level
from tokentide.functions.tokenizers import Tokenizer
from tokentide.operators import compare, corpus, evaluate
from tokentide.operators.align import TokenizerSet, align_files
from tokentide.operators.profile import category_frequency, head_and_tail, token_histogram, token_profile
from tokentide.session import materialize, state_settings
from tokentide.sinks.results import stream_results
from tokentide.sinks.tables import write_counted
from tokentide.sources.tables import tag_inputs, with_row_id
from tokentide.sources.text_files import read_text_files
from tokentide.streaming.assemble import as_responses, assemble, assemble_stream


def count_tables(
    spark: SparkSession, paths: Sequence[str], text: str, tokenizer: Tokenizer, tag: str
) -> list[str]:
    """Count each parquet table and write it beside its input; returns the output paths."""
    return [write_counted(spark, path, text, tokenizer, tag) for path in paths]


def token_stats(
    spark: SparkSession, paths: Sequence[str], tokens: str, group: str = "problem_type"
) -> dict[str, DataFrame]:
    """Profile and histogram over all inputs, per input, and per group of both."""
    tables = [spark.read.parquet(path) for path in paths]
    label = [F.col(group) if group in table.columns else F.lit(None).cast("string") for table in tables]
    rows = tag_inputs([t.select(F.col(tokens), g.alias("group")) for t, g in zip(tables, label)])
    profile = materialize(token_profile(rows, tokens, "group", "input_id"), "profile")
    return {"profile": profile, "histogram": token_histogram(profile)}


def check_dataset(
    spark: SparkSession, path: str, tokens: str | None = None, group: str = "problem_type"
) -> dict[str, DataFrame]:
    """Group frequency of a table, and its first and last rows if it has counts."""
    table = spark.read.parquet(path)
    sections = {"frequency": category_frequency(table, group)}
    if tokens is not None and tokens in table.columns:
        rows = with_row_id(table.select("*")).select(
            "row_id",
            F.coalesce(group, F.lit("")).alias(group),
            F.coalesce(tokens, F.lit(0)).alias(tokens),
        )
        sections["rows"] = head_and_tail(rows, "row_id", [group, tokens])
    return sections


def _sections(items: DataFrame, tokenizers: TokenizerSet) -> dict[str, DataFrame]:
    """The sections every comparison has; one pass over the items gives all totals."""
    totals = materialize(compare.comparison_totals(items, tokenizers), "totals")
    return {
        "overall": compare.overall(items, tokenizers, totals),
        "quantiles": compare.quantiles(items, tokenizers),
        "above_limits": compare.above_limits(totals, tokenizers),
        "directions": compare.directions(totals, tokenizers),
        "fits": compare.fits(totals, tokenizers),
        "pairs": compare.pairs(totals, tokenizers),
    }


def compare_tables(
    spark: SparkSession,
    datasets: Mapping[str, Sequence[str]] | Sequence[str],
    tokenizers: TokenizerSet,
    group: str | None = None,
    key: str | None = None,
) -> dict[str, DataFrame]:
    """Every section of the comparison of aligned count tables."""
    items = materialize(align_files(spark, datasets, tokenizers, group, key), "items")
    sections = _sections(items, tokenizers)
    sections["by_dataset"] = compare.group_totals(items, tokenizers, "dataset")
    if group is not None:
        sections["by_group"] = compare.group_totals(items, tokenizers, "group")
    sections["by_length"] = compare.by_length(items, tokenizers)
    return sections


def compare_text_files(
    spark: SparkSession,
    root: str,
    tokenizers: Sequence[Tokenizer],
    primary: str | None = None,
    extensions: Sequence[str] = (),
    excludes: Sequence[str] = (),
    group: Callable[[Column], Column] = top_level,
    chunk_size: int | None = None,
) -> dict[str, DataFrame]:
    """Every section of the comparison over a tree of text files."""
    chosen = TokenizerSet.of([tokenizer.name for tokenizer in tokenizers], primary)
    files = read_text_files(spark, root, extensions, excludes)
    items = materialize(corpus.count_files(files, tokenizers, group), "items")
    sections = _sections(items, chosen)
    sections["groups"] = corpus.file_groups(items, chosen)
    if chunk_size is not None:
        sections["chunks"] = corpus.chunk_totals(items, chosen, chunk_size)
    sections["details"] = corpus.details(items, chosen)
    return sections


def _evaluation(scored: DataFrame) -> dict[str, DataFrame]:
    """Results and their summaries."""
    results = materialize(scored, "results")
    return {
        "results": results,
        "summary": evaluate.evaluation_summary(results),
        "f1_histogram": evaluate.f1_histogram(results),
        "f1_by_type": evaluate.f1_by_type(results),
        "usage": evaluate.usage_totals(results),
        "defects": evaluate.defects(results),
    }


def evaluate_responses(samples: DataFrame, responses: DataFrame) -> dict[str, DataFrame]:
    """Scored results of a response table (row_id, status, body) and their summaries."""
    return _evaluation(evaluate.score_responses(samples, evaluate.parse_responses(responses)))


def evaluate_lines(samples: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Scored results of streamed responses (sample_index, seq, line) and their summaries."""
    return _evaluation(evaluate.score_responses(samples, as_responses(assemble(lines))))


def evaluate_line_stream(
    samples: DataFrame, lines: DataFrame, output: str, checkpoint: str, late: str = "10 minutes", idle: str = "1 hour"
) -> StreamingQuery:
    """A started query that appends the result of each sample once its lines (with ts) are complete.

    ``samples`` is a table; ``output`` gets the result file, see :func:`stream_results`.
    """
    scored = evaluate.score_arrivals(samples, as_responses(assemble_stream(lines, late, idle)))
    with state_settings(lines.sparkSession):
        return stream_results(scored, output, checkpoint).start()
