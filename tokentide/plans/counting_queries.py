"""Queries over counting, profiling, splitting and checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokentide.functions.buckets import Range
from tokentide.functions.tokenizers import CJK_PUNCTUATION, PIECES, PRETOKENS, special_token_total
from tokentide.operators.counting import count_tokens, count_with_all
from tokentide.operators.profile import category_frequency, head_and_tail, token_histogram, token_profile
from tokentide.operators.split import split, with_band
from tokentide.plans.inputs import (
    COUNTS_SQL, ITEMS_SQL, TOKENIZERS, conversations, documents, items,
)
from tokentide.plans.registry import query
from tokentide.session import scratch_path
from tokentide.sinks.tables import read_band, write_counted, write_split
from tokentide.sources.tables import read_counts, tag_inputs, with_row_id

RANGES = (
    Range("<=250", 0, 251),
    Range("251-500", 251, 501),
    Range("501-1k", 501, 1_001),
    Range("1k-2k", 1_001, 2_001),
    Range("2k-4k", 2_001, 4_001),
    Range(">4k", 4_001, None),
)
THRESHOLD = 500


def _profile(rows: DataFrame) -> DataFrame:
    return token_profile(rows, "pieces", "group", "input_id", RANGES, limit=1_000)


def _labelled(frame: DataFrame) -> DataFrame:
    """Profile rows with text in place of the nulls of merged levels."""
    return frame.withColumn("input_id", F.coalesce(F.col("input_id").cast("string"), F.lit("all"))).withColumn(
        "group", F.coalesce("group", F.lit("all"))
    )


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.col("dataset").alias("input_id"), "group", "pieces")


_LEVEL_SQL = """CASE WHEN grouping(input_id) + grouping("group") = 2 THEN 'all' WHEN grouping(input_id) = 1 THEN 'group'
       WHEN grouping("group") = 1 THEN 'input' ELSE 'input_group' END AS level,
  CASE WHEN grouping(input_id) = 1 THEN 'all' ELSE input_id END AS input_id,
  CASE WHEN grouping("group") = 1 THEN 'all' ELSE "group" END AS "group\""""
_PROFILE_SQL = f"""SELECT {_LEVEL_SQL},
  count(*) AS total, CAST(sum(pieces) AS BIGINT) AS sum_tokens, min(pieces) AS min_tokens,
  max(pieces) AS max_tokens, CAST(sum(pieces) AS DOUBLE) / count(*) AS mean_tokens,
  count(*) FILTER (pieces > 1000) AS over_limit
FROM rows GROUP BY GROUPING SETS ((), (input_id), ("group"), (input_id, "group"))"""


@query(
    f"""WITH counted AS (SELECT *, {COUNTS_SQL} FROM documents)
SELECT doc_id, lang, source, n_chars, CAST(pieces AS INTEGER) AS pieces_input_tokens,
  pieces > 400 AS pieces_over_1m FROM counted"""
)
def count_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), "text", PIECES, "pieces", limit=400).drop("text")


@query(
    f"""WITH counted AS (SELECT *, {COUNTS_SQL} FROM documents)
SELECT doc_id, CAST(pieces AS INTEGER) AS p_input_tokens, pieces > 1000000 AS p_over_1m FROM counted"""
)
def count_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table counted, written beside its input and read back."""
    source = scratch_path(spark, "uncounted")
    documents(spark, sf_dir).select("doc_id", "text").write.parquet(source)
    return spark.read.parquet(write_counted(spark, source, "text", PIECES, "p")).drop("text")


@query(f"SELECT doc_id, {COUNTS_SQL} FROM documents")
def count_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_all(documents(spark, sf_dir).select("doc_id", "text"), "text", TOKENIZERS).drop("text")


@query(f"SELECT conv_id, turn, role, {COUNTS_SQL} FROM conversations")
def count_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_all(conversations(spark, sf_dir), "text", TOKENIZERS).drop("text")


# The pre-token pattern without looking ahead: a control character after a blank marks what
# the pattern would have looked for, and takes part in the match.
_ASIDE = "[" + "".join(f"\\x{{{ord(mark):x}}}" for mark in CJK_PUNCTUATION) + "]"
_BLANK = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
_PRETOKEN_SQL = (
    r"'(?i:[sdmt]|ll|ve|re)"
    r"| \x{2}"
    rf"|{_ASIDE}+[\r\n]*"
    r"|[^\r\n\p{L}\p{N}\p{M}\x{1}\x{2}][\p{L}\p{M}]+|\p{M}[\p{L}\p{M}]+|\p{L}[\p{L}\p{M}]*"
    r"|\p{N}"
    r"| ?[^\s\x0b\x{1}\x{2}\x{1c}-\x{1f}\x{85}\p{Z}\p{L}\p{N}]+[\r\n]*"
    rf"|{_BLANK}*[\r\n]"
    rf"|{_BLANK}+\x{{1}}?"
).replace("'", "''")
_MARKED_SQL = (
    rf"regexp_replace(regexp_replace(text, ' (\p{{Han}}|{_ASIDE})', ' ' || chr(2) || '\1', 'g'),"
    rf" '({_BLANK})({_BLANK}[^\x{{2}}\s\p{{Z}}])', '\1' || chr(1) || '\2', 'g')"
)


@query(f"SELECT doc_id, CAST(len(regexp_extract_all({_MARKED_SQL}, '{_PRETOKEN_SQL}')) AS INTEGER) AS pretokens_input_tokens,"
       f" len(regexp_extract_all({_MARKED_SQL}, '{_PRETOKEN_SQL}')) > 1000000 AS pretokens_over_1m FROM documents")
def count_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(rows, "text", PRETOKENS, "pretokens").drop("text")


@query(ITEMS_SQL + """SELECT doc_id, pieces AS plain, pieces + 1 AS started, pieces + 2 AS enclosed,
  pieces + words + 1 AS pair, pieces + words + 4 AS wrapped_pair FROM items""")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.col("pieces"), F.col("words")
    return items(spark, sf_dir).select(
        F.col("row_id").alias("doc_id"),
        special_token_total(first, bos=False).alias("plain"),
        special_token_total(first).alias("started"),
        special_token_total(first, eos=True).alias("enclosed"),
        special_token_total(first, second).alias("pair"),
        special_token_total(first, second, eos=True, wrap_second=True).alias("wrapped_pair"),
    )


@query(ITEMS_SQL + f', rows AS (SELECT source AS input_id, lang AS "group", pieces FROM items)\n{_PROFILE_SQL}')
def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(_profile(_by_source(spark, sf_dir))).drop("by_range")


_RANGES_SQL = ", ".join(
    f"({i}, '{r.label}', {r.low}, {r.high if r.high is not None else 1 << 40})" for i, r in enumerate(RANGES)
)


@query(
    ITEMS_SQL
    + f""", rows AS (SELECT source AS input_id, lang AS "group", pieces FROM items),
profile AS (SELECT {_LEVEL_SQL}, count(*) AS total, list(pieces) AS counts
  FROM rows GROUP BY GROUPING SETS ((), (input_id), ("group"), (input_id, "group"))),
ranges(position, "range", low, high) AS (VALUES {_RANGES_SQL}),
counted AS (SELECT level, input_id, "group", position, "range", total,
    len(list_filter(counts, lambda x: x >= low AND x < high)) AS hits FROM profile, ranges)
SELECT level, input_id, "group", CAST(position AS INTEGER) AS position, "range", CAST(hits AS BIGINT) AS "rows",
  hits * 100.0::DOUBLE / total AS share FROM counted"""
)
def histogram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(token_histogram(_profile(_by_source(spark, sf_dir))))


@query(
    f"""WITH rows AS (
  SELECT '0' AS input_id, lang AS "group", {COUNTS_SQL} FROM documents
  UNION ALL SELECT '1', role, {COUNTS_SQL} FROM conversations
  UNION ALL SELECT '2', role, {COUNTS_SQL} FROM conversations)
{_PROFILE_SQL}"""
)
def profile_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = count_with_all(documents(spark, sf_dir), "text", [PIECES]).select(F.col("lang").alias("group"), "pieces")
    turns = count_with_all(conversations(spark, sf_dir), "text", [PIECES]).select(F.col("role").alias("group"), "pieces")
    return _labelled(_profile(tag_inputs([docs, turns, turns]))).drop("by_range")


@query(ITEMS_SQL + f"SELECT doc_id, lang, pieces FROM items WHERE coalesce(pieces, 0) <= {THRESHOLD}")
def split_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(split(_counted(spark, sf_dir), "pieces", THRESHOLD)[0])


@query(ITEMS_SQL + f"SELECT doc_id, lang, pieces FROM items WHERE coalesce(pieces, 0) > {THRESHOLD}")
def split_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(split(_counted(spark, sf_dir), "pieces", THRESHOLD)[1])


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_all(documents(spark, sf_dir), "text", [PIECES])


def _split_rows(side: DataFrame) -> DataFrame:
    return side.select("doc_id", "lang", "pieces")


@query(ITEMS_SQL + f"""SELECT CASE WHEN pieces <= {THRESHOLD} THEN 'low' ELSE 'high' END AS band, count(*) AS "rows"
FROM items GROUP BY band""")
def split_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = with_band(_counted(spark, sf_dir), "pieces", THRESHOLD)
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("rows"))


@query(ITEMS_SQL + f"""SELECT CASE WHEN pieces <= {THRESHOLD} THEN 'low' ELSE 'high' END AS band, doc_id, pieces
FROM items""")
def split_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = scratch_path(spark, "split")
    write_split(_counted(spark, sf_dir).select("doc_id", "pieces"), "pieces", output, THRESHOLD)
    return read_band(spark, output, "low").select(F.lit("low").alias("band"), "*").unionByName(
        read_band(spark, output, "high").select(F.lit("high").alias("band"), "*")
    )


@query(
    """WITH counted AS (SELECT source AS category, count(*) AS "rows" FROM documents GROUP BY source)
SELECT category, "rows", "rows" * 100.0::DOUBLE / (SELECT sum("rows") FROM counted)::BIGINT AS share FROM counted"""
)
def source_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_frequency(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@query("SELECT doc_id, doc_id AS row_id FROM documents")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


@query(
    """WITH first AS (SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5),
last AS (SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id DESC LIMIT 5)
SELECT 'first' AS part, doc_id AS row_id, lang, n_chars FROM first
UNION ALL SELECT 'last', doc_id, lang, n_chars FROM last"""
)
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = with_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return head_and_tail(table, "row_id", ["lang", "n_chars"])


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS tokens FROM lineitem")
def read_count_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/lineitem.parquet"
    counts = read_counts(spark, path, "l_linenumber", key="l_orderkey")
    return counts.select(
        F.col("row_id").alias("l_orderkey"), F.col("tokens").cast("int").alias("l_linenumber"), "tokens"
    )
