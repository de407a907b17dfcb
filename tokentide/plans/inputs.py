"""Benchmark-shaped inputs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokentide.functions.tokenizers import PIECES, WORDS, Bytes, Chars
from tokentide.operators.align import TokenizerSet
from tokentide.operators.corpus import count_files
from tokentide.operators.counting import count_with_all
from tokentide.sources.tables import read_table

TOKENIZERS = (PIECES, WORDS, Chars(), Bytes())
COMPARED = TokenizerSet.of([tokenizer.name for tokenizer in TOKENIZERS], "pieces")
FILE_TOKENIZERS = (PIECES, WORDS, Bytes())
FILE_COMPARED = TokenizerSet.of([tokenizer.name for tokenizer in FILE_TOKENIZERS], "pieces")
# The texts are short; limits and bounds are parameters scaled to them.
LIMITS = (250, 500, 1_000, 2_000)
BOUNDS = (250, 500, 1_000, 2_000, 4_000)


# Session setting by which a caller asks for text tables to be dealt to so many partitions.
PARTITIONS = "tokentide.input.partitions"


def dealt(spark: SparkSession) -> int | None:
    """The number of partitions the caller asked for; none means as the files lie."""
    number = spark.conf.get(PARTITIONS, None)
    return None if number is None else int(number)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", dealt(spark), ["doc_id"])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/conversations.parquet", dealt(spark), ["conv_id", "turn"])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as aligned items: source as dataset, language as group, four counts."""
    counted = count_with_all(documents(spark, sf_dir), "text", TOKENIZERS)
    return counted.select(
        F.col("source").alias("dataset"),
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("group"),
        *COMPARED.names,
    )


_WORDS_SQL = r"CAST(len(regexp_extract_all(text, '[^ \t\r\n]+')) AS BIGINT)"
_PIECES_SQL = r"CAST(len(regexp_extract_all(text, '\p{L}+|\p{N}|[^ \t\r\n\p{L}\p{N}]+')) AS BIGINT)"
COUNTS_SQL = (
    f"{_PIECES_SQL} AS pieces, {_WORDS_SQL} AS words,"
    " CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes"
)
ITEMS_SQL = (
    "WITH items AS (SELECT doc_id, lang, source, source AS dataset, doc_id AS row_id,"
    f' lang AS "group", {COUNTS_SQL} FROM documents)\n'
)


def document_path(doc_id: Column) -> Column:
    return F.concat(
        F.lit("book"), doc_id % 4, F.lit("/part"), doc_id % 3, F.lit("/"), doc_id, F.lit(".md")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows (path, text) of a tree of books and parts."""
    return documents(spark, sf_dir).select(document_path(F.col("doc_id")).alias("path"), "text")


def file_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_files(files(spark, sf_dir), FILE_TOKENIZERS)


FILES_SQL = (
    "WITH files AS (SELECT doc_id, 'book' || (doc_id % 4) || '/part' || (doc_id % 3) || '/' || doc_id"
    f" || '.md' AS path, 'book' || (doc_id % 4) AS \"group\", {COUNTS_SQL} FROM documents)\n"
)


def _node(modulus: int) -> Column:
    return F.concat(F.lit("n"), F.col("doc_id") % modulus)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as benchmark samples in the sample table's own columns."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.col("text").alias("prompt"),
        F.when(F.col("doc_id") % 11 != 0, F.array(_node(7), _node(5), _node(3))).alias("answer_nodes"),
        F.col("lang").alias("problem_type"),
        F.char_length("text").alias("input_tokens"),
    )


def response_text() -> Column:
    """A response to each document: five answer forms, null for a failed request."""
    answer = (
        F.when(
            F.col("doc_id") % 6 == 0,
            F.concat(F.lit("Final Answer: ["), _node(7), F.lit(", "), _node(5), F.lit(", "), _node(3), F.lit("]")),
        )
        .when(
            F.col("doc_id") % 6 == 1,
            F.concat(F.lit('Final Answer: ["'), _node(7), F.lit("\", '"), _node(4), F.lit("']")),
        )
        .when(F.col("doc_id") % 6 == 2, F.lit("no answer"))
        .when(F.col("doc_id") % 6 == 3, F.lit("Final Answer: []"))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("Final Answer: ["), _node(7), F.lit("]\n\n")))
    )
    return F.concat(F.col("text"), F.lit("\n"), answer)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response rows (row_id, status, body); the body is chat response JSON."""
    prompt, completion = F.char_length("text").cast("long"), F.octet_length("text").cast("long")
    message = F.struct(response_text().alias("content"), F.col("lang").alias("reasoning_content"))
    usage = F.struct(
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
    )
    body = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"), usage.alias("usage")))
    failed = F.col("doc_id") % 6 == 5
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"),
        F.when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(~failed, body).otherwise(F.lit("overloaded")).alias("body"),
    )


RESPONSES_SQL = r"""WITH answered AS (
  SELECT doc_id, lang, text, doc_id % 6 AS form,
    CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[])
         ELSE list_sort(list_distinct(['n' || (doc_id % 7), 'n' || (doc_id % 5), 'n' || (doc_id % 3)])) END AS truth,
    text || chr(10) || CASE doc_id % 6
      WHEN 0 THEN 'Final Answer: [n' || (doc_id % 7) || ', n' || (doc_id % 5) || ', n' || (doc_id % 3) || ']'
      WHEN 1 THEN 'Final Answer: ["n' || (doc_id % 7) || '", ''n' || (doc_id % 4) || ''']'
      WHEN 2 THEN 'no answer'
      WHEN 3 THEN 'Final Answer: []'
      WHEN 4 THEN 'Final Answer: [n' || (doc_id % 7) || ']' || chr(10) || chr(10) END AS content
  FROM documents),
lined AS (
  SELECT *, regexp_extract(
      string_split(regexp_replace(coalesce(content, ''), '\n\z', ''), chr(10))[-1],
      'Final Answer: ?\[([^\]]*)\]', 1) AS listed
  FROM answered),
extracted AS (
  SELECT *, list_sort(list_distinct(list_filter(
      list_transform(string_split(listed, ','), lambda x: trim(trim(x), '"''')), lambda x: x <> ''))) AS predicted
  FROM lined),
scored AS (
  SELECT *, form = 5 AS failed, len(list_intersect(predicted, truth)) AS overlap FROM extracted),
rated AS (
  SELECT *,
    CASE WHEN failed THEN 0.0::DOUBLE WHEN len(truth) > 0 THEN overlap::DOUBLE / len(truth) ELSE 1.0::DOUBLE END AS recall,
    CASE WHEN failed THEN 0.0::DOUBLE WHEN len(predicted) > 0 THEN overlap::DOUBLE / len(predicted) ELSE 1.0::DOUBLE END AS "precision"
  FROM scored),
results AS (
  SELECT doc_id AS row_id, lang AS problem_type, predicted, truth, recall, "precision",
    CASE WHEN recall + "precision" > 0 THEN recall * 2.0::DOUBLE * "precision" / (recall + "precision") ELSE 0.0::DOUBLE END AS f1,
    coalesce(content, '') AS response, text, lang, failed,
    CASE WHEN failed THEN 'status 500: overloaded' END AS error,
    CASE WHEN failed THEN 0 ELSE length(text) END::BIGINT AS prompt_tokens,
    CASE WHEN failed THEN 0 ELSE strlen(text) END::BIGINT AS completion_tokens
  FROM rated)
"""


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event-stream lines (sample_index, seq, line).

    One line per turn, user turns as content and assistant turns as reasoning, with the
    number of turns so far as usage, an end marker after the last turn and a blank line.
    """
    turns = conversations(spark, sf_dir)
    user = F.col("role") == "user"
    delta = F.struct(
        F.when(user, F.col("text")).alias("content"),
        F.when(~user, F.col("text")).alias("reasoning_content"),
    )
    count = F.col("turn")
    usage = F.struct(
        count.alias("prompt_tokens"), (count * 2).alias("completion_tokens"), (count * 3).alias("total_tokens")
    )
    chunk = F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"), usage.alias("usage")))
    lines = turns.select(
        F.col("conv_id").alias("sample_index"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), chunk).alias("line")
    )
    last = turns.groupBy(F.col("conv_id").alias("sample_index")).agg(F.max("turn").alias("turn"))
    tail = [(1, "data: [DONE]\r"), (2, "")]
    ends = last.select(
        "sample_index",
        F.explode(
            F.array(*[F.struct((F.col("turn") + after).alias("seq"), F.lit(line).alias("line")) for after, line in tail])
        ).alias("end"),
    )
    return lines.unionByName(ends.select("sample_index", "end.*"))


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The successful responses to the documents as event-stream lines.

    A line with the reasoning, two with the halves of the content, one with the usage,
    which lacks a count where the response has no answer, an end marker, a blank line.
    """
    content, half = F.col("content"), F.floor(F.char_length("content") / 2).cast("int")

    def chunk(reasoning: Column, text: Column) -> Column:
        delta = F.struct(text.alias("content"), reasoning.alias("reasoning_content"))
        return F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices")))

    none = F.lit(None).cast("string")
    prompt, completion = F.char_length("text").cast("long"), F.octet_length("text").cast("long")
    usage = F.struct(
        F.when(F.col("doc_id") % 6 != 2, prompt).alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
    )
    told = F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), usage.alias("usage")))
    parts = [
        chunk(F.col("lang"), none), chunk(none, F.substr(content, F.lit(1), half)), chunk(none, F.substr(content, half + 1)),
        told, F.lit("[DONE]"),
    ]
    lines = [*[F.concat(F.lit("data: "), part) for part in parts], F.lit("")]
    answered = documents(spark, sf_dir).withColumn("content", response_text()).where("content IS NOT NULL")
    return answered.select(
        F.col("doc_id").alias("sample_index"), F.posexplode(F.array(*lines)).alias("position", "line")
    ).select("sample_index", F.col("position").cast("long").alias("seq"), "line")


def _utc_micros(stored: Column) -> Column:
    """Microseconds of a time stored without a zone, read as UTC whatever the session's zone."""
    second = F.extract(F.lit("SECOND"), stored) * 1_000_000
    minutes = F.unix_date(stored.cast("date")) * F.lit(1440).cast("long") + F.hour(stored) * 60 + F.minute(stored)
    return minutes * 60_000_000 + second.cast("long")


def ticks(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as ticks of their user's request; the value's whole part is the characters."""
    table = events if events is not None else read_table(spark, f"{sf_dir}/events.parquet")
    amount = F.floor(F.coalesce("value", F.lit(0.0))).cast("int")
    typed = F.col("event_type") == "view"
    return table.select(
        F.col("user_id").alias("sample_index"),
        F.col("event_id").alias("seq"),
        F.timestamp_micros(_utc_micros(F.col("ts"))).alias("ts"),
        F.when(typed, amount).otherwise(F.lit(0)).alias("content_delta_chars"),
        F.when(~typed, amount).otherwise(F.lit(0)).alias("reasoning_delta_chars"),
    )
