"""Queries over text corpora: trees of files, natural order, groups, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokentide.functions.paths import natural_key, parent
from tokentide.operators import corpus
from tokentide.operators.ordering import with_position
from tokentide.plans.inputs import (
    FILE_COMPARED, FILE_TOKENIZERS, FILES_SQL, documents, file_items, files,
)
from tokentide.plans.registry import query
from tokentide.session import materialize, scratch_path
from tokentide.sources.text_files import read_text_files

CHUNK = 50
_SUMS_SQL = ", ".join(
    f"CAST(sum({name}) AS BIGINT) AS {name}" for name in ("chars", *FILE_COMPARED.names)
)
_RATIOS_SQL = ", ".join(f"{name}::DOUBLE / pieces AS {name}_ratio" for name in FILE_COMPARED.others)
_COLUMNS_SQL = ", ".join(FILE_COMPARED.names)


@query(FILES_SQL + f', grouped AS (SELECT "group", count(*) AS items, {_SUMS_SQL} FROM files GROUP BY "group")\n'
       f"SELECT *, {_RATIOS_SQL} FROM grouped")
def corpus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.file_groups(file_items(spark, sf_dir), FILE_COMPARED)


@query(FILES_SQL + f""", grouped AS (SELECT regexp_extract(path, '^(.*)/', 1) AS "group", count(*) AS items, {_SUMS_SQL}
  FROM files GROUP BY 1)
SELECT *, {_RATIOS_SQL} FROM grouped""")
def corpus_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus.count_files(files(spark, sf_dir), FILE_TOKENIZERS, group=parent)
    return corpus.file_groups(items, FILE_COMPARED)


@query(
    FILES_SQL
    + f""", placed AS (SELECT *, (row_number() OVER (PARTITION BY "group" ORDER BY doc_id % 3, doc_id) - 1) AS position FROM files),
chunked AS (SELECT "group", position // {CHUNK} AS chunk, arg_min(path, position) AS f, arg_max(path, position) AS l,
  count(*) AS items, {_SUMS_SQL} FROM placed GROUP BY "group", chunk)
SELECT "group", chunk, substr(f, length("group") + 2) AS first, substr(l, length("group") + 2) AS last, items, chars,
  {_COLUMNS_SQL}, {_RATIOS_SQL} FROM chunked"""
)
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_totals(materialize(file_items(spark, sf_dir)), FILE_COMPARED, CHUNK)


@query(FILES_SQL + f'SELECT "group", path, chars, {_COLUMNS_SQL}, {_RATIOS_SQL} FROM files')
def corpus_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.details(materialize(file_items(spark, sf_dir)), FILE_COMPARED)


@query(
    """WITH parts AS (SELECT page_id, url, list_transform(
  regexp_extract_all(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+|[^0-9]+'),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
    THEN {'kind': 1, 'width': length(ltrim(x, '0')), 'text': ltrim(x, '0'), 'written': length(x)}
    ELSE {'kind': 0, 'width': 0, 'text': x, 'written': 0} END) AS k FROM pages)
SELECT page_id, url, row_number() OVER (ORDER BY k, url, page_id) - 1 AS position FROM parts"""
)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return with_position(pages, [natural_key(F.col("url")), "url", "page_id"])


@query("SELECT 'lang=' || lang AS \"group\", CAST(sum(length(text) + 1) AS BIGINT) AS chars,"
       " CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE lang <> 'de' GROUP BY lang")
def text_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of text files and read back, without one folder."""
    root = scratch_path(spark, "tree")
    tree = documents(spark, sf_dir).select("lang", "text")
    tree.write.partitionBy("lang").option("maxRecordsPerFile", 200).text(root)
    found = read_text_files(spark, root, extensions=[".TXT"], excludes=["lang=de"])
    counted = corpus.count_files(found, FILE_TOKENIZERS)
    return counted.groupBy("group").agg(F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"))
