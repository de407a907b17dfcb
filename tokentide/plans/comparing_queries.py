"""Queries over alignment and the sections of a tokenizer comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokentide.operators import compare
from tokentide.operators.align import TokenizerSet, align, align_files
from tokentide.operators.counting import count_with_all
from tokentide.plans.inputs import BOUNDS, COMPARED, ITEMS_SQL, LIMITS, TOKENIZERS, documents, items
from tokentide.plans.registry import query
from tokentide.session import materialize, scratch_path

_NAMES = COMPARED.names
_LONG_SQL = ITEMS_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS tokenizer, {i} AS position, {name} AS n, pieces AS base FROM items"
    for i, name in enumerate(_NAMES)
) + ")\n"
_SUMS_SQL = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in _NAMES)
_RATIOS_SQL = ", ".join(f"{name}::DOUBLE / pieces AS {name}_ratio" for name in COMPARED.others)


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in columns})


@query(ITEMS_SQL + f'SELECT dataset, row_id, "group", {", ".join(_NAMES)} FROM items')
def align_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"documents": {}}
    for i, tokenizer in enumerate(TOKENIZERS):
        counted = count_with_all(documents(spark, sf_dir), "text", [tokenizer])
        columns = [F.col("doc_id").alias("row_id"), F.col(tokenizer.name).alias("tokens")]
        if i == 0:
            columns.append(F.concat_ws("/", "source", "lang").alias("label"))
        tables["documents"][tokenizer.name] = counted.select(*columns)
    aligned = align(tables, COMPARED)
    return aligned.withColumns(
        {
            "dataset": F.split_part("group", F.lit("/"), F.lit(1)),
            "group": F.split_part("group", F.lit("/"), F.lit(2)),
        }
    )


@query(
    ITEMS_SQL
    + """SELECT 'documents' AS dataset, row_number() OVER (ORDER BY row_id) - 1 AS row_id, dataset || '/' || "group" AS "group",
  pieces, words FROM items"""
)
def align_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two count tables of several files each, aligned by position, with a label column."""
    counted = materialize(
        count_with_all(documents(spark, sf_dir), "text", TOKENIZERS[:2]).select(
            "doc_id",
            F.concat_ws("/", "source", "lang").alias("kind"),
            *[F.col(t.name).cast("int").alias(t.name) for t in TOKENIZERS[:2]],
        ),
        "counted",
    )
    paths = []
    for files, tokenizer in zip((3, 5), TOKENIZERS):
        paths.append(scratch_path(spark, f"counts-{tokenizer.name}"))
        columns = ["kind", tokenizer.name] if not paths[1:] else [tokenizer.name]
        ordered = counted.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
        ordered.select(*columns).write.parquet(paths[-1])
    both = TokenizerSet.of([t.name for t in TOKENIZERS[:2]])
    return align_files(spark, {"documents": paths}, both, group="kind")


@query(
    _LONG_SQL
    + """, base AS (SELECT sum(pieces)::BIGINT AS b FROM items)
SELECT tokenizer, position, count(*) AS items, sum(n)::BIGINT AS sum_tokens, sum(n)::DOUBLE / count(*) AS mean_tokens,
  min(n) AS min_tokens, max(n) AS max_tokens, (sum(n) - b)::BIGINT AS difference,
  (sum(n) - b)::DOUBLE / b * 100 AS percent, quantile_cont(n::DOUBLE, 0.5) AS median_tokens
FROM long, base GROUP BY tokenizer, position, b"""
)
def compare_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overall(materialize(items(spark, sf_dir)), COMPARED)


def _groups_sql(column: str) -> str:
    return ITEMS_SQL + f""", grouped AS (SELECT coalesce("{column}", '') AS "group", grouping("{column}") = 1 AS is_total,
  count(*) AS items, {_SUMS_SQL} FROM items GROUP BY ROLLUP ("{column}"))
SELECT *, {_RATIOS_SQL} FROM grouped"""


@query(_groups_sql("dataset"))
def compare_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.group_totals(items(spark, sf_dir), COMPARED, "dataset")


@query(_groups_sql("group"))
def compare_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.group_totals(items(spark, sf_dir), COMPARED, F.col("group"))


_BUCKETS = " ".join(f"WHEN pieces < {bound} THEN {i}" for i, bound in enumerate(BOUNDS))
_BUCKET_LABELS = ["<250", "250–500", "500–1k", "1k–2k", "2k–4k", ">=4k"]


@query(
    ITEMS_SQL
    + f""", grouped AS (SELECT CASE {_BUCKETS} ELSE {len(BOUNDS)} END::INTEGER AS position, count(*) AS items, {_SUMS_SQL}
  FROM items GROUP BY position)
SELECT position, {_BUCKET_LABELS}[position + 1] AS bucket, items,
  {", ".join(f"{name}::DOUBLE / items AS {name}_mean" for name in _NAMES)}, {_RATIOS_SQL} FROM grouped"""
)
def compare_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.by_length(items(spark, sf_dir), COMPARED, BOUNDS)


_QUANTILES_SQL = ", ".join(f"('{label}', {q}::DOUBLE)" for label, q in compare.QUANTILES.items())


@query(
    _LONG_SQL
    + f""", probes(label, quantile) AS (VALUES {_QUANTILES_SQL}),
sorted AS (SELECT tokenizer, list_sort(list((n - base)::DOUBLE)) AS d, list_sort(list(n::DOUBLE / base)) AS r, count(*) AS c
  FROM long WHERE tokenizer <> 'pieces' GROUP BY tokenizer),
placed AS (SELECT *, quantile * (c - 1) AS exact, floor(quantile * (c - 1))::BIGINT + 1 AS lo,
  ceil(quantile * (c - 1))::BIGINT + 1 AS hi FROM sorted, probes)
SELECT tokenizer, label, quantile, round(d[lo] + (d[hi] - d[lo]) * (exact - floor(exact)), 6) AS difference,
  round(r[lo] + (r[hi] - r[lo]) * (exact - floor(exact)), 6) AS ratio FROM placed"""
)
def compare_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.quantiles(materialize(items(spark, sf_dir)), COMPARED), "difference", "ratio")


@query(
    _LONG_SQL
    + f""", limits("limit") AS (VALUES {", ".join(f"({limit}::BIGINT)" for limit in LIMITS)})
SELECT "limit", tokenizer, count(*) FILTER (n > "limit") AS above,
  count(*) FILTER (n > "limit") - count(*) FILTER (base > "limit") AS change
FROM long, limits GROUP BY "limit", tokenizer"""
)
def compare_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.above_limits(compare.comparison_totals(items(spark, sf_dir), COMPARED, LIMITS), COMPARED, LIMITS)


@query(
    _LONG_SQL
    + """SELECT tokenizer, count(*) FILTER (n < base) AS less, count(*) FILTER (n = base) AS equal,
  count(*) FILTER (n > base) AS more FROM long WHERE tokenizer <> 'pieces' GROUP BY tokenizer"""
)
def compare_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.directions(compare.comparison_totals(items(spark, sf_dir), COMPARED), COMPARED)


@query(
    _LONG_SQL
    + """SELECT tokenizer, round(regr_slope(n, base), 6) AS slope, round(regr_intercept(n, base), 6) AS intercept,
  round(regr_r2(n, base), 6) AS r2 FROM long WHERE tokenizer <> 'pieces' GROUP BY tokenizer"""
)
def compare_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = compare.fits(compare.comparison_totals(items(spark, sf_dir), COMPARED), COMPARED)
    return _rounded(fits, "slope", "intercept", "r2")


@query(
    ITEMS_SQL
    + ", pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS core, '{b}' AS other, {a} AS x, {b} AS y FROM items" for a in _NAMES for b in _NAMES if a != b
    )
    + """), summed AS (SELECT core, other, sum(x)::BIGINT AS core_tokens, sum(y)::BIGINT AS other_tokens,
  count(*) FILTER (y < x) AS less, count(*) FILTER (y = x) AS equal, count(*) FILTER (y > x) AS more
  FROM pairs GROUP BY core, other)
SELECT *, other_tokens - core_tokens AS difference, other_tokens::DOUBLE / core_tokens AS ratio,
  CASE WHEN other_tokens > core_tokens THEN 'more' WHEN other_tokens < core_tokens THEN 'less' ELSE 'same' END AS verdict,
  abs((other_tokens - core_tokens)::DOUBLE / core_tokens * 100) AS percent FROM summed"""
)
def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pairs(compare.comparison_totals(items(spark, sf_dir), COMPARED), COMPARED)
