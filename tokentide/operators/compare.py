"""Comparison of several tokenizers over aligned items.

Items carry one long count column per tokenizer, named after it. ``comparison_totals``
folds every total, direction, limit and fit into one row in one pass over them; the
sections that need nothing else are read off that row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, functions as F

from tokentide.functions.buckets import CONTEXT_LIMITS, LENGTH_BOUNDS, bucket_label, length_bucket
from tokentide.functions.numbers import NAN, percent_change, ratio
from tokentide.operators.align import TokenizerSet
from tokentide.operators.ordering import exact_quantiles

# The reported quantiles.
QUANTILES = {
    "min": 0.0, "P10": 0.1, "P25": 0.25, "P50": 0.5, "P75": 0.75, "P90": 0.9, "P99": 0.99, "max": 1.0,
}


def comparison_totals(
    items: DataFrame, tokenizers: TokenizerSet, limits: Sequence[int] = CONTEXT_LIMITS
) -> DataFrame:
    """One row with every count, sum, limit, direction and fit; no items is an error."""
    names = tokenizers.names
    primary = F.col(f"`{tokenizers.primary}`").cast("double")
    rows = F.count(F.lit(1))
    some = F.when(rows == 0, F.raise_error(F.lit("no items to compare")).cast("long"))
    aggregates = [some.otherwise(rows).alias("items")]
    for i, name in enumerate(names):
        count = F.col(f"`{name}`")
        aggregates += [
            F.sum(count).alias(f"sum_{i}"),
            F.min(count).alias(f"min_{i}"),
            F.max(count).alias(f"max_{i}"),
            *[F.count_if(count > limit).alias(f"above_{i}_{limit}") for limit in limits],
        ]
        if name != tokenizers.primary:
            y = count.cast("double")
            flat = F.var_pop(y) == 0
            r2 = F.when(flat, F.lit(NAN)).otherwise(F.coalesce(F.regr_r2(y, primary), F.lit(NAN)))
            aggregates += [
                F.coalesce(F.regr_slope(y, primary), F.lit(NAN)).alias(f"slope_{i}"),
                F.coalesce(F.regr_intercept(y, primary), F.lit(NAN)).alias(f"intercept_{i}"),
                r2.alias(f"r2_{i}"),
            ]
    for (i, one), (j, two) in combinations(enumerate(names), 2):
        first, second = F.col(f"`{one}`"), F.col(f"`{two}`")
        aggregates += [
            F.count_if(first < second).alias(f"less_{i}_{j}"),
            F.count_if(first > second).alias(f"less_{j}_{i}"),
        ]
    return items.agg(*aggregates)


def _rows(totals: DataFrame, entries: Sequence[Sequence[Column]]) -> DataFrame:
    """One result row per entry, each a list of named columns of the totals."""
    return totals.select(F.explode(F.array(*[F.struct(*entry) for entry in entries])).alias("r")).select("r.*")


def _directions(i: int, j: int) -> list[Column]:
    """Items where tokenizer i counts less than, the same as and more than tokenizer j."""
    less, more = F.col(f"less_{i}_{j}"), F.col(f"less_{j}_{i}")
    return [
        less.alias("less"),
        (F.col("items") - less - more).alias("equal"),
        more.alias("more"),
    ]


def overall(items: DataFrame, tokenizers: TokenizerSet, totals: DataFrame | None = None) -> DataFrame:
    """Per tokenizer: sum, mean, median, min, max, difference and percent to the primary."""
    totals = comparison_totals(items, tokenizers, ()) if totals is None else totals
    base = F.col(f"sum_{tokenizers.names.index(tokenizers.primary)}")
    entries = []
    for i, name in enumerate(tokenizers.names):
        total = F.col(f"sum_{i}")
        entries.append(
            [
                F.lit(name).alias("tokenizer"),
                F.lit(i).alias("position"),
                F.col("items"),
                total.alias("sum_tokens"),
                (total / F.col("items")).alias("mean_tokens"),
                F.col(f"min_{i}").alias("min_tokens"),
                F.col(f"max_{i}").alias("max_tokens"),
                (total - base).alias("difference"),
                percent_change(total - base, base).alias("percent"),
            ]
        )
    medians = exact_quantiles(items, {name: (F.col(f"`{name}`"), [0.5]) for name in tokenizers.names})
    return _rows(totals, entries).join(
        medians.select(F.col("measure").alias("tokenizer"), F.col("value").alias("median_tokens")), "tokenizer"
    )


def group_totals(
    items: DataFrame,
    tokenizers: TokenizerSet,
    group: str | Column,
    sums: Sequence[str] = (),
    grand_total: bool = True,
) -> DataFrame:
    """Per group: rows, total per tokenizer, ratio of totals to the primary.

    ``group`` is a column or any expression; a null group is ``""``. ``sums`` names
    further columns to total (characters, say). The grand total is merged from the
    groups and has ``is_total`` set.
    """
    key = F.col(group) if isinstance(group, str) else group
    columns = [*sums, *tokenizers.names]
    by_group = items.groupBy(F.coalesce(key.cast("string"), F.lit("")).alias("group")).agg(
        F.count(F.lit(1)).alias("items"), *[F.sum(f"`{name}`").alias(name) for name in columns]
    )
    if not grand_total:
        return by_group.select("*", *_ratios(tokenizers))
    merged = by_group.rollup("group").agg(
        F.grouping("group").cast("boolean").alias("is_total"),
        *[F.sum(f"`{name}`").alias(name) for name in ["items", *columns]],
    )
    return merged.withColumn("group", F.coalesce("group", F.lit(""))).select("*", *_ratios(tokenizers))


def _ratios(tokenizers: TokenizerSet) -> list[Column]:
    base = F.col(f"`{tokenizers.primary}`")
    return [ratio(F.col(f"`{name}`"), base).alias(f"{name}_ratio") for name in tokenizers.others]


def by_length(
    items: DataFrame, tokenizers: TokenizerSet, bounds: Sequence[int] = LENGTH_BOUNDS
) -> DataFrame:
    """Per length bucket of the primary's count: rows, mean per tokenizer, ratio of totals.

    A bucket holds its lower bound and not its upper one; empty buckets are absent.
    """
    index = length_bucket(F.col(f"`{tokenizers.primary}`"), bounds)
    grouped = items.groupBy(index.alias("position")).agg(
        F.count(F.lit(1)).alias("items"),
        *[F.sum(f"`{name}`").alias(name) for name in tokenizers.names],
    )
    return grouped.select(
        "position",
        bucket_label(F.col("position"), bounds).alias("bucket"),
        "items",
        *[(F.col(f"`{name}`") / F.col("items")).alias(f"{name}_mean") for name in tokenizers.names],
        *_ratios(tokenizers),
    )


def quantiles(items: DataFrame, tokenizers: TokenizerSet) -> DataFrame:
    """Exact quantiles of each item's difference and ratio to the primary."""
    base = F.col(f"`{tokenizers.primary}`")
    measures = {}
    for i, name in enumerate(tokenizers.names):
        if name != tokenizers.primary:
            count, probes = F.col(f"`{name}`"), list(QUANTILES.values())
            measures[f"difference_{i}"] = (count - base, probes)
            measures[f"ratio_{i}"] = (ratio(count, base), probes)
    kind, index = F.split_part("measure", F.lit("_"), F.lit(1)), F.split_part("measure", F.lit("_"), F.lit(2))
    label = F.element_at(
        F.create_map(*[F.lit(part) for label, q in QUANTILES.items() for part in (q, label)]), F.col("quantile")
    )
    names = F.array(*map(F.lit, tokenizers.names))
    return (
        exact_quantiles(items, measures)
        .groupBy(
            F.element_at(names, index.cast("int") + 1).alias("tokenizer"),
            label.alias("label"),
            "quantile",
        )
        .agg(
            F.max(F.when(kind == "difference", F.col("value"))).alias("difference"),
            F.max(F.when(kind == "ratio", F.col("value"))).alias("ratio"),
        )
    )


def above_limits(
    totals: DataFrame, tokenizers: TokenizerSet, limits: Sequence[int] = CONTEXT_LIMITS
) -> DataFrame:
    """Items above each context limit per tokenizer, and the change against the primary."""
    base = tokenizers.names.index(tokenizers.primary)
    return _rows(
        totals,
        [
            [
                F.lit(limit).cast("long").alias("limit"),
                F.lit(name).alias("tokenizer"),
                F.col(f"above_{i}_{limit}").alias("above"),
                (F.col(f"above_{i}_{limit}") - F.col(f"above_{base}_{limit}")).alias("change"),
            ]
            for limit in limits
            for i, name in enumerate(tokenizers.names)
        ],
    )


def directions(totals: DataFrame, tokenizers: TokenizerSet) -> DataFrame:
    """Items where a tokenizer counts less than, the same as and more than the primary."""
    base = tokenizers.names.index(tokenizers.primary)
    return _rows(
        totals,
        [
            [F.lit(name).alias("tokenizer"), *_directions(i, base)]
            for i, name in enumerate(tokenizers.names)
            if i != base
        ],
    )


def fits(totals: DataFrame, tokenizers: TokenizerSet) -> DataFrame:
    """Least-squares line of each tokenizer on the primary; NaN where it is undefined."""
    return _rows(
        totals,
        [
            [
                F.lit(name).alias("tokenizer"),
                *[F.col(f"{part}_{i}").alias(part) for part in ("slope", "intercept", "r2")],
            ]
            for i, name in enumerate(tokenizers.names)
            if name != tokenizers.primary
        ],
    )


def pairs(totals: DataFrame, tokenizers: TokenizerSet) -> DataFrame:
    """Every ordered pair (core, other): totals, ratio, directions and verdict."""
    entries = []
    for (i, core), (j, other) in permutations(enumerate(tokenizers.names), 2):
        mine, theirs = F.col(f"sum_{i}"), F.col(f"sum_{j}")
        entries.append(
            [
                F.lit(core).alias("core"),
                F.lit(other).alias("other"),
                mine.alias("core_tokens"),
                theirs.alias("other_tokens"),
                (theirs - mine).alias("difference"),
                ratio(theirs, mine).alias("ratio"),
                *_directions(j, i),
                verdict(mine, theirs).alias("verdict"),
                F.abs(percent_change(theirs - mine, mine)).alias("percent"),
            ]
        )
    return _rows(totals, entries)


def verdict(core: Column, other: Column) -> Column:
    """Whether the other total is ``more``, ``less`` or the ``same``."""
    return F.when(other > core, "more").when(other < core, "less").otherwise("same")
