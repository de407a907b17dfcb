"""Mixing sources to target weights by blocks of equally many words.

A source's documents, in the order of shards and ids, are one stream of words cut into
blocks. Blocks are allotted to sources, and a source's blocks to its shards, by highest
quotients w / (2k + 1), so quotas are integers that add up. A shard then takes its quota
in a seeded order of its blocks, and a document gets the words of it that were taken.

Shards are about the square root of the table in number and in rows each, so neither a
source's shards nor a shard's documents gather much in one task, however large a source is.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.llm.frames import carried, column

WHITE = r"\x20\x09-\x0D"
# Fixed odd primes; a shard of fewer blocks than the prime is walked once by its multiples.
PRIMES = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts 0. Each word becomes one letter first."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(inner, f"[^{WHITE}]+[{WHITE}]*", "x")).cast("long")


def _number(text: Column) -> Column:
    """A number below 2^32 from the digest of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(
    units: DataFrame, groups: Sequence[str], unit: str, weight: str, seats: str, total: str
) -> DataFrame:
    """``units`` with quota: the group's ``seats`` given by highest quotients weight / (2k + 1).

    Each unit starts at its rounded proportional share. What is then missing or too much
    moves a unit by at most its share of half the group's units, plus one; only so many
    quotients per unit are compared, so the work stays linear. ``unit`` is a number that
    names a unit in its group and breaks ties; ``total`` holds the group's weights.
    """
    group = W.partitionBy(*groups)
    share = F.coalesce(F.col(seats) * F.col(weight) / F.nullif(F.col(total), F.lit(0)), F.lit(0.0))
    part = F.coalesce(F.col(weight) / F.nullif(F.col(total), F.lit(0)), F.lit(0.0))
    started = units.withColumn("_start", F.floor(share + 0.5)).withColumns(
        {
            "_gap": F.col(seats) - F.sum("_start").over(group),
            "_spare": (F.floor(part * F.count(F.lit(1)).over(group) / 2) + 1).cast("int"),
        }
    )
    tried = started.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_spare"))))
    more = F.col("_gap") >= 0
    # Weights are divided as doubles, so that equal quotients are equal in any engine.
    divisor = F.when(more, 2 * (F.col("_start") + F.col("_j")) + 1).otherwise(
        2 * (F.col("_start") - 1 - F.col("_j")) + 1
    )
    able = more | (F.col("_j") < F.col("_start"))
    quotient = F.col(weight).cast("double") / divisor
    place = F.row_number().over(
        group.orderBy(
            able.desc(),
            F.when(more, -quotient).otherwise(quotient),
            F.when(more, F.col(unit)).otherwise(-F.col(unit)),
            "_j",
        )
    )
    picked = (able & (place <= F.abs("_gap"))).cast("long")
    kept = [name for name in units.columns if name not in (*groups, unit)]
    ranked = tried.withColumn("_picked", picked)
    summed = ranked.groupBy(*groups, unit).agg(
        F.first(F.struct(*[F.col(name) for name in kept], "_start", "_gap")).alias("_unit"),
        F.sum("_picked").alias("_moved"),
    )
    moved = F.when(F.col("_unit._gap") >= 0, F.col("_moved")).otherwise(-F.col("_moved"))
    return summed.select(
        *groups,
        unit,
        *[F.col("_unit").getField(name).alias(name) for name in kept],
        (F.col("_unit._start") + moved).cast("long").alias("quota"),
    )


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Sources (_src, _words) with _rank, target and _all, the sum of all targets.

    Sources in the order of code points, null last, weigh ``weights``, repeating. They
    share ``share`` of all words; a target stops at ``most`` times its source and the rest
    is shared again by weight. One row per source, so the windows over all of them stay small.
    """
    everything = W.partitionBy()
    ranked = sources.withColumn("_rank", F.row_number().over(W.orderBy("_src")) - 1)
    choices = F.array(*[F.lit(int(weight)) for weight in weights])
    weighed = ranked.withColumns(
        {
            "_weight": F.element_at(choices, F.col("_rank") % len(weights) + 1).cast("long"),
            "_cap": F.col("_words") * most,
            "_pool": F.sum("_words").over(everything) * F.lit(float(share)),
        }
    )
    by_room = W.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    earlier = F.coalesce(F.sum("_cap").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(by_room.rowsBetween(0, W.unboundedFollowing))
    full = F.col("_cap") * rest <= (F.col("_pool") - earlier) * F.col("_weight")
    # Once a source has room to spare, so has every later one.
    stopped = weighed.withColumn("_full", full.cast("int")).withColumn(
        "_full", F.min("_full").over(by_room.rowsBetween(W.unboundedPreceding, 0)) == 1
    )
    capped = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything)
    return stopped.select(
        "_src",
        "_words",
        "_rank",
        F.when(F.col("_full"), F.col("_cap").cast("double"))
        .otherwise((F.col("_pool") - capped) * F.col("_weight") / open_weight)
        .alias("target"),
        F.least("_pool", (F.sum("_words").over(everything) * most).cast("double")).alias("_all"),
    )


def _shards(sized: DataFrame, weights: Sequence[int], share: float, most: int, block: int, seed: int) -> DataFrame:
    """One row per shard: its words before, blocks and quota, and the shard a cut block began in."""
    sums = sized.groupBy("_src", "_shard").agg(F.sum("size").alias("_words"))
    sources = sums.groupBy("_src").agg(F.sum("_words").alias("_words"))
    targets = source_targets(sources, weights, share, most).withColumns(
        {
            "_none": F.lit(0),
            "_total_seats": F.floor(F.col("_all") / block + 0.5),
            "_blocks": F.floor((F.col("_words") + (block - 1)) / block),
        }
    )
    seated = apportion(targets, [], "_rank", "target", "_total_seats", "_all").select(
        "_src",
        F.col("_words").alias("source_size"),
        "target",
        F.col("_blocks").alias("_source_blocks"),
        F.least("quota", F.col("_blocks") * most).alias("_seats"),
    )
    in_order = W.partitionBy("_src").orderBy("_shard")
    before = F.coalesce(F.sum("_words").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ceiling = lambda words: F.floor((words + (block - 1)) / block)
    placed = (
        sums.withColumn("_before", before)
        .withColumn("_first", ceiling(F.col("_before")))
        .withColumn("_n", ceiling(F.col("_before") + F.col("_words")) - F.col("_first"))
        .join(seated, "_src")
    )
    quotas = apportion(placed, ["_src"], "_shard", "_n", "_seats", "_source_blocks")
    own = F.struct(
        F.col("_first").alias("first"),
        F.col("_n").alias("n"),
        F.floor(F.col("quota") / F.col("_n")).alias("base"),
        (F.col("quota") % F.col("_n")).alias("extra"),
        (_number(F.concat_ws("|", F.lit(seed).cast("string"), "_src", F.col("_shard").cast("string"))) % F.col("_n")).alias(
            "offset"
        ),
    )
    return quotas.withColumn("_own", F.when(F.col("_n") > 0, own)).select(
        "_src",
        "_shard",
        "source_size",
        "target",
        "_before",
        "_own",
        F.last("_own", ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, -1)).alias("_prior"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int],
    share: float = 1.5,
    most: int = 2,
    block: int = 16,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    texts: bool = False,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken, and with ``texts`` the taken texts.

    A document's size is its number of words; taken counts the words that the mix takes of
    it, repeats included, at most ``most`` times its size. texts holds one text per copy:
    the whole text, or the words of the blocks taken so often. Blocks that a source has
    beyond ``most`` times its own stay unfilled.

    A null text has no words and is never taken. A null source is a source, last in order.
    Rows without id are dealt to shards by their texts and come first there; repeated rows
    stand beside each other in the stream and each gets its share; texts of one id and size
    follow their hashes. Ties between quotients go to the earlier source or shard. An
    empty table gives an empty result. Input columns named like added ones are replaced.
    ``docs`` is read twice: write it before if it is costly to compute.
    """
    shards = isqrt(docs.count()) + 1
    key_text = F.coalesce(column(key).cast("string"), F.md5(F.coalesce(column(text), F.lit(""))))
    # A key with an order: "0" before each name puts null, "1", last.
    src = F.when(column(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column(source).cast("string")))
    added = [*ADDED, *(["texts"] if texts else [])]
    away, back = carried(docs, added)
    rows = docs.select(
        *away,
        column(key).alias("_key"),
        src.alias("_src"),
        (_number(key_text) % shards).alias("_shard"),
        word_count(column(text)).alias("size"),
        F.xxhash64(column(text)).alias("_tie"),
        *([column(text).alias("_text")] if texts else []),
    )
    info = _shards(rows.select("_src", "_shard", "size"), weights, share, most, block, seed)
    in_shard = W.partitionBy("_src", "_shard").orderBy("_key", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(info, ["_src", "_shard"]).withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("size").over(in_shard), F.lit(0))
    )
    step = PRIMES[seed % len(PRIMES)]

    def times(at: Column) -> Column:
        def of(shard: str) -> Column:
            s = F.col(shard)
            order = ((at - s["first"]) * (F.lit(step) % s["n"]) + s["offset"]) % s["n"]
            return s["base"] + (order < s["extra"]).cast("long")

        return F.when(at >= F.col("_own.first"), of("_own")).otherwise(of("_prior"))

    start, end = F.col("_from"), F.col("_from") + F.col("size")
    blocks = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    words = lambda at: F.least(end, (at + 1) * block) - F.greatest(start, at * block)
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda sum_, at: sum_ + words(at) * times(at))
    result = placed.withColumn("taken", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(taken))
    if texts:
        least = F.array_min(F.transform(blocks, times))
        pieces = F.regexp_extract_all("_text", F.lit(f"[^{WHITE}]+[{WHITE}]*"), F.lit(0))

        def copy(number: int) -> Column:
            cut = F.array_join(F.filter(pieces, lambda _, i: times(F.floor((start + i) / block)) >= number), "")
            return F.when(least >= number, F.col("_text")).otherwise(cut)

        copies = F.array(*[copy(number) for number in range(1, most + 1)])
        none = F.array().cast("array<string>")
        result = result.withColumn(
            "texts", F.when(F.col("taken") == 0, none).otherwise(F.filter(copies, lambda one: one != ""))
        )
    return result.select(*back, *added)
