"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree. At each level every child draws ln(u) / weight, with u from a
digest of the child's path and the document's key, and the largest draw wins. A node weighs
what its shards weigh together. A child's draw depends on nothing but its own path and weight,
so where weights change, documents move only into, out of or inside the subtrees that hold the
change; a document outside of them on both sides stays where it is.

A shard beyond the given regions stands in a region and a rack of its own, so one more shard
takes documents only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.llm.frames import column
from tokentide.session import materialize

# Regions, racks of a region and shards of a rack of the tree that new shards are added beside.
REGIONS, RACKS, RACK_SHARDS = 5, 2, 4
OVERHEAD = 16  # bytes of a document beside its text
BLOCK_ROWS = 1024  # rows numbered together, about
RUN_ROWS = 4096  # equal rows that one task repeats
UNIT = float(1 << 52)
LEVELS = ("region", "rack", "number")


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: where it hangs and what it weighs."""

    number: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, regions: int = REGIONS, racks: int = RACKS, rack_shards: int = RACK_SHARDS) -> list[Shard]:
    """``shards`` equal shards: whole regions first, the others each in a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    region_shards = racks * rack_shards
    whole = min(regions, shards // region_shards) * region_shards
    # A shard alone has the region that no other count of shards gives another meaning.
    return [
        Shard(n, n // region_shards, n % region_shards // rack_shards) if n < whole else Shard(n, regions + n, 0)
        for n in range(shards)
    ]


def unit(path: str | Column, key: Column) -> Column:
    """A number in (0, 1] from the digest of a node's path and a key."""
    start = F.lit(path) if isinstance(path, str) else path
    digits = F.substring(F.md5(F.concat(start, F.lit("|"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(UNIT)


def _path(shard: Shard, depth: int) -> str:
    return "".join(f"/{level}{getattr(shard, level)}" for level in LEVELS[:depth])


def shard_of(key: Column, shards: Sequence[Shard]) -> Column:
    """The number of the shard that a key, as text, belongs to; shards without weight get none."""
    held = [shard for shard in shards if shard.weight > 0]
    if not held:
        raise ValueError("no shard has a weight")
    at = F.lit("")
    for depth in range(len(LEVELS)):
        weights: dict[str, dict[str, float]] = {}
        for shard in held:
            children = weights.setdefault(_path(shard, depth), {})
            child = _path(shard, depth + 1)
            children[child] = children.get(child, 0.0) + shard.weight
        listed = [
            (F.lit(parent), F.array(*[F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight")) for path, weight in children.items()]))
            for parent, children in weights.items()
        ]
        nodes = F.element_at(F.create_map(*[x for pair in listed for x in pair]), at)
        # Of equal draws, which digests of 52 bits hardly give, the larger path wins.
        draws = F.transform(nodes, lambda node: F.struct((F.ln(unit(node["path"], key)) / node["weight"]).alias("draw"), node["path"].alias("path")))
        at = F.array_max(draws)["path"]
    numbers = F.create_map(*[x for shard in held for x in (F.lit(_path(shard, len(LEVELS))), F.lit(shard.number))])
    return F.element_at(numbers, at)


def assign(
    docs: DataFrame,
    shards: Sequence[Shard],
    grown: Sequence[Shard] | None = None,
    key: str = "doc_id",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size is the text's bytes in UTF-8 plus 16; the law is ``key``: the key and the tree alone
    decide. grown_shard is the shard in the tree ``grown``, null without one. Slots number
    the rows of a shard without gaps from 0, by a digest of the key, then the key, digest and
    size of the text; rows that are equal in all of these share out a run of slots.

    A null text has no bytes and the digest 0. Null keys are one key, as is a repeated one, so
    all its rows lie in one shard. An empty table gives an empty result. Other columns take no
    part, whatever their names. Texts are never shuffled; rows are counted first, and a shard
    is numbered in blocks, so neither a shard nor a key gathers in one task.
    """
    rows = docs.select(
        column(key).alias("_key"),
        (F.coalesce(F.octet_length(column(text)), F.lit(0)) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(F.coalesce(column(text), F.lit(""))).alias("_crc"),
    )
    counted = rows.groupBy("_key", "_size", "_crc").agg(F.count(F.lit(1)).alias("_n"))
    written = F.coalesce(F.col("_key").cast("string"), F.lit(""))
    blocks = docs.count() // (block_rows * len(shards)) + 1
    place = unit("slot", written)
    drawn = counted.withColumns(
        {
            "shard": shard_of(written, shards),
            "grown_shard": F.lit(None).cast("int") if grown is None else shard_of(written, grown),
            "_unit": place,
        }
    ).withColumn("_block", F.least(F.floor(F.col("_unit") * blocks), F.lit(blocks - 1)))
    # Read twice below; the texts are read once.
    placed = materialize(drawn, "sharded")
    block = ["shard", "_block"]
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*block).agg(F.sum("_n").alias("_rows"))
    starts = sums.select(*block, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*block).orderBy("_unit", "_key", "_crc", "_size").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, block)
    # Equal rows are repeated in runs, dealt out first, so that no task writes them all.
    first = F.col("_start") + F.col("_before")
    last = first + F.col("_n") - 1
    runs = numbered.select(
        "_key", "_size", "_crc", "shard", "grown_shard", last.alias("_last"),
        F.explode(F.sequence(first, last, F.lit(RUN_ROWS).cast("long"))).alias("_run"),
    ).repartition("shard", "_run")
    end = F.least("_last", F.col("_run") + RUN_ROWS - 1)
    return runs.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence("_run", end)).alias("slot"),
        "grown_shard",
    )
