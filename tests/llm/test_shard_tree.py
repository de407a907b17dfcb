"""The weighted hash tree: the law of keys, movement, slots."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tokentide.llm.shard_tree import LEVELS, Shard, assign, shard_of, tree
from tests.plans import plan_text


def plain(key, shards):
    """The descent, node by node."""
    path = ""
    inside = [s for s in shards if s.weight > 0]
    for level in LEVELS:
        children = defaultdict(list)
        for shard in inside:
            children[f"{path}/{level}{getattr(shard, level)}"].append(shard)

        def draw(child):
            number = int(hashlib.md5(f"{child}|{key}".encode()).hexdigest()[:13], 16)
            return math.log((number + 1) / 2**52) / sum(s.weight for s in children[child])

        path = max(children, key=draw)
        inside = children[path]
    return inside[0].number


def places(spark, shards, keys=4000):
    frame = spark.range(keys).select(F.col("id"), shard_of(F.col("id").cast("string"), shards).alias("shard"))
    return {r.id: r.shard for r in frame.collect()}


def test_descent_is_the_plain_one(spark):
    shards = [Shard(0, 0, 0, 2.0), Shard(1, 0, 1), Shard(2, 0, 1, 0.5), Shard(3, 1, 0), Shard(4, 2, 0, 0.0), Shard(7, 3, 5, 3.0)]
    found = places(spark, shards, 500)
    assert found == {key: plain(key, shards) for key in range(500)}


def test_shares_follow_weights(spark):
    shards = [replace(shard, weight=1.0 + shard.number % 3) for shard in tree(12, 2, 2, 2)]
    found, total = Counter(places(spark, shards, 20_000).values()), sum(s.weight for s in shards)
    for shard in shards:
        mean = 20_000 * shard.weight / total
        assert abs(found[shard.number] - mean) < 5 * math.sqrt(mean)


@pytest.mark.parametrize("count", [1, 7, 40, 41, 47, 48, 63])
def test_one_more_shard_takes_keys_only_into_itself(spark, count):
    before, after = places(spark, tree(count)), places(spark, tree(count + 1))
    if count + 1 in (8, 16, 24, 32, 40):
        return
    moved = [key for key in before if before[key] != after[key]]
    assert moved and all(after[key] == count for key in moved)
    assert abs(len(moved) - 4000 / (count + 1)) < 5 * math.sqrt(4000 / (count + 1)) + 1


def test_a_new_weight_moves_keys_only_at_its_subtrees(spark):
    shards = tree(40)
    heavier = [replace(s, weight=3.0) if s.number == 13 else s for s in shards]
    changed = {s.number: s for s in shards}
    before, after = places(spark, shards), places(spark, heavier)
    own = changed[13]
    moved = [(changed[before[key]], changed[after[key]]) for key in before if before[key] != after[key]]
    assert moved
    for old, new in moved:
        assert new.region == own.region
        if old.region == own.region:
            assert new.rack == own.rack
            if old.rack == own.rack:
                assert new.number == 13


def assigned(frame, **options):
    return assign(frame, tree(40), tree(41), **options).collect()


def test_slots_sizes_and_digests(rows):
    data = [(n, "é" * (n % 5)) for n in range(3000)] + [(None, "x"), (None, None), (7, "other"), (9000, None)]
    data += [(123, "copy")] * 9000 + [(None, "same")] * 5
    for block_rows in (10, 1024):
        found = assigned(rows([(*d, 1, "s") for d in data], "doc_id long, text string, shard int, slot string"), block_rows=block_rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
            (key, len((text or "").encode()) + 16, zlib.crc32((text or "").encode())) for key, text in data
        )
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
            name = "" if r.doc_id is None else str(r.doc_id)
            assert r.law == "key" and r.shard == plain(name, tree(40)) and r.grown_shard in (r.shard, 40)
        assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    again = assigned(rows([(*d, 1, "s") for d in reversed(data)], "doc_id long, text string, shard int, slot string").repartition(7))
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_no_grown_tree_and_no_rows(rows):
    found = assign(rows([(1, "a")], "doc_id long, text string"), tree(3)).first()
    assert found.grown_shard is None and found.slot == 0
    assert assigned(rows([], "doc_id long, text string")) == []
    with pytest.raises(ValueError):
        tree(0)
    with pytest.raises(ValueError):
        shard_of(F.lit("x"), [Shard(0, 0, 0, 0.0)])


def test_plan_is_native(rows):
    plan = plan_text(assign(rows([(1, "a")], "doc_id long, text string"), tree(40), tree(41)))
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
