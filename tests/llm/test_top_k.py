"""Exact top-k against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentide.llm import top_k


def brute_force(data, k, picks):
    usable = {}
    rows = []
    for key, vector in data:
        if key is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        rows.append((key, [math.floor(256 * x) for x in vector]))
    found = set()
    for key, q in rows:
        if not picks(key):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=True)), other) for other, v in rows if other != key and len(v) == len(q)
        )
        usable.setdefault(key, scored)
    for key, scored in usable.items():
        found |= {(key, rank + 1, other, -score) for rank, (score, other) in enumerate(scored[:k])}
    return found


def search(frame, **options):
    return {tuple(r) for r in top_k.top_k(frame, F.col("vec_id") % 3 == 0, **options).collect()}


@pytest.mark.parametrize("shard_rows, block_rows", [(10_000, 10_000), (60, 20)])
def test_equals_brute_force(rows, shard_rows, block_rows):
    chance = np.random.default_rng(1)
    centres = chance.normal(size=(5, 8))
    data = [(i, (centres[i % 5] + 0.2 * chance.normal(size=8)).tolist()) for i in range(500)]
    data += [(600 + i, [0.25] * 8) for i in range(150)]  # many equal vectors
    data += [(800, None), (801, [1.0] * 7 + [None]), (804, [float("nan")] * 8), (807, [float("inf")] + [0.0] * 7), (810, []), (None, [1.0] * 8)]
    data += [(900, [1.0, 2.0]), (903, [3.0, 4.0]), (906, [-1.0, 0.5])]  # of another length
    frame = rows([(*d, "x", 1) for d in data], "vec_id long, embedding array<double>, score string, rank int")
    found = search(frame, shard_rows=shard_rows, block_rows=block_rows)
    assert found == brute_force(data, 5, lambda key: key % 3 == 0)


def test_few_candidates_repeated_ids_and_empty(rows):
    schema = "vec_id long, embedding array<float>"
    assert search(rows([], schema)) == set()
    assert search(rows([(0, [1.0])], schema)) == set()
    assert search(rows([(0, [1.0]), (1, [2.0]), (1, [3.0])], schema)) == {(0, 1, 1, 256 * 768), (0, 2, 1, 256 * 512)}


def test_large_components_are_exact(rows):
    data = [(0, [1e15, 3.0]), (1, [1e3, 1.0]), (2, [1e3, 1.0 + 1 / 256]), (3, [-1e30, 0.0]), (4, [1e17, 1e17])]
    found = {(r.query_id, r.vec_id): r.score for r in top_k.top_k(rows(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert found[0, 1] == found[0, 2] == found[0, 4] == (1 << 63) - 1 and found[0, 3] == -(1 << 63)
    near = [(0, [1e7, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 1.0 + 1 / 256])]
    found = {r.vec_id: r.score for r in top_k.top_k(rows(near, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert found == {1: 256**2 * (10**13 + 3), 2: 256**2 * (10**13 + 3) + 768}


def test_tree_bounds_hold():
    chance = np.random.default_rng(2)
    vectors = np.floor(chance.normal(size=(1000, 4)) * 256)
    tree = top_k.build(vectors, leaf=16)
    assert sorted(tree.order.tolist()) == list(range(1000))
    for node in range(len(tree.start)):
        own = vectors[tree.order[tree.start[node] : tree.end[node]]]
        assert (np.sqrt(((own - tree.centre[node]) ** 2).sum(axis=1)) <= tree.radius[node] + 1e-9).all()
        assert tree.left[node] >= 0 or len(own) <= 16


def test_far_shards_are_not_asked(spark, rows):
    """On clustered data few queries travel, and every pair that is left out scores below the query's bar."""
    chance = np.random.default_rng(3)
    centres = np.eye(16) * 4
    data = [(i, (centres[i % 16] + 0.05 * chance.normal(size=16)).tolist()) for i in range(3200)]
    frame = rows(data, "id long, vector array<double>")
    good = frame.selectExpr("id", "16 AS width", "transform(vector, x -> floor(256 * x) * 1D) AS vector", "id % 10 = 0 AS asks")
    own = top_k.deal(good, 200)
    home = own.groupBy("width", "shard").applyInPandas(top_k._at_home(5), f"{top_k._FOUND}, width int, shard long, {top_k._BALL}")
    kth = {}
    for row in home.where("shard IS NULL").collect():
        kth.setdefault(row.query_id, []).append(row.score)
    least = {query: float(min(found)) if len(found) == 5 else float("-inf") for query, found in kth.items()}
    bars = rows(sorted(least.items()), "id long, least double")
    asked = own.where("asks").join(bars, "id").select("width", "shard", "id", "vector", "least")
    balls = home.where("shard IS NOT NULL").drop("query_id", "vec_id", "score")
    sent = {(r.id, r.shard) for r in top_k.reached(asked, balls, 100).collect()}
    placed = own.collect()
    shards = {r.shard for r in placed}
    pairs = 320 * (len(shards) - 1)
    assert len(placed) == 3200 and len(shards) >= 16 and balls.count() == len(shards)
    assert 0 < len(least) == 320 and len(sent) < pairs / 3
    vectors = np.array([r.vector for r in placed])
    homes = {r.id: r.shard for r in placed}
    for row in placed:
        if row.asks:
            scores = vectors @ np.array(row.vector)
            good_in = {homes[p.id] for p, score in zip(placed, scores, strict=True) if score > least[row.id] and p.id != row.id}
            assert good_in - {row.shard} <= {shard for query, shard in sent if query == row.id}


def test_equal_vectors_are_cut_into_shards(rows):
    data = [(i, [1.0, 2.0]) for i in range(1000)]
    frame = rows(data, "id long, vector array<double>").selectExpr("id", "2 AS width", "vector", "false AS asks")
    sizes = [r["count"] for r in top_k.deal(frame, 100).groupBy("shard").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 200
