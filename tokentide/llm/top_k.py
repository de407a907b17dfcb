"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Candidates are dealt to shards by the two pivots nearest to them, so a shard is a small ball of
the space, and each shard has a ball tree in its task. A query first searches one shard, its own;
the k-th score found there is shared with all others. It then travels only to the shards whose
ball, centre product plus radius times query length, reaches that score, and skips every
node of their trees that does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.llm.frames import column, slices
from tokentide.session import materialize, ship_package

LEAF = 128  # candidates in a leaf of a tree
PIVOTS = 256  # vectors that divide the space into shards, at most
EXACT = float(1 << 53)  # integers below this are exact as doubles


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite, also once scaled."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7e308 / 256)
    return F.coalesce(F.forall(vector.cast("array<double>"), good), F.lit(False))


def scaled(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x as a double, kept as doubles that are whole numbers."""
    return F.transform(
        vector.cast("array<double>"), lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-9e18)), F.lit(9e18))).cast("double")
    )


@dataclass
class Tree:
    """A ball tree: nodes in depth-first order; a leaf holds rows ``start`` to ``end``."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def build(vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve each ball across its widest component until at most ``leaf`` rows are left."""
    order = np.arange(len(vectors))
    nodes: list[list] = []
    waiting = [(0, len(vectors), -1, False)]
    while waiting:
        start, end, parent, is_right = waiting.pop()
        own = vectors[order[start:end]]
        centre = own.mean(axis=0)
        at = len(nodes)
        nodes.append([start, end, -1, -1, centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))])
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = at
        if end - start > leaf:
            widest = np.argmax(own.max(axis=0) - own.min(axis=0))
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, widest], half)]
            waiting += [(start + half, end, at, True), (start, start + half, at, False)]
    columns = [np.array(values) for values in zip(*nodes, strict=True)]
    return Tree(order, *columns)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond the range of a long they stop at its ends."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    if np.abs(left).sum(axis=1).max() * np.abs(right).max() < EXACT:
        return (left @ right.T).astype(np.int64)
    whole = lambda rows: np.array([[int(x) for x in row] for row in rows], dtype=object)
    found = whole(left).dot(whole(right).T)
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(
    tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int
) -> pd.DataFrame:
    """The best k candidates of each query with a score of at least ``least``; ties to smaller ids.

    All queries of a block descend together: each pops its most promising node, queries at
    the same leaf share one product, and a query ends when its best bound is below its k-th score.
    """
    lengths = np.sqrt((queries**2).sum(axis=1))
    reach = np.abs(vectors).max(initial=1.0) * np.sqrt(max(1, vectors.shape[1]))

    def bounds(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        slack = 1 + lengths[rows] * reach * 1e-9  # rounding must not hide a candidate
        return (queries[rows] * tree.centre[nodes]).sum(axis=1) + lengths[rows] * tree.radius[nodes] + slack

    count = len(queries)
    kth = least.astype(float).copy()
    best_ids = [np.empty(0, np.int64)] * count
    best_scores = [np.empty(0, np.int64)] * count
    root = bounds(np.arange(count), np.zeros(count, int))
    heaps: list[list[tuple[float, int]]] = [[(float(bound), 0)] for bound in root]
    active = np.arange(count)
    while len(active):
        # Each active query goes down from its best node to a leaf, keeping the other branches.
        leaf_of = np.full(count, -1)
        at = np.full(count, -1)
        moving = []
        for query in active:
            heap = heaps[query]
            best = max(range(len(heap)), key=heap.__getitem__) if heap else -1
            if best >= 0 and heap[best][0] >= kth[query]:
                at[query] = heap[best][1]
                heap[best] = heap[-1]
                heap.pop()
                moving.append(query)
        rows = np.array(moving, int)
        active = rows
        while len(rows):
            nodes = at[rows]
            inner = tree.left[nodes] >= 0
            leaf_of[rows[~inner]] = nodes[~inner]
            rows, nodes = rows[inner], nodes[inner]
            if not len(rows):
                break
            left, right = tree.left[nodes], tree.right[nodes]
            left_bound, right_bound = bounds(rows, left), bounds(rows, right)
            to_left = left_bound >= right_bound
            at[rows] = np.where(to_left, left, right)
            other, other_bound = np.where(to_left, right, left), np.where(to_left, right_bound, left_bound)
            for query, node, bound in zip(rows.tolist(), other.tolist(), other_bound.tolist(), strict=True):
                if bound >= kth[query]:
                    heaps[query].append((bound, node))
        for leaf in np.unique(leaf_of[active]):
            here = active[leaf_of[active] == leaf]
            members = tree.order[tree.start[leaf] : tree.end[leaf]]
            scores = products(queries[here], vectors[members])
            for row, query in enumerate(here.tolist()):
                good = (scores[row] >= kth[query]) & (ids[members] != query_ids[query])
                if not good.any():
                    continue
                found_ids = np.concatenate((best_ids[query], ids[members][good]))
                found = np.concatenate((best_scores[query], scores[row][good]))
                first = np.lexsort((found_ids, -found))[:k]
                best_ids[query], best_scores[query] = found_ids[first], found[first]
                if len(first) == k:
                    kth[query] = max(kth[query], float(found[first[-1]]))
    sizes = [len(found) for found in best_ids]
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, sizes),
            "vec_id": np.concatenate([np.empty(0, np.int64), *best_ids]),
            "score": np.concatenate([np.empty(0, np.int64), *best_scores]),
        }
    )


def _stack(column_: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(row, float) for row in column_]).reshape(-1, width) if len(column_) else np.zeros((0, width))


_FOUND = "query_id long, vec_id long, score long"
_BALL = "centre array<double>, radius double, reach double"
_SENT = {"width": "int32", "shard": "int64", "id": "int64", "vector": "object", "least": "float64"}


def _assign(pivots: list[list[float]]):
    """Adds the numbers of the two pivots of the same length nearest to a vector, -1 for none."""
    of_width: dict[int, list[int]] = {}
    for at, pivot in enumerate(pivots):
        of_width.setdefault(len(pivot), []).append(at)
    stacks = {width: np.array([pivots[at] for at in own]) for width, own in of_width.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            widths = batch.column("width").to_numpy()
            near = np.full((2, batch.num_rows), -1, np.int32)
            vectors = batch.column("vector")
            for width in np.unique(widths).tolist():
                own = np.array(of_width.get(width, []), np.int32)
                here = np.flatnonzero(widths == width)
                if not len(own):
                    continue
                rows = vectors.take(pa.array(here)).flatten().to_numpy().reshape(-1, width)
                # Least |x - p|^2 without the part that is the same for all pivots.
                away = (stacks[width] ** 2).sum(axis=1) - 2 * rows @ stacks[width].T
                order = np.argsort(away, axis=1, kind="stable")[:, :2]
                near[: order.shape[1], here] = own[order].T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("id", "width", "vector", "asks")), pa.array(near[0]), pa.array(near[1])],
                ["id", "width", "vector", "asks", "first", "second"],
            )

    return run


def deal(good: DataFrame, shard_rows: int, pivots: int = PIVOTS) -> DataFrame:
    """(id, width, vector, asks, shard): rows dealt to shards of about ``shard_rows`` by place in space.

    Four pivots for each ``shard_rows`` rows, ``pivots`` at most, are the vectors with the smallest digests.
    Rows with the same two nearest pivots are a cell; cells of one first pivot share shards, and a
    cell beyond ``shard_rows`` is cut by digests of its ids. There are at most (pivots + 1)^2 cells
    whatever the number of rows, so their table is broadcast.
    """
    total = good.count()
    count = min(pivots, max(1, 4 * -(-total // shard_rows)))
    drawn = good.select("vector", F.xxhash64("id", "vector").alias("digest")).orderBy("digest", "vector").limit(count)
    assign = _assign([row["vector"] for row in drawn.collect()])
    schema = "id long, width int, vector array<double>, asks boolean, first int, second int"
    placed = materialize(good.mapInArrow(assign, schema), "vectors")
    cells = placed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") <= shard_rows, F.col("n")).otherwise(0)
    of_first = W.partitionBy("first")
    before = F.sum(small).over(of_first.orderBy("second").rowsBetween(W.unboundedPreceding, -1))
    bins = F.greatest(F.lit(1), F.ceil(F.sum(small).over(of_first) / shard_rows))
    bin_ = F.floor(F.coalesce(before, F.lit(0)) * bins / F.greatest(F.lit(1), F.sum(small).over(of_first)))
    cut = F.when(F.col("n") > shard_rows, F.ceil(F.col("n") / shard_rows)).cast("long")
    base = (F.col("first") + 1).cast("long") * (1 << 40)
    own = F.when(cut.isNull(), bin_).otherwise((F.col("second") + 2).cast("long") * (1 << 28))
    cells = cells.select("first", "second", cut.alias("cut"), (base + own).cast("long").alias("base"))
    cells = materialize(cells, "cells")
    part = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("cut")), F.lit(0))
    shard = (F.col("base") + part).alias("shard")
    return placed.join(F.broadcast(cells), ["first", "second"]).select("id", "width", "vector", "asks", shard)


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return _stack(frame["vector"], len(frame["vector"].iloc[0]))


def _at_home(k: int):
    """Searches a shard for the queries that lie in it, and tells its ball in a row of its own."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, ids = _stacked(frame), frame["id"].to_numpy(np.int64)
        tree = build(vectors)
        asks = frame["asks"].to_numpy(bool)
        found = search(tree, vectors, ids, vectors[asks], ids[asks], np.full(asks.sum(), -np.inf), k)
        ball = {
            "width": frame["width"].iloc[:1].to_numpy(),
            "shard": frame["shard"].iloc[:1].to_numpy(),
            "centre": [tree.centre[0]],
            "radius": tree.radius[:1].astype(float),
            "reach": [np.abs(vectors).max() * np.sqrt(vectors.shape[1])],
        }
        told = pd.concat([found.astype("Int64"), pd.DataFrame(ball)], ignore_index=True)
        return told.astype({"width": "Int32", "shard": "Int64"}).assign(centre=[None] * len(found) + ball["centre"])

    return run


def _reached(frame: pd.DataFrame) -> pd.DataFrame:
    """The (query, shard) pairs of a block of queries and a block of balls that a score may lie in."""
    balls, queries = frame[frame["radius"].notna()], frame[frame["radius"].isna()]
    if not len(balls) or not len(queries):
        return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in _SENT.items()})
    asked = _stacked(queries)
    width = asked.shape[1]
    lengths = np.sqrt((asked**2).sum(axis=1))[:, None]
    slack = 1 + lengths * balls["reach"].to_numpy(float) * 1e-9  # rounding must not hide a candidate
    bounds = asked @ _stack(balls["centre"], width).T + lengths * balls["radius"].to_numpy(float) + slack
    home = queries["shard"].to_numpy(np.int64)[:, None] == balls["shard"].to_numpy(np.int64)
    rows, shards = np.nonzero((bounds >= queries["least"].to_numpy(float)[:, None]) & ~home)
    told = queries.iloc[rows]
    return pd.DataFrame(
        {
            "width": width,
            "shard": balls["shard"].to_numpy(np.int64)[shards],
            "id": told["id"].to_numpy(),
            "vector": told["vector"].to_numpy(),
            "least": told["least"].to_numpy(float),
        }
    ).astype(_SENT)


def reached(asked: DataFrame, balls: DataFrame, block_rows: int) -> DataFrame:
    """(width, shard, id, vector, least): each query and the other shards whose balls reach its bar.

    ``asked`` has (width, shard, id, vector, least), shard being the query's own, and ``balls``
    (width, shard, centre, radius, reach). Blocks of queries meet blocks of balls, of
    ``block_rows`` each, so no candidate moves before its shard is known to be wanted.
    """
    asking, count = asked.count(), balls.count()
    queries, shards = max(1, -(-asking // block_rows)), max(1, -(-count // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda key, n: F.pmod(F.xxhash64(key, F.lit(2)), F.lit(n)).cast("int")
    none = {name: F.lit(None).cast(kind) for name, kind in (part.split() for part in _BALL.split(", "))}
    blocks = asked.withColumns({**none, "block": own("id", queries)}).withColumn("balls", every(shards))
    nobody = {"id": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>"), "least": F.lit(None).cast("double")}
    told = balls.withColumns({**nobody, "balls": own("shard", shards)}).withColumn("block", every(queries))
    return blocks.unionByName(told).groupBy("width", "block", "balls").applyInPandas(
        _reached, "width int, shard long, id long, vector array<double>, least double"
    )


def _away(k: int):
    """Searches one shard for one block of queries: candidates are rows without ``least``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["least"].notna()
        shard, block = frame[~asks], frame[asks]
        if not len(shard) or not len(block):
            return pd.DataFrame({name: pd.Series(dtype="int64") for name in ("query_id", "vec_id", "score")})
        vectors, ids = _stacked(shard), shard["id"].to_numpy(np.int64)
        wanted = block["id"].to_numpy(np.int64)
        return search(build(vectors), vectors, ids, _stacked(block), wanted, block["least"].to_numpy(float), k)

    return run


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    shard_rows: int = 4096,
    block_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` other vectors of each that ``queries`` picks.

    Components become floor(scale * x); the score is the inner product as a whole number,
    ties go to the smaller id. A query has as many rows as there are candidates, if fewer
    than k. Only vectors of the same length are compared; an empty vector takes no part.

    Vectors without id, null ones and those with a null or non-finite component take no
    part, nor do those with a finite component beyond 1.7e308 / 256. Scaled components stop at
    9e18, so scores are not those of the formula where a component is beyond 9e18 / ``scale``
    (3.5e16 at 256). Rows with a query's id are not its candidates; other repeated rows are candidates
    of their own, as are equal vectors. A score beyond a long stops at its ends. Other
    columns are left out. An empty table gives an empty result.
    """
    ship_package(vectors.sparkSession)
    good = vectors.where(column(key).isNotNull() & usable(column(vector)) & (F.size(column(vector)) > 0)).select(
        column(key).cast("long").alias("id"),
        F.size(column(vector)).alias("width"),
        scaled(column(vector), scale).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    own = deal(good, shard_rows)
    home = own.groupBy("width", "shard").applyInPandas(_at_home(k), f"{_FOUND}, width int, shard long, {_BALL}")
    home = materialize(home, "top-k-own")
    at_home = home.where("shard IS NULL").select("query_id", "vec_id", "score")
    balls = home.where("shard IS NOT NULL").drop("query_id", "vec_id", "score")
    none = F.lit(float("-inf"))
    bound = at_home.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(none).alias("least")
    )
    asked = own.where("asks").join(bound, F.col("id") == F.col("query_id"), "left")
    asked = asked.select("width", "shard", "id", "vector", F.coalesce("least", none).alias("least"))
    sent = materialize(reached(asked, balls, block_rows), "top-k-sent")

    # A shard that many queries want is searched in blocks of them; only wanted shards move.
    wanted = sent.groupBy("width", "shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    wanted = materialize(wanted, "top-k-wanted")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    parts = ["width", "shard"]
    searching = sent.join(wanted, parts).select(*parts, block.alias("block"), "id", "vector", "least")
    searched = own.join(wanted, parts).select(
        *parts, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector", F.lit(None).cast("double").alias("least")
    )
    away = searched.unionByName(searching).groupBy("width", "shard", "block").applyInPandas(_away(k), _FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        at_home.unionByName(away)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec_id"), "score")
    )
