"""Ranked lexical search over impact vectors in buckets of like length.

A document is a vector of whole-number impacts over the terms that any query holds, a query
a vector of term counts, and a score their inner product. Documents lie in buckets by the
length of their vectors, split into cells of bounded size. The longest buckets are searched
first; the k-th score found there is each query's bar in the others. Length times length
below the bar drops whole buckets for a query (Cauchy-Schwarz). Inside a cell the largest
impact of each coordinate tells which of the query's terms a good document must hold one of,
and what the remaining ones can add; what may still reach the bar is scored again in integers.

Queries are sent to cells, never documents to queries, and a task holds one cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.llm.frames import column, slices
from tokentide.session import materialize, ship_package

# Terms in UTF-8: ASCII letters (in lower case by then) and digits, and all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SIEVE_BITS = 1 << 23  # one megabyte, whatever the number of query terms
SEEN = 1 << 20  # terms whose answer a task remembers
CELL_ENTRIES = 1 << 18  # impacts of one cell, about
STEPS = 4  # buckets per doubling of the length
FIRST_SHARE = 1 / 16  # of the documents that are searched first
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _bags(sieve: bytes | None, ids: list[str]):
    """Counts the terms of texts; with a sieve only those that may be in a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little")
        asked: dict[bytes, bool] = {}
        for batch in slices(batches):
            n, sizes, terms, counts = [], [0], [], []
            for text in batch.column("_text").to_pylist():
                runs = TERM.findall((text or "").encode().lower())  # bytes change A-Z only
                n.append(len(runs))
                for term, count in Counter(runs).items():
                    if bits is not None:
                        wanted = asked.get(term)
                        if wanted is None:
                            if len(asked) >= SEEN:
                                asked.clear()
                            wanted = asked[term] = bool(bits[zlib.crc32(term) % SIEVE_BITS])
                        if not wanted:
                            continue
                    terms.append(term)
                    counts.append(count)
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in ids],
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                [*ids, "n", "terms", "counts"],
            )

    return run


def bags(rows: DataFrame, key: str, text: str, sieve: bytes | None = None) -> DataFrame:
    """(key, row, n, terms, counts): the terms of each text, with n all of them and repeats."""
    named = rows.select(column(key).cast("long").alias("key"), column(text).cast("string").alias("_text"))
    counted = named.mapInArrow(_bags(sieve, ["key"]), "key long, n long, terms array<string>, counts array<long>")
    return counted.withColumn("row", F.monotonically_increasing_id())


def _sieve(terms: DataFrame) -> bytes:
    """One bit for each remainder of the digests of terms: of a fixed size for any number of terms."""
    bit = F.crc32("term") % SIEVE_BITS + 1  # the built-in bitmaps number from 1, 32768 bits each
    parts = (
        terms.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    whole = bytearray(SIEVE_BITS // 8)
    for part in parts:
        whole[(part.bucket - 1) * 4096 : part.bucket * 4096] = part.bits
    return bytes(whole)


@dataclass
class Cell:
    """The vectors of a cell by row and by term."""

    keys: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    local: np.ndarray
    impacts: np.ndarray
    vocabulary: np.ndarray
    list_starts: np.ndarray
    list_rows: np.ndarray
    list_impacts: np.ndarray
    largest: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> Cell:
        vocabulary, local = np.unique(terms, return_inverse=True)
        order = np.argsort(local, kind="stable")
        counts = np.bincount(local, minlength=len(vocabulary))
        list_starts = np.concatenate(([0], np.cumsum(counts)))
        listed = impacts[order]
        largest = np.maximum.reduceat(listed, list_starts[:-1]) if len(listed) else listed
        starts = np.concatenate(([0], np.cumsum(sizes)))
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        return cls(keys, lengths, starts, local, impacts, vocabulary, list_starts, rows, listed, largest)

    def scores(self, rows: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows with a query."""
        weights = np.zeros(len(self.vocabulary), np.int64)
        weights[at] = counts
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        entries = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.local[entries]] * self.impacts[entries], ends - sizes)

    def search(self, terms: np.ndarray, counts: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best ``k`` with a score of at least ``least``, more if they are equal to the last."""
        at = np.searchsorted(self.vocabulary, terms)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == terms[known]
        at, counts = at[known], counts[known]
        none = np.empty(0, np.int64)
        if not len(at):
            return none, none
        most = counts * self.largest[at].astype(float)
        order = np.argsort(-most, kind="stable")
        at, counts, most = at[order], counts[order], most[order]
        # What the terms from each on can add: coordinate by coordinate, or length times length.
        by_coordinate = np.cumsum(most[::-1])[::-1]
        query_length = np.sqrt(np.cumsum((counts[::-1].astype(float)) ** 2)[::-1])
        rest = np.minimum(by_coordinate, query_length * self.lengths.max()) * (1 + 1e-9)
        focus = int(np.searchsorted(-rest, -float(least), side="right"))  # rest[focus:] cannot reach the bar alone
        if not focus:
            return none, none
        pieces = [slice(self.list_starts[term], self.list_starts[term + 1]) for term in at[:focus]]
        rows = np.concatenate([self.list_rows[piece] for piece in pieces])
        gains = np.concatenate([self.list_impacts[piece] * count for piece, count in zip(pieces, counts[:focus])])
        seen = np.bincount(rows, weights=gains.astype(float), minlength=len(self.keys))
        held = np.flatnonzero(seen)
        if len(held) > k:
            low = np.partition(seen[held], len(held) - k)[len(held) - k]
            least = max(least, int(low * (1 - 1e-9)))
        bound = seen[held]
        if focus < len(at):
            bound = bound + np.minimum(by_coordinate[focus], query_length[focus] * self.lengths[held])
        able = held[bound * (1 + 1e-9) + 1 >= least]
        if not len(able):
            return none, none
        scores = self.scores(able, at, counts)
        good = scores >= least
        able, scores = able[good], scores[good]
        if len(able) > k:
            first = np.lexsort((self.keys[able], -scores))[:k]
            able, scores = able[first], scores[first]
        return able, scores


def _search(k: int):
    """Searches of sorted rows: the documents of a cell come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, cell = None, [], None

        def whole() -> Cell:
            joined = [np.concatenate([part[i] for part in parts]) for i in range(5)]
            return Cell.of(*joined)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
            found: list[tuple] = []
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(start, end - start)
                if cells[start] != at:
                    at, parts, cell = cells[start], [], None
                terms, numbers = part.column("terms"), part.column("numbers")
                sizes = np.diff(terms.offsets.to_numpy())
                flat, values = terms.flatten().to_numpy(), numbers.flatten().to_numpy()
                keys = part.column("key").fill_null(LEAST).to_numpy()
                if not asks[start]:
                    lengths = part.column("length").to_numpy()
                    parts.append((keys, lengths, sizes, flat, values))
                    continue
                if cell is None:
                    if not parts:
                        continue
                    cell, parts = whole(), []
                edge = np.concatenate(([0], np.cumsum(sizes)))
                least = part.column("least").to_numpy()
                for i, item in enumerate(part.column("row").to_pylist()):
                    own = slice(edge[i], edge[i + 1])
                    rows, scores = cell.search(flat[own], values[own], max(1, int(least[i])), k)
                    if len(rows):
                        found.append((np.full(len(rows), item), cell.keys[rows], scores))
            if found:
                items, keys, scores = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items), pa.array(keys, mask=keys == LEAST), pa.array(scores)], ["item", "key", "score"]
                )

    return run


def _length(numbers: str) -> Column:
    return F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x))


def _bucket(length: Column) -> Column:
    return F.floor(F.log2(length) * STEPS).cast("int")


def term_weights(bagged: DataFrame, asked: DataFrame, documents: int) -> DataFrame:
    """(term, at, weight) of the query terms that documents hold, ``at`` numbering them."""
    held = bagged.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    share = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(F.log(share) * 1000).cast("long")
    return held.join(asked, "term", "left_semi").select(
        "term", F.monotonically_increasing_id().alias("at"), weight.alias("weight")
    )


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "item_id",
    query_text: str = "text",
    cell_entries: int = CELL_ENTRIES,
    first_share: float = FIRST_SHARE,
) -> DataFrame:
    """(query_key, rank, key, score): the ``k`` best documents of each query, ties to smaller keys.

    Terms are runs of ASCII letters and digits and of anything that is not ASCII; only A-Z
    lose their case. With N documents that hold a term, L all their terms and n one
    document's, a term that df documents hold weighs floor(1000 ln((2N + 2) / (2df + 1))). A
    document's m is 75 + (25 n N) div L, and a term that occurs tf times adds its weight times
    (10^9 tf) div (1000 tf + 12 m) for every time the query holds it. Only scores above 0 count.

    Null and empty texts hold no term: such documents are not found and such queries find
    nothing. Rows that repeat a key are documents, or queries, of their own; equal texts get
    equal scores and follow each other by key, null keys first. Empty tables give an empty
    result. Other columns of either table take no part, whatever their names.
    """
    spark = ship_package(docs.sparkSession)
    items = materialize(bags(queries, query_key, query_text), "queries")
    asked = materialize(items.select(F.explode("terms").alias("term")).distinct(), "query-terms")
    bagged = materialize(bags(docs, key, text, _sieve(asked)), "bags")
    total, terms = bagged.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    schema = f"`{query_key}` long, rank int, `{key}` long, score long"
    if not terms:
        return spark.createDataFrame([], schema)
    weights = materialize(term_weights(bagged, asked, total), "weights")
    m = F.expr(f"75 + CAST(CAST(25 * n AS DECIMAL(20, 0)) * CAST({total} AS DECIMAL(18, 0)) div {terms} AS BIGINT)")
    entries = (
        bagged.withColumn("m", m)
        .select("row", "key", "m", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        .select("row", "key", "m", F.col("e.terms").alias("term"), F.col("e.counts").alias("tf"))
        .join(weights, "term")
        .select("row", "key", "at", F.expr("weight * ((1000000000 * tf) div (1000 * tf + 12 * m))").alias("impact"))
        .where("impact > 0")
    )
    vectors = materialize(
        entries.groupBy("row", "key")
        .agg(F.collect_list(F.struct("at", "impact")).alias("v"))
        .select("row", "key", F.col("v.at").alias("terms"), F.col("v.impact").alias("numbers"))
        .withColumn("length", _length("numbers"))
        .withColumn("bucket", _bucket(F.col("length"))),
        "vectors",
    )
    # One row per bucket: lengths are doubles, so there are some hundreds at most.
    sizes = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("entries")).collect()
    sizes.sort(key=lambda size: -size.bucket)
    if not sizes:
        return spark.createDataFrame([], schema)
    first, covered = sizes[0].bucket, 0
    for size in sizes:
        if covered and covered + size.rows > sum(s.rows for s in sizes) * first_share:
            break
        first, covered = size.bucket, covered + size.rows
    cells = {size.bucket: max(1, -(-size.entries // cell_entries)) for size in sizes}
    pieces = F.create_map(*[F.lit(x) for pair in cells.items() for x in pair])
    cell = lambda bucket, piece: F.shiftleft(bucket.cast("long"), 40) + piece
    placed = vectors.withColumn(
        "cell", cell(F.col("bucket"), F.pmod(F.xxhash64("row"), F.element_at(pieces, F.col("bucket"))))
    ).select("cell", "bucket", F.lit(False).alias("asks"), "row", "key", "terms", "numbers", "length", F.lit(0).cast("long").alias("least"))
    vectored = items.select("row", "key", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(
        "row", "key", F.col("e.terms").alias("term"), F.col("e.counts").alias("tf")
    )
    wanted = materialize(
        vectored.join(weights, "term")
        .groupBy("row", "key")
        .agg(F.collect_list(F.struct("at", "tf")).alias("v"))
        .select("row", "key", F.col("v.at").alias("terms"), F.col("v.tf").alias("numbers"))
        .withColumn("length", _length("numbers")),
        "query-vectors",
    )
    low = min(cells)

    def found(documents: DataFrame, asking: DataFrame, highest: int) -> DataFrame:
        """Searches of the buckets up to ``highest`` that a query's bar lets it reach."""
        # A bucket's vectors are shorter than its upper edge; one bucket of slack for rounding.
        reach = F.floor(F.log2(F.col("least") / F.col("length")) * STEPS).cast("int") - 1
        buckets = F.sequence(F.greatest(reach, F.lit(low)), F.lit(highest))
        sent = asking.where(reach <= highest).withColumn("bucket", F.explode(buckets))
        sent = sent.withColumn("pieces", F.element_at(pieces, F.col("bucket"))).where("pieces IS NOT NULL")
        sent = sent.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)))
        questions = sent.select(
            cell(F.col("bucket"), F.col("piece")).alias("cell"), F.lit(True).alias("asks"), "row", "key", "terms", "numbers", "length", "least"
        )
        both = documents.drop("bucket").unionByName(questions)
        ordered = both.repartition("cell").sortWithinPartitions("cell", "asks")
        return ordered.mapInArrow(_search(k), "item long, key long, score long")

    none = wanted.withColumn("least", F.lit(1).cast("long"))
    begun = materialize(found(placed.where(F.col("bucket") >= first), none, sizes[0].bucket).where(F.col("score") > 0), "first-found")
    best = W.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_first())
    kept = begun.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    everything = kept.drop("rank")
    if first > low:
        bar = kept.groupBy(F.col("item").alias("row")).agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(1)).alias("bar")
        )
        asking = wanted.join(bar, "row", "left").withColumn("least", F.coalesce("bar", F.lit(1)).cast("long")).drop("bar")
        everything = everything.unionByName(found(placed.where(F.col("bucket") < first), asking, first - 1))
    ranked = everything.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = items.select(F.col("row").alias("item"), F.col("key").alias("query"))
    return ranked.join(named, "item").select(
        F.col("query").alias(query_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"
    )
