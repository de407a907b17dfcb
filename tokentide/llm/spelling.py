"""Words and their spelling variants: one code point inserted, deleted or replaced.

Words that share all but a few neighbouring code points meet in a group, and a group is
compared by dense tiles: words as rows of a padded matrix of code points, block against
block. The common prefix and the common suffix of a pair, both counted on the matrices, reach
the longer length minus one exactly where a single edit tells the words apart.

For a pair of longer length l the group is named by l, by the band of ``BAND`` places that the
common prefix ends in, and by the l - BAND code points outside of the band. So each pair meets
once, and a group is no larger than the number of spellings of a band, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tokentide.llm.frames import column, slices
from tokentide.session import materialize, ship_package

# ASCII letters, in lower case by then, and U+00C0 to U+00FF, in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
SPOILT_ONE_IN = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
BAND = 2  # places in which the words of a group may differ
TILE = 128  # words of a block
HELD_WORDS = 100_000  # words that a task counts before it hands them on


def spoilt(word: bytes, digest: int) -> bytes:
    """A run without the code point that its digest names."""
    text = word.decode()
    at = digest % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count(spoil_one_in: int, least_length: int):
    """Counts of words, a row per word and as many texts as a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            long = [(word, n) for word, n in held.items() if n and len(word) >= least_length]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([word for word, _ in long], pa.binary()).cast(pa.string()), pa.array([n for _, n in long], pa.int64())],
                ["word", "n"],
            )

        crc = zlib.crc32
        for batch in slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs = RUN.findall((text or "").encode().lower())  # bytes change A-Z only
                held.update(runs)
                begun = crc(f"{key or ''}:".encode())
                for word in runs if spoil_one_in else ():
                    digest = crc(word, begun)
                    if digest % spoil_one_in == 0:
                        held[word] -= 1
                        held[spoilt(word, digest)] += 1
                if len(held) > HELD_WORDS:
                    yield told()
        yield told()

    return run


def word_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    spoil_one_in: int = SPOILT_ONE_IN,
    least_length: int = LEAST_LENGTH,
    least: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): how often each run of letters occurs in whole texts, those rarer than ``least`` left out.

    Runs are of A-Z, a-z and U+00C0 to U+00FF; only A-Z lose their case. One in ``spoil_one_in``
    runs, chosen by the CRC-32 of key, colon and run, loses one code point before it counts; 0
    spoils none. Words have ``least_length`` code points at least, what is left of spoilt ones too.
    """
    ship_package(docs.sparkSession)
    named = docs.select(column(key).cast("string").alias("key"), column(text).cast("string").alias("text"))
    counted = named.mapInArrow(_count(spoil_one_in, least_length), "word string, n long")
    return counted.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, once from the left and once from the right, padded with 0, and lengths."""
    lengths = np.array([len(word) for word in words])
    width = int(lengths.max())
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((2, len(words), width), np.uint32)
    left[row, place] = flat
    right[row, np.repeat(lengths, lengths) - 1 - place] = flat
    return left, right, lengths


def common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of one block with every row of the other."""
    alive = np.ones((len(one), len(two)), bool)
    count = np.zeros((len(one), len(two)), np.int16)
    for place in range(one.shape[1]):
        # Padding is no code point: it ends a word even where both end.
        alive &= (one[:, place, None] == two[None, :, place]) & (one[:, place, None] != 0)
        if not alive.any():
            break
        count += alive
    return count


def single_edits(words: list[str], groups: np.ndarray, longer: np.ndarray, start: np.ndarray, band: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, both ways round, that one edit inside the group's band tells apart.

    Rows are sorted by group. Small groups share a tile; a group beyond a tile is compared
    block by block with itself.
    """
    edges = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]))
    sizes = np.diff(edges)
    blocks: list[tuple[int, int, int]] = []  # first row, end, and end of what it is compared with
    at = 0
    while at < len(sizes):
        first = edges[at]
        if sizes[at] > tile:
            blocks += [(low, min(low + tile, edges[at + 1]), edges[at + 1]) for low in range(first, edges[at + 1], tile)]
            at += 1
            continue
        while at < len(sizes) and edges[at + 1] - first <= tile:
            at += 1
        blocks.append((first, edges[at], edges[at]))
    for first, end, last in blocks:
        for low in range(first, last, tile):
            high = min(low + tile, last)
            left, right, lengths = matrices(words[first:end] + ([] if low == first else words[low:high]))
            own = end - first
            two = slice(0, own) if low == first else slice(own, None)
            rows = np.arange(first, end) if low == first else np.arange(low, high)
            before, after = common(left[:own], left[two]), common(right[:own], right[two])
            most = np.maximum(lengths[:own, None], lengths[None, two])
            here = start[first:end, None]
            near = (
                (groups[first:end, None] == groups[rows][None, :])
                & (most == longer[first:end, None])
                & (before >= here)
                & (before < here + band)
                & (before + after >= most - 1)
            )
            near &= (before < most) | (lengths[:own, None] != lengths[None, two])  # equal words are no edit
            mine, other = np.nonzero(near)
            if len(mine):
                yield mine + first, rows[other]
                if low > first:
                    yield rows[other], mine + first


def _tiles(band: int):
    """What the tiles of sorted rows (group, longer, start, word, n) tell of each word."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = rows.column("name").combine_chunks()
        codes = names.dictionary_encode().indices.to_numpy()
        paired = np.zeros(len(codes), bool)
        same = codes[1:] == codes[:-1]
        paired[1:] |= same
        paired[:-1] |= same
        kept = np.flatnonzero(paired)
        if not len(kept):
            return
        rows = rows.take(pa.array(kept))
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        pairs = single_edits(words, codes[kept], rows.column("longer").to_numpy(), rows.column("start").to_numpy(), band)
        found = list(pairs)
        if not found:
            return
        mine, other = (np.concatenate(x) for x in zip(*found, strict=True))
        # Ranks order words by their code points, as the comparison of Python's texts does.
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], mine))
        mine, other = mine[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[i] for i in mine[first]], pa.string()),
                pa.array(np.diff(np.concatenate((first, [len(mine)])))),
                pa.array(n[other[first]]),
                pa.array([words[i] for i in other[first]], pa.string()),
            ],
            ["word", "near", "best_n", "best"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group may go on in the next batch.
            names = batch.column("name")
            last = names[batch.num_rows - 1]
            cut = int(np.argmax(pc.equal(names, last).to_numpy(zero_copy_only=False)))
            if cut:
                yield from told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif held and held[-1].column("name")[held[-1].num_rows - 1] != last:
                yield from told(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def near_words(words: DataFrame, band: int = BAND) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) that is one edit from others.

    best is the near word that occurs most, of equal ones the first by code points.
    """
    ship_package(words.sparkSession)
    size = F.length("word")
    # A word of length l pairs with words up to its length, and as the shorter one up to l + 1.
    classed = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    banded = classed.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("longer") - 1, F.lit(band))))
    tail = F.greatest(F.col("longer") - F.col("start") - band, F.lit(0))
    name = F.concat_ws(
        ":", "longer", "start",
        F.concat(F.substring("word", F.lit(1), F.col("start")), F.substr("word", F.length("word") - tail + 1)),
    )
    keyed = banded.select(name.alias("name"), "longer", "start", "word", "n")
    sorted_ = keyed.repartition("name").sortWithinPartitions("name")
    told = sorted_.mapInArrow(_tiles(band), "word string, near long, best_n long, best string")
    return told.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    ).select("word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best"))


def group_variants(words: DataFrame, ratio: int = RATIO, band: int = BAND) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    form is the near word that occurs most, the first of equal ones by code points, if it
    occurs ``ratio`` times as often at least; root is the end of the way from form to form,
    the word itself if it has none. A word without near ones has n_near 0. Words that are null
    take no part; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("the ratio must be 2 at least, or forms could lead in a circle")
    words = materialize(words.where(F.col("word").isNotNull()).select("word", "n"), "words")
    best = near_words(words, band)
    common_ = F.col("best_n") >= F.col("n") * ratio
    formed = materialize(
        words.join(best, "word", "left").select(
            "word",
            F.when(common_, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common_, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    # Each step multiplies n by the ratio, so a way has few steps; each round doubles its length.
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, ceil(log(most + 1, ratio)))
    ways = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        ways = materialize(ways, "ways")
        further = ways.select(F.col("word").alias("_at"), F.col("to").alias("_to"))
        ways = ways.join(further, F.col("to") == F.col("_at"), "left").select("word", F.coalesce("_to", "to").alias("to"))
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"
    )
