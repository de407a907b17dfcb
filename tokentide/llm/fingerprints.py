"""Document fingerprints: Merkle trees over pieces, paragraphs and sections.

Paragraphs are the lines of a text. A paragraph is cut into pieces where a hash of the
last bytes says so, and paragraphs are gathered into sections the same way, so an edit
moves only the cuts beside it. A fingerprint is the root digest followed by the digests
of the tree, so equal roots mean equal texts and differing branches locate edits.

Paragraphs, sections and the root have digests; pieces, which only tell how alike two texts
are, have polynomial sums, worked out for all pieces of a text at once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokentide.llm.frames import column, range_of, slices
from tokentide.session import ship_package

# One byte position in so many ends a piece, one paragraph in so many ends a section.
PIECE, SECTION = 24, 8
# Text without such a position, as repeated marks are, is cut after so many bytes.
LONGEST = 16 * PIECE
DIGITS = 6  # hex digits of a piece's digest within a fingerprint
MARK = 16  # hex digits of a paragraph's digest within a fingerprint
_SPAN = 8  # bytes that decide about a cut
_FACTORS = np.random.default_rng(20).integers(1, 1 << 31, _SPAN, dtype=np.uint32) | np.uint32(1)
BASE = 0x9E3779B97F4A7C15
# Pieces are no longer than the longest and the rest of a letter.
_POWERS = np.array([pow(BASE, at, 1 << 64) for at in range(LONGEST + 4)], np.uint64)


def _cuts(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, piece: int) -> np.ndarray:
    """Offsets inside paragraphs at which a new piece begins, never inside a letter."""
    size = len(values)
    if size <= _SPAN:
        return np.empty(0, np.int64)
    wide = values.astype(np.uint32)
    mixed = np.zeros(size - _SPAN, np.uint32)
    for at, factor in enumerate(_FACTORS):
        mixed += wide[at : size - _SPAN + at] * factor
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    ends = np.flatnonzero(mixed < np.uint32((1 << 32) // piece)) + _SPAN
    own = np.searchsorted(starts, ends - 1, side="right") - 1
    # The bytes that decide lie in the paragraph, and something of it follows.
    ends = ends[(ends - starts[own] >= _SPAN) & (ends < stops[own])]
    ends = ends[(values[ends] & 0xC0) != 0x80]
    begins = np.sort(np.concatenate((starts, ends)))
    gaps = np.diff(np.append(begins, size))
    forced = []
    for at in np.flatnonzero(gaps > LONGEST):
        stop = stops[np.searchsorted(starts, begins[at], side="right") - 1]
        more = np.arange(begins[at] + LONGEST, min(begins[at] + gaps[at], stop), LONGEST)
        for _ in range(3):  # to the end of a letter
            more = more[more < stop]
            more = more + ((values[more] & 0xC0) == 0x80)
        forced.append(more[more < stop])
    return np.unique(np.concatenate((ends, *forced))) if forced else ends


def _pieces(data: bytes, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the paragraphs of a text, and the starts of all their pieces."""
    values = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(values == 10)
    starts, stops = np.concatenate(([0], breaks + 1)), np.append(breaks, len(data))
    return starts, stops, np.sort(np.concatenate((starts, _cuts(values, starts, stops, piece))))


def piece_ends(data: bytes, piece: int = PIECE) -> list[int]:
    """Offsets behind each piece of a paragraph, never inside a letter; the last is its length."""
    return [*_pieces(data, piece)[2][1:].tolist(), len(data)]


def piece_sums(data: bytes, begins: np.ndarray) -> np.ndarray:
    """A number below 2^24 of each piece: its bytes as a polynomial, mixed with its length."""
    size = len(data)
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    gaps = np.diff(begins, append=size)
    place = np.arange(size) - np.repeat(begins, gaps)
    line_end = values == 10
    terms = (values + np.uint64(1)) * _POWERS[np.minimum(place, len(_POWERS) - 1)]
    terms[line_end] = 0  # between paragraphs, in none
    sums = np.add.reduceat(np.append(terms, np.uint64(0)), begins)
    ended = np.append(begins[1:] - 1, size - 1)
    lengths = gaps - ((gaps > 0) & line_end[np.maximum(ended, 0)] if size else 0)
    sums ^= lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    sums ^= sums >> np.uint64(32)
    sums *= np.uint64(0xD6E8FEB86659FD93)
    return (sums >> np.uint64(40)).astype(np.uint32)


def _digest(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def tree(text: str) -> list[list[tuple[bytes, str]]]:
    """Sections of a text, each a list of paragraphs (digest, hex digits of the pieces)."""
    data = text.encode()
    starts, stops, begins = _pieces(data)
    digits = piece_sums(data, begins).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
    edges = (np.append(np.searchsorted(begins, starts), len(begins)) * DIGITS).tolist()
    sections: list[list[tuple[bytes, str]]] = [[]]
    for at, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist())):
        digest = _digest(b"paragraph", data[start:stop])
        sections[-1].append((digest, digits[edges[at] : edges[at + 1]]))
        if digest[0] % SECTION == 0:
            sections.append([])
    return sections if sections[-1] else sections[:-1]


def fingerprint(text: str) -> str:
    """Root (32 hex digits), then sections after ``|``, their paragraphs between ``/``: digest, ``:``, pieces.

    Digests of paragraphs are shortened to ``MARK`` digits within the tree, and pieces have
    ``DIGITS`` each; the root is made of the full digests, so it alone decides equality.
    """
    sections = tree(text)
    digests = [_digest(b"section", b"".join(digest for digest, _ in section)) for section in sections]
    told = ["/".join([f"{digest.hex()[:MARK]}:{pieces}" for digest, pieces in section]) for section in sections]
    return _digest(b"root", b"".join(digests)).hex() + "|" + "|".join(told)


def _paragraphs(print_: str) -> list[str]:
    return print_.split("|", 1)[1].replace("|", "/").split("/")


def _leaves(print_: str) -> np.ndarray:
    """The numbers of all pieces."""
    octets = bytes.fromhex("".join([paragraph[MARK + 1 :] for paragraph in _paragraphs(print_)]))
    parts = np.frombuffer(octets, np.uint8).reshape(-1, DIGITS // 2).astype(np.uint32)
    return parts[:, 0] << np.uint32(16) | parts[:, 1] << np.uint32(8) | parts[:, 2]


def likeness(left: str, right: str) -> float:
    """Twice the shared pieces over all pieces of both trees, repeats counted, 0 to 1; 1 only for equal roots."""
    if left[:32] == right[:32]:
        return 1.0
    ours, theirs = _leaves(left), _leaves(right)
    distinct, at = np.unique(np.concatenate((ours, theirs)), return_inverse=True)
    counts = [np.bincount(side, minlength=len(distinct)) for side in (at[: len(ours)], at[len(ours) :])]
    shared = int(np.minimum(*counts).sum())
    return min(2 * shared / (len(ours) + len(theirs)), 1 - 1e-9)


def edits(left: str, right: str) -> list[int]:
    """Indexes of the paragraphs of ``right`` that no paragraph of ``left`` equals by its digest, repeats counted."""
    known = Counter(paragraph[:MARK] for paragraph in _paragraphs(left))
    changed = []
    for at, paragraph in enumerate(_paragraphs(right)):
        if known[paragraph[:MARK]]:
            known[paragraph[:MARK]] -= 1
        else:
            changed.append(at)
    return changed


def add_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of each whole text; a null text counts as empty. No shuffle."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(fingerprint)

    kept = [name for name in docs.columns if name.lower() != "fingerprint"]
    return docs.select(*map(column, kept), of(F.coalesce(column(text), F.lit(""))).alias("fingerprint"))


def beside_next(
    docs: DataFrame,
    key: str,
    text: str,
    prepare: Callable[[str], object],
    work: Callable[[str, object, str, object], tuple],
    fields: Mapping[str, str],
) -> DataFrame:
    """(key, fields) of each row, worked out from its text and the next one's, by an integer key.

    ``prepare`` is called once per text and its result given to ``work`` beside the text;
    the row of the largest key meets the one of the smallest. ``fields`` are the names and
    Spark types (long, string, double) of what ``work`` returns.

    Rows are dealt once to ranges of the key. The bounds are values of the column, one per
    partition whatever the number of rows, and the rows at a bound also go to the range
    before it, so each range streams through its task without a look elsewhere. Rows of one
    key are in the order of their text, null keys come first, null texts are empty. An
    empty table gives an empty result.
    """
    spark = ship_package(docs.sparkSession)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(column(key).cast("long").alias("_key"), F.coalesce(column(text), F.lit("")).alias("_text"))
    cuts, lowest = rows.agg(
        F.percentile_approx("_key", [at / parts for at in range(1, parts)], 100 * parts),
        F.min(F.struct(F.col("_key").isNotNull(), F.col("_key").alias("key"))),
    ).first()
    bounds = sorted(set(cuts or []))
    part = F.coalesce(range_of(F.col("_key"), bounds), F.lit(0))
    begins = F.array_contains(F.array(*map(F.lit, bounds)).cast("array<long>"), F.col("_key"))
    place = lambda number, extra: F.array(F.struct(number.alias("part"), F.lit(extra).alias("extra")))
    nowhere = F.array().cast("array<struct<part:int,extra:int>>")
    places = F.concat(
        place(part, 0),
        F.when(begins, place(part - 1, 1)).otherwise(nowhere),
        F.when(F.col("_key").eqNullSafe(F.lit(lowest and lowest["key"])), place(F.lit(len(bounds)), 2)).otherwise(nowhere),
    )
    dealt = rows.select(F.explode(places).alias("_place"), "_key", "_text").select("_place.part", "_place.extra", "_key", "_text")
    ranges = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "extra", "_key", "_text")
    arrow = pa.schema([("key", pa.int64()), *((name, _ARROW[kind]) for name, kind in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next text
        for batch in slices(batches):
            done = []
            columns = (batch.column(name).to_pylist() for name in ("extra", "_key", "_text"))
            for extra, key_, text_ in zip(*columns, strict=True):
                made = prepare(text_) if held is not None or extra == 0 else None
                if held is not None:
                    done.append((held[0], *work(held[1], held[2], text_, made)))
                held = (key_, text_, made) if extra == 0 else None
            arrays = list(zip(*done, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(arrays, arrow, strict=True)], schema=arrow
            )

    schema = ", ".join(["key long", *(f"{name} {kind}" for name, kind in fields.items())])
    return ranges.select("extra", "_key", "_text").mapInArrow(run, schema).withColumnRenamed("key", key)


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
