"""Language identification by mixtures of languages.

A document is a mixture: each word is drawn from one language, whose letter trigrams give
the word's likelihood. Expectation-maximisation estimates the proportions, and of the
nested sets of the likeliest languages the one with the best likelihood, less half the
logarithm of the number of words per free proportion, is selected.

Trigram counts of all labelled documents are summed by Spark; the model has languages
times buckets entries, whatever the corpus, and reaches the workers in one broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tokentide.llm.frames import carried, column, slices
from tokentide.session import ship_package

BUCKETS = 1 << 16
UNDETERMINED = "und"
# Share of a language's mass spread evenly over all buckets, the same for every language.
FLOOR = 0.01
FULL_STEPS, STEPS = 10, 6
# Labels that a model may have: 64 MB of likelihoods in a worker.
MOST_LANGUAGES = 256
# Words of a slice that are inferred at once, which bounds memory for long texts.
SLICE_CHARS = 1 << 19


@cache
def _kinds() -> np.ndarray:
    """For each code point 1 for a letter, 2 for a mark, else 0."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(code))[0], 0) for code in range(0x110000)], np.uint8)


@dataclass
class Grams:
    """Trigram buckets of a slice of texts, the first trigram of each word, words and letters per text."""

    buckets: np.ndarray
    word_starts: np.ndarray
    words: np.ndarray
    letters: np.ndarray


def grams(texts: list[str]) -> Grams:
    """Trigrams of the words (runs of letters and marks) of whole texts in lower case."""
    lowered = [text.lower() for text in texts]
    lengths = np.array([len(text) + 1 for text in lowered])
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    inside = kind > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    kept[0] = True
    letters = np.where(inside, codes, 0)[kept]
    centre = np.flatnonzero(letters)
    mixed = letters[centre - 1] * np.uint32(0x9E3779B1) + letters[centre] * np.uint32(0x85EBCA77)
    mixed += letters[centre + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    starts = letters[centre - 1] == 0
    # Text of each kept position, from where texts begin in the joined string.
    begins = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.searchsorted(begins[1:], np.flatnonzero(inside), side="left")
    owner = np.minimum(owner, len(texts) - 1)
    return Grams(
        ((mixed >> np.uint32(8)) % np.uint32(BUCKETS)).astype(np.int64),
        np.flatnonzero(starts),
        np.bincount(owner[starts], minlength=len(texts)),
        np.bincount(owner, weights=kind[inside] == 1, minlength=len(texts)).astype(np.int64),
    )


def _text_slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``SLICE_CHARS`` letters, or one long text."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Model:
    """Learned languages in order, and the log likelihood of each bucket under each."""

    languages: list[str]
    logs: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> Model:
    """Trigram likelihoods from every row with a text and a label; other columns are not read.

    Rows without a text or a label teach nothing, and a label whose texts have no letter is
    not learned. Repeated rows count each time; an empty table gives a model without
    languages. A model has ``BUCKETS`` entries a language, and it is the one thing that
    passes through the driver: more than ``most`` labels are refused, as labels so many are
    no languages.
    """
    spark = ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            texts, labels = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for start, end in _text_slices(texts):
                found = grams(texts[start:end])
                bounds = np.append(found.word_starts, len(found.buckets))
                ends = bounds[np.cumsum(found.words)]
                begins = np.concatenate(([0], ends[:-1]))
                for label, a, b in zip(labels[start:end], begins, ends, strict=True):
                    own = counts.setdefault(label, np.zeros(BUCKETS, np.int64))
                    np.add.at(own, found.buckets[a:b], 1)
        for label, own in counts.items():
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(own[held])],
                ["lang", "bucket", "n"],
            )

    labelled = docs.where(column(text).isNotNull() & column(lang).isNotNull()).select(
        column(text).alias("text"), column(lang).cast("string").alias("lang")
    )
    if labelled.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels in {lang}")
    counted = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names, buckets, numbers = (table.column(name).to_numpy() for name in ("lang", "bucket", "n"))
    languages = sorted(set(names.tolist()))
    counts = np.zeros((BUCKETS, len(languages)))
    place = {name: at for at, name in enumerate(languages)}
    counts[buckets, [place[name] for name in names.tolist()]] = numbers
    shares = counts / np.maximum(counts.sum(axis=0), 1)
    return Model(languages, np.log((1 - FLOOR) * shares + FLOOR / BUCKETS).astype(np.float32))


def _infer(likely: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
    """Proportions after ``steps`` rounds; a proportion of zero stays zero."""
    for _ in range(steps):
        weighed = likely * np.repeat(share, counts, axis=0)
        weighed /= np.maximum(weighed.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(weighed, starts, axis=0) / counts[:, None]
    return share


def _likelihood(likely: np.ndarray, top: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log likelihood of each text's words under its proportions."""
    inside = np.maximum((likely * np.repeat(share, counts, axis=0)).sum(axis=1), 1e-30)
    return np.add.reduceat(np.log(inside) + top, starts)


def mixtures(model: Model, texts: list[str]) -> np.ndarray:
    """Proportions of the selected languages, one row per text; zeros for a text without letters.

    Where the likeliest language leaves the others a word or less of the whole mixture, sets
    of several languages are not tried: the penalty of one is about what a word can gain.
    """
    shares = np.zeros((len(texts), len(model.languages)), np.float32)
    if not model.languages:
        return shares
    found = grams(texts)
    held = np.flatnonzero((found.words > 0) & (found.letters > 0))
    if not len(held):
        return shares
    words = np.add.reduceat(model.logs[found.buckets], found.word_starts, axis=0)
    if len(held) < len(texts):
        words = words[np.repeat(np.isin(np.arange(len(texts)), held), found.words)]
    counts = found.words[held]
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    top = words.max(axis=1)
    likely = np.exp(words - top[:, None])
    n = len(model.languages)
    full = _infer(likely, starts, counts, np.full((len(held), n), 1 / n, np.float32), FULL_STEPS)
    single = np.add.reduceat(words, starts, axis=0)
    chosen = np.zeros_like(full)
    chosen[np.arange(len(held)), single.argmax(axis=1)] = 1
    best = single.max(axis=1)
    # A second language needs about one word at least; without it the single one stands.
    open_ = np.flatnonzero((1 - full.max(axis=1)) * counts > 1)
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, n + 1):
        if not len(open_):
            break
        rows = np.repeat(np.isin(np.arange(len(held)), open_), counts)
        some, some_counts = likely[rows], counts[open_]
        some_starts = np.concatenate(([0], np.cumsum(some_counts)[:-1]))
        share = np.zeros((len(open_), n), np.float32)
        at = np.arange(len(open_))[:, None]
        share[at, order[open_, :size]] = full[open_[:, None], order[open_, :size]] + 1e-6
        share /= share.sum(axis=1, keepdims=True)
        share = _infer(some, some_starts, some_counts, share, STEPS)
        score = _likelihood(some, top[rows], some_starts, some_counts, share) - (size - 1) / 2 * np.log(some_counts)
        better = score > best[open_]
        best[open_[better]] = score[better]
        chosen[open_[better]] = share[better]
        open_ = open_[better]
    shares[held] = chosen
    return shares


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and languages, from the text alone.

    languages holds (lang, share) of each selected language, largest first; lang_pred is
    the first of them and score its share. Ties go to the earlier name. A null text, or
    one without letters, is ``und`` with score 0, and so is every text if nothing was
    learned. Repeated rows each get a row; an empty table gives an empty result; input
    columns named like added ones are replaced. Mixtures are tried only where they explain
    more than one word, as told in ``mixtures``. No shuffle.
    """
    spark = ship_package(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.languages, model.logs))
    added = ["lang_pred", "score", "languages"]
    away, back = carried(docs, added)
    rows = docs.select(*away, F.coalesce(column(text), F.lit("")).alias("_text"))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shared.value)
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            parts = [mixtures(learned, texts[a:b]) for a, b in _text_slices(texts)]
            told = []
            for row in np.concatenate(parts):
                order = [at for at in np.argsort(-row, kind="stable").tolist() if row[at] > 0]
                told.append([{"lang": learned.languages[at], "share": float(row[at])} for at in order])
            arrays = [
                *batch.columns[:-1],
                pa.array([row[0]["lang"] if row else UNDETERMINED for row in told], pa.string()),
                pa.array([min(row[0]["share"], 1.0) if row else 0.0 for row in told], pa.float64()),
                pa.array(told, kind),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *added])

    languages = T.ArrayType(T.StructType().add("lang", "string").add("share", "double"))
    made = T.StructType().add("lang_pred", "string").add("score", "double").add("languages", languages)
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made.fields]))
    return found.select(*back, *added)
