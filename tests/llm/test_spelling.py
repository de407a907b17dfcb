"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tokentide.llm import spelling

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(docs, one_in=199, least_length=6, least=5):
    words = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            digest = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if one_in and digest % one_in == 0:
                at = digest % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {word: n for word, n in words.items() if len(word) >= least_length and n >= least}


def is_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(words, ratio=5):
    near = {w: sorted((v for v in words if is_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= ratio * words[w] else None for w in words}

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def crowd(seed, size):
    """Words of few letters, so that many are near each other, with counts that make long ways."""
    dice = random.Random(seed)
    words = {}
    while len(words) < size:
        word = "".join(dice.choice("abé") for _ in range(dice.randrange(6, 10)))
        words[word] = dice.choice([5, 5, 7, 30, 160, 900, 5_000])
    words |= {"chain" + "x" * n: 5 ** (n + 1) for n in range(1, 9)}
    return words


@pytest.mark.parametrize("band", [1, 2, 3, 20])
def test_equals_brute_force(rows, band):
    words = crowd(band, 400)
    frame = rows([*words.items()], "word string, n long")
    assert {tuple(r) for r in spelling.group_variants(frame, band=band).collect()} == grouped(words)


def test_other_letters_and_batches(spark, rows):
    words = crowd(9, 300) | {"日本語日本語": 5, "日本語日本": 30, "日本語日本𝄞": 6, "aaaaaa": 5, "aaaaaaa": 26, "ab": 5, "a": 30, "b": 7}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = rows([*words.items()], "word string, n long")
        assert {tuple(r) for r in spelling.group_variants(frame).collect()} == grouped(words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("tile", [1, 3, 50, 1000])
def test_tiles_give_every_pair_both_ways(tile):
    dice = random.Random(tile)
    words = ["".join(dice.choice("ab") for _ in range(dice.choice([6, 7]))) for _ in range(60)]
    words = sorted(set(words))
    groups = np.array([0] * 10 + [1] * (len(words) - 10))
    sevens = np.full(len(words), 7)
    found = []
    for mine, other in spelling.single_edits(words, groups, sevens, np.zeros(len(words), int), 7, tile):
        found += [*zip(mine.tolist(), other.tolist())]
    expected = {
        (i, j) for i, a in enumerate(words) for j, b in enumerate(words)
        if groups[i] == groups[j] and max(len(a), len(b)) == 7 and is_edit(a, b)
    }
    assert len(found) == len(set(found)) and set(found) == expected


def test_words_of_texts(rows):
    dice = random.Random(4)
    letters = ["Straße", "STRASSE", "naïveté", "Wörter", "kurz", "word", "longerword", "ÀÉÎõü"]
    docs = [(n, " ".join(dice.choices(letters, k=200)) + "1x2×y") for n in range(200)]
    docs += [(None, "Straße " * 10), (5, None), (6, ""), (7, "- 123 !"), (3, docs[3][1]), (8, "verylong" * 50_000)]
    frame = rows([(*d, "w", 3) for d in docs], "doc_id long, text string, word string, n int")
    for one_in in (199, 1, 0):
        found = {r.word: r.n for r in spelling.word_counts(frame, spoil_one_in=one_in).collect()}
        assert found == counted(docs, one_in)
    grouped_ = spelling.group_variants(spelling.word_counts(frame))
    assert {tuple(r) for r in grouped_.collect()} == grouped(counted(docs))


def test_empty_tables_and_nulls(rows):
    assert spelling.group_variants(spelling.word_counts(rows([], "doc_id long, text string"))).count() == 0
    found = spelling.group_variants(rows([(None, 9), ("lonely", 5)], "word string, n long")).collect()
    assert [tuple(r) for r in found] == [("lonely", None, "lonely", 5, 0, None)]
    with pytest.raises(ValueError):
        spelling.group_variants(rows([], "word string, n long"), ratio=1)
