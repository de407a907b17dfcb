"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tokentide.llm import lexical
from tests.plans import plan_text

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms_of(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=20):
    bags = [(key, Counter(terms_of(text)), len(terms_of(text))) for key, text in docs]
    count, words = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(term for _, bag, _ in bags for term in bag)
    found = []
    for item, text in items:
        scored = []
        for key, bag, n in bags:
            if not n:
                continue
            m = 75 + (25 * n * count) // words
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in terms_of(text) if t in bag
            )
            if score > 0:
                scored.append((-score, -1 if key is None else key, key))
        found += [(item, rank, key, -low) for rank, (low, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def corpus(seed, size, words=120):
    """Texts of very different lengths, a third of them copies of one."""
    dice = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(words)] + ["Élan", "été", "日本", "x2"]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    texts = [" ".join(dice.choices(vocabulary, weights, k=dice.choice([1, 5, 30, 200]))) for _ in range(size)]
    texts[: size // 3] = [texts[0]] * (size // 3)
    return texts, [" ".join(dice.choices(vocabulary, k=dice.choice([1, 4, 40]))).upper() for _ in range(25)]


@pytest.mark.parametrize("cell_entries, first_share", [(1 << 18, 1 / 16), (40, 1 / 16), (200, 0.5), (40, 1.0)])
def test_equals_brute_force(rows, cell_entries, first_share):
    texts, asked = corpus(cell_entries, 400)
    docs = [*enumerate(texts), (900, None), (901, ""), (902, " -- "), (None, texts[7]), (5, texts[9]), (5, texts[9])]
    items = [*enumerate(asked), (70, None), (71, "unheard"), (72, asked[0] * 3)]
    frame = rows([(key, text, "x", 0) for key, text in docs], "doc_id long, text string, row string, cell int")
    found = lexical.search(
        frame, rows(items, "item_id long, text string"), cell_entries=cell_entries, first_share=first_share
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(docs, items)


def test_empty_tables(rows):
    docs, items = rows([], "doc_id long, text string"), rows([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(rows([(1, None)], "doc_id long, text string"), items).count() == 0
    assert lexical.search(rows([(1, "a")], "doc_id long, text string"), rows([], "item_id long, text string")).count() == 0


def test_very_long_texts(rows):
    docs = [(1, "long " * 300_000 + "rare"), (2, "rare word"), (3, "z" * 1_000_000)]
    items = [(1, "rare long " * 20_000), (2, "Z" * 1_000_000)]
    found = lexical.search(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(docs, items)


def test_sieve_lets_query_terms_through(rows):
    import zlib

    terms = [f"t{n}" for n in range(5000)] + ["é", "日本"]
    sieve = lexical._sieve(rows([(t,) for t in terms], "term string"))
    bits = np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little")
    marks = {zlib.crc32(t.encode()) % lexical.SIEVE_BITS for t in terms}
    assert len(sieve) == lexical.SIEVE_BITS // 8 and set(np.flatnonzero(bits)) == marks


def test_a_cell_prunes_and_stays_exact():
    chance = np.random.default_rng(3)
    sizes = chance.integers(1, 30, 500)
    terms = np.concatenate([np.sort(chance.choice(200, size, replace=False)) for size in sizes])
    impacts = chance.integers(1, 1000, len(terms)) * (1 + (terms < 5) * 50)
    dense = np.zeros((500, 200), np.int64)
    dense[np.repeat(np.arange(500), sizes), terms] = impacts
    lengths = np.sqrt((dense.astype(float) ** 2).sum(axis=1))
    cell = lexical.Cell.of(np.arange(500), lengths, sizes, terms, impacts)
    for _ in range(50):
        asked = np.sort(chance.choice(260, chance.integers(1, 40), replace=False))
        counts = chance.integers(1, 4, len(asked))
        query = np.zeros(260, np.int64)
        query[asked] = counts
        scores = dense @ query[:200]
        order = np.lexsort((np.arange(500), -scores))
        bar = int(scores[order[3]])
        rows, found = cell.search(asked, counts, max(1, bar), 10)
        expected = [(int(i), int(scores[i])) for i in order[:10] if scores[i] >= max(1, bar)]
        assert sorted(zip(rows.tolist(), found.tolist()), key=lambda x: (-x[1], x[0])) == expected
        assert len(cell.search(asked, counts, int(scores.max()) + 1, 10)[0]) == 0


def test_documents_are_dealt_once(spark, rows):
    """Queries travel to cells; no cross join, and no document row is repeated."""
    texts, asked = corpus(2, 100)
    plan = plan_text(lexical.search(rows(list(enumerate(texts)), "doc_id long, text string"), rows(list(enumerate(asked)), "item_id long, text string"), cell_entries=100))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
