"""Fingerprints: equality, likeness, edits, the next document."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokentide.llm import fingerprints as prints
from tokentide.llm.queries import op10_fingerprints

FIELDS = {"text": "string", "next": "string"}


def test_next_text_equals_sorting(spark, rows):
    dice = random.Random(1)
    data = [(dice.randrange(-500, 500), f"text {i}") for i in range(300)] + [(None, "none"), (None, None), (77, "a"), (77, "b")]
    frame = rows([(*d, 1) for d in data], "doc_id long, text string, next int")
    for parts in ("3", "50"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            made = prints.beside_next(frame, "doc_id", "text", len, lambda a, n, b, m: (f"{a}{n}", f"{b}{m}"), FIELDS)
            found = sorted((str(r.doc_id), r.text, r.next) for r in made.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        ordered = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
        texts = [f"{t or ''}{len(t or '')}" for _, t in ordered]
        assert found == sorted((str(k), t, n) for (k, _), t, n in zip(ordered, texts, texts[1:] + texts[:1], strict=True))


def test_one_row_and_none(rows):
    work = lambda a, _, b, __: (a, b)
    schema = "doc_id long, text string"
    [row] = prints.beside_next(rows([(5, "x")], schema), "doc_id", "text", len, work, FIELDS).collect()
    assert tuple(row) == (5, "x", "x")
    assert prints.beside_next(rows([], schema), "doc_id", "text", len, work, FIELDS).count() == 0


def text_of(seed, paragraphs=40):
    dice = random.Random(seed)
    line = lambda: " ".join("".join(dice.choices("abcdefghij", k=dice.randrange(2, 9))) for _ in range(12))
    return "\n".join(line() for _ in range(paragraphs))


def test_equal_texts_only(rows):
    texts = ["", "\n", " ", "a", "a\n", "é", text_of(1), text_of(1) + "x", "x" * 100_000, "y" * 100_000]
    made = [prints.fingerprint(t) for t in texts]
    assert len(set(made)) == len(texts) and made == [prints.fingerprint(t) for t in texts]
    frame = prints.add_fingerprint(rows([(1, None, "old"), (2, "", "old"), (3, "a", "old")], "i long, text string, Fingerprint string"))
    assert frame.columns == ["i", "text", "fingerprint"]
    found = {r.i: r.fingerprint for r in frame.collect()}
    assert found[1] == found[2] == made[0] and found[3] == made[3]
    assert prints.add_fingerprint(frame.where(F.lit(False))).count() == 0


def test_likeness_follows_the_shared_part():
    text, other = text_of(1), text_of(2)
    own = prints.fingerprint(text)
    assert prints.likeness(own, own) == 1.0
    assert prints.likeness(own, prints.fingerprint(other)) < 0.05
    for share in (0.25, 0.5, 0.9):
        cut = int(len(text) * share)
        edited = prints.fingerprint(text[:cut] + other[: len(text) - cut])
        assert abs(prints.likeness(own, edited) - share) < 0.08
        assert prints.likeness(own, edited) == prints.likeness(edited, own) < 1
    assert prints.likeness(own, prints.fingerprint("")) == 0.0
    # An insertion in front moves no cut behind it.
    assert prints.likeness(own, prints.fingerprint("new words\n" + text)) > 0.95


def test_edits_locate_paragraphs():
    lines = text_of(3).split("\n")
    changed = [*lines[:7], "inserted line", *lines[7:20], lines[20] + " more", *lines[21:]]
    assert prints.edits(prints.fingerprint("\n".join(lines)), prints.fingerprint("\n".join(changed))) == [7, 21]


def test_pieces_cover_paragraphs_without_cutting_letters():
    for text in (text_of(4).replace("\n", " "), "é" * 5000, "中文" * 3000, "z" * 5000, "a" + "中" * 2000, "", "short"):
        data = text.encode()
        ends = prints.piece_ends(data)
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        starts = [0, *ends[:-1]]
        assert "".join(data[a:b].decode() for a, b in zip(starts, ends, strict=True)) == text
        assert max((b - a for a, b in zip(starts, ends, strict=True)), default=0) <= prints.LONGEST + 3


def plain_pieces(data):
    """The pieces of a paragraph, byte by byte."""
    ends = []
    factors = [int(f) for f in prints._FACTORS]
    for end in range(8, len(data)):
        mixed = sum(data[end - 8 + at] * factors[at] for at in range(8)) % 2**32
        mixed = (mixed ^ mixed >> 15) * 2246822519 % 2**32
        if mixed < 2**32 // prints.PIECE and data[end] & 0xC0 != 0x80:
            ends.append(end)
    forced = []
    for start, stop in zip([0, *ends], [*ends, len(data)]):
        for at in range(start + prints.LONGEST, stop, prints.LONGEST):
            while at < stop and data[at] & 0xC0 == 0x80:
                at += 1
            forced += [at] * (at < stop)
    edges = [0, *sorted({*ends, *forced}), len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def plain_sum(piece):
    value = sum((byte + 1) * pow(prints.BASE, at, 2**64) for at, byte in enumerate(piece)) % 2**64
    value ^= len(piece) * 0xD6E8FEB86659FD93 % 2**64
    value ^= value >> 32
    return f"{value * 0xD6E8FEB86659FD93 % 2**64 >> 40:06x}"


def plain_print(text):
    digest = lambda kind, data: hashlib.blake2b(data, digest_size=16, person=kind).digest()
    sections, leaves = [[]], []
    for paragraph in text.encode().split(b"\n"):
        own = [plain_sum(piece) for piece in plain_pieces(paragraph)]
        leaves += own
        mark = digest(b"paragraph", paragraph)
        sections[-1].append((mark, mark.hex()[:16] + ":" + "".join(own)))
        if mark[0] % prints.SECTION == 0:
            sections.append([])
    sections = sections if sections[-1] else sections[:-1]
    root = digest(b"root", b"".join(digest(b"section", b"".join(m for m, _ in section)) for section in sections)).hex()
    return root + "|" + "|".join("/".join(told for _, told in section) for section in sections), Counter(leaves)


def plain_likeness(left, right):
    if left[0][:32] == right[0][:32]:
        return 1.0
    return min(2 * (left[1] & right[1]).total() / (left[1].total() + right[1].total()), 1 - 1e-9)


def test_fingerprints_equal_a_plain_tree():
    texts = ["", "\n", "\n\n", "a\n", "\nab", "é" * 2000, "z" * 3000 + "\n" + "中文" * 900, "a" + "中" * 2000, "é" + "𝄞" * 999, "a" * 384 + "\n" + "b" * 385, "x" * 8, "x" * 9, text_of(5, 9)]
    texts += ["".join(random.Random(n).choices("ab\né𝄞 ", k=400)) for n in range(20)]
    for text in texts:
        assert prints.fingerprint(text) == plain_print(text)[0]


def test_query_equals_brute_force(spark):
    """All columns of the query over a whole table."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text or "" for r in docs]
    made = [plain_print(text) for text in texts]
    found = {r.doc_id: r for r in op10_fingerprints(spark, folder).collect()}
    assert len(found) == len(docs)
    for at, row in enumerate(docs):
        text, following = texts[at], texts[(at + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other, told = plain_print(edited), found[row.doc_id]
        assert told.n_chars == len(text) and told.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert told.fingerprint == made[at][0] and told.edited_fingerprint == other[0]
        assert told.near_edited == pytest.approx(plain_likeness(made[at], other))
        assert told.near_next == pytest.approx(plain_likeness(made[at], made[(at + 1) % len(texts)]))
