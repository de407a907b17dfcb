"""Mixing: apportionment, targets, taken words and texts."""

from __future__ import annotations

import random
from math import isqrt

import pytest
from pyspark.sql import functions as F

from tests.plans import plan_text
from tokentide.llm import mix


def highest_quotients(weights, seats):
    given = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_seat_by_seat(rows, seed):
    dice = random.Random(seed)
    groups = {g: [dice.choice([0, 1, 2, 3, 5, 40, 1000]) for _ in range(dice.randrange(1, 30))] for g in range(6)}
    seats = {g: dice.randrange(0, 80) if sum(w) else 0 for g, w in groups.items()}
    data = [(g, i, w, seats[g], sum(ws)) for g, ws in groups.items() for i, w in enumerate(ws)]
    frame = rows(data, "g long, i long, w long, s long, total long")
    found = {(r.g, r.i): r.quota for r in mix.apportion(frame, ["g"], "i", "w", "s", "total").collect()}
    for g, weights in groups.items():
        assert [found[g, i] for i in range(len(weights))] == highest_quotients(weights, seats[g])


def filled(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    pool, open_ = share * sum(sizes), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if pool * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = pool * weights[i] / total
            break
        for i in over:
            targets[i] = most * sizes[i]
            pool -= targets[i]
        open_ -= over
    return targets


WORDS = "alpha beta gamma delta"


@pytest.fixture
def docs(rows):
    dice = random.Random(3)
    data = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else dice.choice(["a", "b", "", None])
        text = " ".join(dice.choice(WORDS.split()) + str(i) for _ in range(dice.choice([0, 1, 5, 80])))
        data.append((i, source, text, "kept"))
    data += [data[0], data[0], (None, "a", "x y z", "kept"), (401, "b", None, "kept"), (402, "only nothing", "", "kept")]
    return rows(data, "doc_id long, source string, text string, target string")


def test_taken_words_come_near_the_targets(docs):
    found = mix.mix(docs, (5, 2, 1)).collect()
    assert len(found) == docs.count() and set(mix.ADDED) < set(mix.mix(docs, (5, 2, 1)).columns)
    sums = {}
    for row in found:
        assert 0 <= row.taken <= 2 * row.size
        sums.setdefault(row.source, [row.source_size, row.target, 0, 0])
        sums[row.source][2] += row.taken
        sums[row.source][3] += row["size"]
    names = sorted((n for n in sums if n is not None), key=lambda n: n.encode()) + [None]
    sizes = [sums[n][0] for n in names]
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    for name, target in zip(names, filled(sizes, weights, 1.5, 2), strict=True):
        assert sums[name][0] == sums[name][3] and sums[name][1] == pytest.approx(target)
        assert abs(sums[name][2] - target) <= 64


def test_reruns_agree_whatever_the_partitions(docs):
    once = sorted(map(str, mix.mix(docs, (5, 2, 1)).drop("text").collect()))
    again = sorted(map(str, mix.mix(docs.repartition(7), (5, 2, 1)).drop("text").collect()))
    assert once == again


def test_texts_hold_the_taken_words(docs):
    for row in mix.mix(docs, (5, 2, 1), block=8, texts=True).collect():
        words = [text.split() for text in row.texts]
        assert sum(map(len, words)) == row.taken and len(words) <= 2
        own = (row.text or "").split()
        for copy in words:
            assert [w for w in own if w in set(copy)] == copy or len(set(own)) < len(own)


def test_empty_table_and_plan(docs):
    assert mix.mix(docs.where("false"), (5, 2, 1)).count() == 0
    plan = plan_text(mix.mix(docs, (5, 2, 1)))
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_word_count(rows):
    texts = [None, "", " \t\n", "a", " a b  c\x0b", "é\x1cz\r\nq"]
    frame = rows([(t,) for t in texts], "t string")
    found = [r.n for r in frame.select(mix.word_count(F.col("t")).alias("n")).collect()]
    assert found == [len((t or "").encode().split()) for t in texts]


def test_rows_without_id_are_dealt_by_their_texts(rows):
    data = [(None, "a", f"w{i} " * (1 + i % 5)) for i in range(300)] + [(i, "b", "x y") for i in range(20)]
    frame = rows(data, "doc_id long, source string, text string")
    found = mix.mix(frame, (5, 2, 1), texts=True, block=2)
    once = sorted((str(r.doc_id), r.text, r.taken, tuple(r.texts)) for r in found.collect())
    again = mix.mix(frame.repartition(6), (5, 2, 1), texts=True, block=2).collect()
    assert once == sorted((str(r.doc_id), r.text, r.taken, tuple(r.texts)) for r in again)
    shards = isqrt(len(data)) + 1
    dealt = frame.where("doc_id IS NULL").groupBy((mix._number(F.md5("text")) % shards).alias("shard")).count()
    assert dealt.count() > shards / 2 and all(sum(len(t.split()) for t in texts) == taken for _, _, taken, texts in once)
