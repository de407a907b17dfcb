"""The pipeline stage by stage against brute force, and its edge cases."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import pytest

from tests.llm.test_near_dedup import brute_force
from tokentide.llm import components, near_dedup
from tokentide.llm.bpe import WordBpe
from tokentide.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def documents(spark):
    dice = random.Random(6)
    english, german = "the cat sat on that mat with this hat".split(), "der hund und die katze sind nicht hier".split()
    data = []
    for i in range(120):
        words, lang = (english, "en") if i % 2 else (german, "de")
        text = " ".join(dice.choice(words) + " x" * dice.randrange(2) for _ in range(dice.randrange(1, 120)))
        data.append((i, text, lang if i % 5 else None, dice.choice(["s1", "s2", "s3", None]), len(text), "kept"))
    copies = [(200 + i, *data[i][1:]) for i in range(20)]
    junk = [(300, None, "en", "s1", None, "kept"), (301, "", None, "s1", 0, "kept"), (302, "12 !!", "de", "s2", 5, "kept")]
    extra = [data[3], data[3], (None, "the cat without a number", "en", "s1", 24, "kept")]
    return spark.createDataFrame([*data, *copies, *junk, *extra], SCHEMA)


def test_stages(spark, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        seen[name] = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "mix", "bpe"]
    assert all(seen[name].columns == documents.columns for name in names[:-1])
    ids = {name: sorted(str(r.doc_id) for r in frame.select("doc_id").collect()) for name, frame in seen.items()}
    everything = documents.collect()
    assert ids["language"] == sorted(str(r.doc_id) for r in everything if r.doc_id not in (300, 301, 302))
    left = [(r.doc_id, r.text) for r in seen["language"].collect()]
    wanted = {key for key, _, root in brute_force(left) if key == root and key != "None"}
    assert ids["near_dedup"] == sorted([*wanted, "None"])
    kept = {r.doc_id: r for r in seen["near_dedup"].collect()}
    mixed = seen["mix"].collect()
    assert {r.doc_id for r in mixed} <= set(kept)
    for row in mixed:
        assert row.text in kept[row.doc_id].text and row.n_chars == len(row.text) and row.score == "kept"
        assert sum(r.doc_id == row.doc_id for r in mixed) <= 2
    bpe = WordBpe(open(corpus_pipeline.TOKENIZER, "rb").read())
    texts = sorted((str(r.doc_id), tuple(bpe.encode(r.text))) for r in mixed)
    coded = seen["bpe"].collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in coded) == texts
    assert all(r.n_tokens == len(r.ids) for r in coded)


def test_empty_documents(spark, documents):
    docs = documents.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_unlabelled_documents_stay(spark, documents):
    bare = documents.selectExpr("doc_id", "text", "cast(null as string) AS lang", "source", "n_chars", "score")
    assert corpus_pipeline.identify_language(spark, bare, "").count() == documents.count()


def test_one_row_of_each_component(spark):
    words = [f"w{i}" for i in range(60)]
    one, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2])
    data = [(1, one), (2, one + " more"), (2, other), (3, third), (3, third + " x"), (3, third), (None, other + " y"), (5, ""), (5, " ")]
    data += [(None, "only rows without id"), (None, "only rows without id"), (4, "a b c d e f"), (4, "g h i j k l")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    third_left = [row for row in left if row[0] == 3]
    assert len(third_left) == 1 and third_left[0][1].startswith(third)
    rest = [(1, one), (2, other), (5, ""), (5, " "), (None, "only rows without id"), (4, "a b c d e f"), (4, "g h i j k l")]
    assert sorted(map(str, left)) == sorted(map(str, [*rest, *third_left]))


def test_ids_are_decoded(spark, documents):
    coded = corpus_pipeline.encode_texts(spark, documents, "").collect()
    bpe = WordBpe(open(corpus_pipeline.TOKENIZER, "rb").read())
    assert len(coded) == documents.count()
    assert all(r.decoded_sha256 == hashlib.sha256(bpe.decode(list(r.ids)).encode()).hexdigest() for r in coded)


def test_near_duplicate_stage_removes_what_its_writes_shuffled(spark, rows, shuffled, monkeypatch):
    left, write = [], near_dedup.materialize

    def watched(frame, label="table"):
        before = shuffled()
        kept = write(frame, label)
        left.append(shuffled() - before)
        return kept

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "materialize", watched)
    base = [f"w{i}" for i in range(60)]
    data = [(i, " ".join([*base, *(f"x{i}-{n}" for n in range(1 + i % 5))])) for i in range(40)]
    stage = corpus_pipeline.drop_near_duplicates(spark, rows(data, "doc_id long, text string"), "")
    assert len(left) > 20 and not any(left)
    assert [r.doc_id for r in stage.collect()] == [0]
