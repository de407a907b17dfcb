"""Byte-pair encoding and cached counts against the tokenizers library."""

from __future__ import annotations

import json
import os

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tokentide.llm import bpe, token_counts
from tokentide.session import scratch_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a  b", "a \n b", "a\n\n b", "foo\n\n  x", "tail ", "tail  ", "\t\ttab  x", "<|endoftext|>", "a<|endoftext|> b",
    "<|startoftext|>hi<|startoftext|", "ΣΑΣ σς İstanbul Ŀ ﬁ", "é ạ̈", "你好，world！ it's I'LL don't 'S 12345 ٣٤",
    "b\x85d\x1ce\x1d f", "🙂👍🏽 zwj 👨‍👩‍👧", "x" * 3000, "ab" * 700 + " end", "中" * 900, "\u0000a", "a'ſb", "ǅ ẞ K Å", "a 　b", "\r\n x\r\ny \r\n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}


@pytest.fixture(scope="module")
def coders():
    data = [open(path, "rb").read() for path in (WORD, BYTE)]
    return bpe.WordBpe(data[0]), token_counts._json_counter(data[1])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeth'sSΣé你.,! \n\t <|endofx>1́")))
def test_any_text_equals_the_library(library, coders, text):
    ids = coders[0].encode(text)
    assert ids == library[WORD].encode(text, add_special_tokens=False).ids
    assert coders[0].decode(ids) == library[WORD].decode(ids, skip_special_tokens=False)
    assert coders[1]([text]) == [len(library[BYTE].encode(text, add_special_tokens=False).ids)]


@given(st.text(st.sampled_from("abcdeth"), min_size=2, max_size=60))
def test_scan_and_queue_merge_alike(coders, word):
    whole = word + "</w>"
    bounds = [*range(len(word)), len(whole)]
    assert bpe.scan_merge(whole, list(bounds), coders[0].ranks) == bpe.queue_merge(whole, list(bounds), coders[0].ranks)


def test_encode_and_decode_frames(rows, library):
    data = [(i, text, "old") for i, text in enumerate([*ODD, None, ODD[4], ODD[4]])]
    frame = rows(data, "doc_id long, text string, IDS string")
    coded = bpe.encode(frame, WORD)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    again = bpe.decode(coded.drop("decoded"), WORD)
    decoded = {r.doc_id: r.decoded for r in again.collect()}
    for row in coded.collect():
        want = library[WORD].encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want and row.decoded == decoded[row.doc_id] == library[WORD].decode(want, skip_special_tokens=False)
    assert bpe.encode(frame.where("false"), WORD).count() == 0
    assert bpe.encode(frame.select("text"), WORD, decoded=False).columns == ["text", "ids"]


def test_decoding_leaves_out_what_no_token_is(rows, library):
    ids = [[320, None, 400], [-1, 10**6, 320], [], None, [320] * 100_000, [49406, 320, 49407]]
    frame = rows([(i, row, "old") for i, row in enumerate(ids)], "doc_id long, ids array<int>, Decoded string")
    found = bpe.decode(frame, WORD)
    assert found.columns == ["doc_id", "ids", "decoded"]
    for row in found.collect():
        known = [number for number in ids[row.doc_id] or [] if number is not None and 0 <= number < 49408]
        assert row.decoded == library[WORD].decode(known, skip_special_tokens=False)
    assert bpe.decode(frame.where("false"), WORD).count() == 0


@pytest.mark.parametrize("rule", ["single_word", "lstrip", "rstrip", "normalized"])
def test_special_strings_with_rules_are_refused(rule):
    config = json.load(open(WORD))
    config["added_tokens"][0][rule] = True
    with pytest.raises(ValueError, match="rules of their own"):
        bpe.WordBpe(json.dumps(config).encode())


def test_counts_through_the_cache(spark, rows, library):
    cache = scratch_path(spark, "cache-test")
    data = [(i, text, 1) for i, text in enumerate([*ODD, None, *ODD[:5]])]
    frame = rows(data, "doc_id long, text string, n_tokens int")

    def check(found):
        for r in found.collect():
            want = len(library[BYTE].encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 512)
        return found.count()

    assert check(token_counts.count_tokens(frame, BYTE, cache)) == len(data)
    stored = lambda: spark.read.parquet(cache).count()
    first = stored()
    assert first == len(set(ODD))
    more = rows([(99, "a text not seen before", 1), (100, ODD[3], 1)], frame.schema)
    assert check(token_counts.count_tokens(more, BYTE, cache)) == 2 and stored() == first + 1
    # Another tokenizer version has counts of its own.
    token_counts.count_tokens(more, WORD, cache)
    assert stored() == first + 3
    assert token_counts.count_tokens(frame.where("false"), BYTE, cache).count() == 0


def test_piece_models(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["Hello there", "", None, "né  à 你"]
    found = token_counts.count_tokens(rows([(t,) for t in texts], "text string"), PIECE, scratch_path(spark, "pieces")).collect()
    assert {r.text: r.n_tokens for r in found} == {t: len(model.encode(t or "")) for t in texts}


