"""Column functions on micro-tables."""

from __future__ import annotations

import math

import pytest
import regex
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tokentide.functions import answers, buckets, numbers, paths
from tokentide.functions.tokenizers import (
    _CJK_PUNCTUATION, PIECES, PRETOKENS, WORDS, Bytes, Chars, Pattern, special_token_total,
)
from tokentide.operators.counting import token_count
from tokentide.schema import parse_dataset, parse_named, valid_tag


def values(frame, column):
    return [row[0] for row in frame.select(column).collect()]


def test_counts_of_known_texts(rows):
    frame = rows([(None,), ("",), ("It's 12 你好，world！ a\n\n b  c",), ("😀",)], "t string")
    expected = {
        Chars(): [0, 0, 26, 1],
        Bytes(): [0, 0, 26 + 2 * 4, 4],
        WORDS: [0, 0, 6, 1],
        PRETOKENS: [0, 0, 15, 1],
    }
    for tokenizer, counts in expected.items():
        found = values(frame, token_count(F.col("t"), tokenizer))
        if tokenizer.name == "chars":
            counts[2] = len("It's 12 你好，world！ a\n\n b  c")
        if tokenizer.name == "bytes":
            counts[2] = len("It's 12 你好，world！ a\n\n b  c".encode())
        assert found == counts, tokenizer.name


# The pre-token split in the notation of the regex module.
_PUNCTUATION = "[" + "".join(map(regex.escape, _CJK_PUNCTUATION[1:-1])) + "]"
_PRETOKEN = regex.compile(
    r"'(?i:[sdmt]|ll|ve|re)| (?=\p{Han}|" + _PUNCTUATION + ")|" + _PUNCTUATION
    + r"+[\r\n]*|[^\r\n\p{L}\p{N}]?+[\p{L}\p{M}]+|\p{N}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)
_ALPHABET = "ab'sT 1２٣\t\r\n　你好，。！…·–-_é́ü .😀/ſ"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(_ALPHABET, max_size=40), min_size=30, max_size=60))
def test_pattern_counts_equal_matching_in_python(rows, texts):
    frame = rows([(text,) for text in texts], "t string")
    found = frame.select(*[t.count(F.col("t")).alias(t.name) for t in (WORDS, PIECES, PRETOKENS)]).collect()
    piece = regex.compile(r"\p{L}+|\p{N}|[^ \t\r\n\p{L}\p{N}]+")
    for row, text in zip(found, texts):
        assert row.words == len(regex.findall(r"[^ \t\r\n]+", text)), repr(text)
        assert row.pieces == len(piece.findall(text)), repr(text)
        assert row.pretokens == len(_PRETOKEN.findall(text)), repr(text)


def test_pattern_without_declared_gaps(rows):
    frame = rows([("aXbb cX",)], "t string")
    assert values(frame, Pattern("x", "X|b+").count(F.col("t"))) == [3]


def test_special_tokens(rows):
    frame = rows([(10, 4)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    wanted = {
        11: special_token_total(a),
        12: special_token_total(a, eos=True),
        10: special_token_total(a, bos=False),
        15: special_token_total(a, b),
        16: special_token_total(a, b, eos=True),
        18: special_token_total(a, b, eos=True, wrap_second=True),
    }
    for total, column in wanted.items():
        assert values(frame, column) == [total]


def test_zero_baselines_and_empty_totals(rows):
    frame = rows([(3, 0), (3, 2)], "v long, b long")
    ratio = values(frame, numbers.ratio(F.col("v"), F.col("b")))
    percent = values(frame, numbers.percent_change(F.col("v"), F.col("b")))
    assert math.isnan(ratio[0]) and ratio[1] == 1.5
    assert math.isnan(percent[0]) and percent[1] == 150.0
    assert values(frame, numbers.share(F.col("v"), F.col("b"))) == [0.0, 150.0]
    assert values(frame, numbers.mean(F.col("v"), F.col("b"))) == [0.0, 1.5]
    assert values(frame, numbers.per_second(F.col("v"), F.col("b"))) == [0.0, 1.5]


def test_fixed4_rounds_on_the_exact_value(rows):
    numbers_in = [0.0, 1.0, 1 / 32, 3 / 32, 1 / 160, 3 / 160, 2 / 3, 0.99995, 0.00005, 0.12345, 1e-9]
    numbers_in += [a / b for b in range(1, 200, 7) for a in range(0, b + 1, 3)]
    frame = rows([(x,) for x in numbers_in], "x double")
    assert values(frame, numbers.fixed4(F.col("x"))) == [f"{x:.4f}" for x in numbers_in]


def test_length_buckets_and_labels(rows):
    frame = rows([(n,) for n in (0, 1999, 2000, 7999, 8000, 999_999, 1_000_000)], "n long")
    assert values(frame, buckets.bucket_label(buckets.length_bucket(F.col("n")))) == [
        "<2k", "<2k", "2k–8k", "2k–8k", "8k–16k", "512k–1M", ">=1M",
    ]
    assert buckets.bucket_names([2_000, 8_000]) == ["<2k", "2k–8k", ">=8k"]
    assert buckets.short_number(1_500) == "1500"


def test_natural_order(rows):
    ordered = ["a.md", "b/a", "b/A2", "b/a10", "1.md", "01.md", "2.md", "10.md"]
    frame = rows([(path,) for path in reversed(ordered)], "p string")
    assert values(frame.orderBy(paths.natural_key(F.col("p")), "p"), "p") == ordered


def test_natural_order_of_wide_numbers(rows):
    largest = str(2**128 - 1)
    ordered = ["9", "0" * 50 + "10", str(10**38), str(2**128 - 2), largest, str(2**128) + "", "9" * 39, "1" + "0" * 45]
    frame = rows([(path,) for path in reversed(ordered)], "p string")
    # From the largest on, values are equal and the written length decides, then the path.
    assert values(frame.orderBy(paths.natural_key(F.col("p")), "p"), "p") == ordered


def test_path_groups_and_range_labels(rows):
    frame = rows([("a/b/c.md",), ("c.md",), ("a/d.md",)], "p string")
    assert values(frame, paths.top_level(F.col("p"))) == ["a", "c.md", "a"]
    assert values(frame, paths.parent(F.col("p"))) == ["a/b", ".", "a"]
    labels = rows([("book", "book/part2/50.md"), ("book", "other/1.md"), ("book", "books/1.md")], "g string, p string")
    assert values(labels, paths.range_label(F.col("g"), F.col("p"))) == ["part2/50.md", "other/1.md", "books/1.md"]


@pytest.mark.parametrize(
    "response, items",
    [
        ("x\nFinal Answer: [b, a]", ["a", "b"]),
        ("Final Answer:[a]", ["a"]),
        ("Final Answer:  [a]", []),
        ("Final Answer: [a]\n", ["a"]),
        ("Final Answer: [a]\r\n", ["a"]),
        ("Final Answer: [a]\n\n", []),
        ("Final Answer: [a]\nmore", []),
        ("Final Answer: []", []),
        ("Final Answer: [ ]", []),
        ("Final Answer: ['a', \"b\", a, '' , ,]", ["a", "b"]),
        ("Final Answer: [\" 'a' \"]", [" 'a' "]),
        ("Final Answer: [ a ,　b]", ["a", "b"]),
        ("Final Answer: [a] Final Answer: [b]", ["a"]),
        ("Final Answer: [a", []),
        ("", []),
        (None, []),
    ],
)
def test_final_answer(rows, response, items):
    frame = rows([(response,)], "r string")
    assert values(frame, answers.final_answer(F.col("r"))) == [items]


@pytest.mark.parametrize(
    "predicted, truth, scores",
    [
        ([], [], (1.0, 1.0, 1.0)),
        (["a"], [], (1.0, 0.0, 0.0)),
        ([], ["a"], (0.0, 1.0, 0.0)),
        (["a"], ["b"], (0.0, 0.0, 0.0)),
        (["a", "b"], ["a"], (1.0, 0.5, 2 / 3)),
        (["a"], ["a", "b", "c", "d"], (0.25, 1.0, 0.4)),
    ],
)
def test_set_score(rows, predicted, truth, scores):
    frame = rows([(predicted, truth)], "p array<string>, t array<string>")
    assert tuple(values(frame, answers.set_score(F.col("p"), F.col("t")))[0]) == pytest.approx(scores)


def test_spec_texts():
    assert parse_named("Model 5=dir/a=b.json") == ("Model 5", "dir/a=b.json")
    assert parse_dataset(" short =a,b") == ("short", ["a", "b"])
    for bad in ("x", "=a", " =a", "a="):
        with pytest.raises(ValueError):
            parse_named(bad)
    with pytest.raises(ValueError):
        parse_dataset("a=b,,c")
    assert valid_tag("v4_x") == "v4_x"
    for bad in ("", "a-b", "é"):
        with pytest.raises(ValueError):
            valid_tag(bad)
