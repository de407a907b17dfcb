"""Counting, profiling, splitting, ordering and alignment on small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plans import plan_text
from tokentide.functions.tokenizers import WORDS, Chars, Pattern
from tokentide.operators import compare, corpus, split
from tokentide.operators.align import TokenizerSet, align, dataset_paths
from tokentide.operators.counting import count_tokens
from tokentide.operators import ordering
from tokentide.operators.ordering import exact_quantiles, nth_smallest, with_position, with_running_total
from tokentide.operators.profile import category_frequency, head_and_tail, token_histogram, token_profile
from tokentide.sources.tables import tag_inputs

TOKENS = [None, -1, 0, 8000, 8001, 16000, 16001, 1_000_000, 1_000_001]


def test_count_tokens_appends_two_columns(rows):
    frame = rows([("a b", 1), (None, 2)], "text string, x int")
    counted = count_tokens(frame, "text", WORDS, "w", limit=1)
    assert counted.columns == ["text", "x", "w_input_tokens", "w_over_1m"]
    assert [field.dataType.simpleString() for field in counted.schema][2:] == ["int", "boolean"]
    assert [tuple(row)[1:] for row in counted.orderBy("x").collect()] == [(1, 2, True), (2, 0, False)]
    with pytest.raises(ValueError):
        count_tokens(counted, "text", WORDS, "w")
    with pytest.raises(TypeError):
        count_tokens(frame, "x", WORDS, "v")
    with pytest.raises(ValueError):
        count_tokens(frame, "text", WORDS, "a-b")


def test_profile_null_and_failed_rows(rows):
    frame = rows([(t, "g" if i % 2 else None) for i, t in enumerate(TOKENS)], "n int, g string")
    profile = {row.level: row for row in token_profile(frame, "n", "g").collect()}
    assert set(profile) == {"all", "group"}
    whole = profile["all"]
    known = [t for t in TOKENS if t is not None]
    assert (whole.total, whole.min_tokens, whole.max_tokens, whole.over_limit) == (8, -1, 1_000_001, 1)
    assert whole.sum_tokens == sum(max(t, 0) for t in known)
    assert [r.rows for r in whole.by_range] == [2, 2, 1, 0, 0, 0, 0, 1, 1]
    group = [t for i, t in enumerate(TOKENS) if i % 2]
    assert profile["group"].total == len(group)
    assert profile["group"].sum_tokens == sum(max(t, 0) for t in group)


def test_profile_without_group_column_or_rows(rows):
    empty = rows([], "n int, g string")
    for group in ("g", "absent", None):
        found = token_profile(empty, "n", group).collect()
        assert [(r.level, r.total, r.min_tokens, r.max_tokens, r.mean_tokens) for r in found] == [("all", 0, 0, 0, 0.0)]
    histogram = token_histogram(token_profile(empty, "n")).collect()
    assert [(r.rows, r.share) for r in histogram] == [(0, 0.0)] * 9


def test_profile_by_input_counts_a_repeated_input_twice(rows):
    frame = rows([(1, "a"), (2, "b"), (3, None)], "n int, g string")
    found = token_profile(tag_inputs([frame, frame]), "n", "g", "input_id").collect()
    levels = {(r.level, r.input_id, r.group): r.sum_tokens for r in found}
    assert levels[("all", None, None)] == 12
    assert levels[("group", None, "a")] == 2
    assert levels[("input", 0, None)] == levels[("input", 1, None)] == 6
    assert levels[("input_group", 1, "b")] == 2
    assert len(levels) == 1 + 2 + 2 + 4


def test_split_sends_null_to_the_low_side(rows):
    frame = rows([(t,) for t in TOKENS], "n int")
    low, high = split.split(frame, "n")
    assert low.count() == 8 and [r.n for r in high.collect()] == [1_000_001]
    bands = dict(split.with_band(frame, "n", 8000).groupBy("band").count().collect())
    assert bands == {"low": 4, "high": 5}


def test_category_frequency_and_ends(rows):
    frame = rows([(i, c) for i, c in enumerate(["b", "a", "b", None, "a", "c", "b"])], "i long, c string")
    found = [tuple(r) for r in category_frequency(frame, "c").collect()]
    assert found == [("b", 3, 300 / 7), ("a", 2, 200 / 7), ("", 1, 100 / 7), ("c", 1, 100 / 7)]
    ends = head_and_tail(frame, "i", ["c"], count=2).collect()
    assert [(r.part, r.row_id, r.c) for r in ends] == [
        ("first", 0, "b"), ("first", 1, "a"), ("last", 5, "c"), ("last", 6, "b"),
    ]


@pytest.mark.parametrize("partitions", [1, 7])
def test_position_with_one_group_holding_most_rows(rows, partitions):
    random.seed(partitions)
    data = [("hot" if random.random() < 0.7 else random.choice(["a", "b", None]), i) for i in range(3000)]
    random.shuffle(data)
    frame = rows(data, "g string, i int").repartition(partitions)
    expected = {}
    for group, i in sorted(data, key=lambda row: row[1]):
        expected.setdefault(group, []).append(i)
    for row in with_position(frame, ["i"], ["g"]).collect():
        assert expected[row.g][row.position] == row.i
    positions = [r.position for r in with_position(frame, ["i"]).orderBy("i").collect()]
    assert positions == list(range(3000))


def test_exact_quantiles_equal_numpy(rows):
    random.seed(5)
    data = [(0.0 if random.random() < 0.4 else random.random(), random.randrange(10)) for _ in range(4000)]
    frame = rows(data, "x double, k int").repartition(6)
    probes = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    found = exact_quantiles(frame, {"x": (F.col("x"), probes), "k": (F.col("k"), [0.5])}).collect()
    by_measure = {(r.measure, r["quantile"]): r.value for r in found}
    assert len(by_measure) == 9
    for probe in probes:
        assert by_measure[("x", probe)] == pytest.approx(np.quantile([x for x, _ in data], probe), rel=1e-12)
    assert by_measure[("k", 0.5)] == np.median([k for _, k in data])


def test_quantiles_of_all_magnitudes(rows):
    random.seed(11)
    values = [random.choice([-1, 1]) * 10.0 ** random.uniform(-320, 308) for _ in range(1500)]
    values += [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308]
    # Neighbouring doubles, of which no two may fall together.
    step = 1.0
    for _ in range(300):
        values.append(step)
        step = math.nextafter(step, 2)
    values += [2.0**53 + 2 * n for n in range(200)] + [7.25] * 500
    random.shuffle(values)
    ordered = sorted(values)
    probes = [i / (len(values) - 1) for i in random.sample(range(len(values)), 60)] + [0.0, 1.0]
    found = {r["quantile"]: r.value for r in exact_quantiles(rows([(v,) for v in values], "x double"), {"x": (F.col("x"), probes)}).collect()}
    for probe in probes:
        exact = probe * (len(values) - 1)
        low, high = ordered[math.floor(exact)], ordered[math.ceil(exact)]
        assert found[probe] == (low if low == high else low + (high - low) * (exact - math.floor(exact)))


def test_quantiles_sort_buckets_only(spark):
    sorts = []
    plan = plan_text(ordering._buckets(spark.range(10).selectExpr("0 AS m", "id AS bucket", "id * 1.0D AS value"), ["m"]))
    sorts = [line for line in plan.splitlines() if "Sort " in line or "Sort[" in line or "+- Sort" in line]
    assert sorts and all("value" not in line for line in sorts) and "rangepartitioning" not in plan
    found = exact_quantiles(spark.range(1000).selectExpr("id * 1.0D AS x"), {"x": (F.col("x"), [0.5])})
    assert "Sort" not in plan_text(found) and "Scan parquet" not in plan_text(found)


@pytest.mark.parametrize("low, high", [(0, 50), (-70, 70), (-(2**62), 2**62), (2**40, 2**40 + 10**6)])
def test_nth_smallest(rows, low, high):
    random.seed(high)
    values = [random.randrange(low, high) for _ in range(800)] + [low] * 5 + [None] * 20
    random.shuffle(values)
    frame, ordered = rows([(v,) for v in values], "id long").repartition(3), sorted(v for v in values if v is not None)
    for n in (1, 2, 400, 805):
        assert nth_smallest(frame, "id", n) == ordered[n - 1]
    assert nth_smallest(frame, "id", 806) is None and nth_smallest(frame, "id", 0) is None
    assert nth_smallest(frame.where("id IS NULL"), "id", 1) is None


def test_running_totals(rows):
    random.seed(2)
    data = [("hot" if random.random() < 0.6 else None, i, random.randrange(5)) for i in range(1000)]
    expected, sums = {}, {}
    for group, i, n in data:
        expected[i] = sums.get(group, 0)
        sums[group] = expected[i] + n
    random.shuffle(data)
    frame = rows(data, "g string, i int, n int").repartition(5)
    assert {r.i: r.before for r in with_running_total(frame, ["i"], F.col("n"), ["g"]).collect()} == expected


def test_quantiles_of_known_values_and_nan_last(rows):
    frame = rows([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    found = exact_quantiles(frame, {"x": (F.col("x"), [0.1, 0.25, 0.5])}).collect()
    assert {round(r["quantile"], 2): round(r.value, 9) for r in found} == {0.1: 1.3, 0.25: 1.75, 0.5: 3.0}
    holed = rows([(1.0,), (math.nan,), (3.0,)], "x double")
    found = {r["quantile"]: r.value for r in exact_quantiles(holed, {"x": (F.col("x"), [0.0, 0.5, 1.0])}).collect()}
    assert found[0.0] == 1.0 and found[0.5] == 3.0 and math.isnan(found[1.0])
    single = exact_quantiles(rows([(7.0,)], "x double"), {"x": (F.col("x"), [0.0, 0.3, 1.0])}).collect()
    assert [r.value for r in single] == [7.0] * 3


def test_tokenizer_sets():
    three = TokenizerSet.of(["A=a_tokens", "B=b_tokens", "C=c_tokens"], "C")
    assert three.primary == "C" and three.names == ["A", "B", "C"] and three.columns["B"] == "b_tokens"
    assert TokenizerSet.of({"A": "a", "B": "b"}).primary == "A"
    for columns, primary in ((["A"], None), (["A=x", "A=y"], None), (["A=x", "B=x"], None), (["A", "B"], "D")):
        with pytest.raises(ValueError):
            TokenizerSet.of(columns, primary)
    assert dataset_paths(["short=a,b,c"], three) == {"short": ["a", "b", "c"]}
    with pytest.raises(ValueError):
        dataset_paths(["short=a,b"], three)


PAIR = TokenizerSet.of(["A", "B"])


def test_align(rows):
    a = rows([(0, 5, "x"), (1, 7, "y")], "row_id long, tokens long, label string")
    b = rows([(1, 8), (0, 6)], "row_id long, tokens long")
    found = align({"one": {"A": a, "B": b}, "two": {"A": a, "B": b}}, PAIR).orderBy("dataset", "row_id").collect()
    assert [tuple(r) for r in found] == [
        ("one", 0, "x", 5, 6), ("one", 1, "y", 7, 8), ("two", 0, "x", 5, 6), ("two", 1, "y", 7, 8),
    ]


@pytest.mark.parametrize("other", [[(0, 6)], [(0, 6), (1, 7), (2, 8)], [(0, 6), (1, 7), (1, 7)]])
def test_align_rejects_gaps(rows, other):
    a = rows([(0, 5), (1, 7)], "row_id long, tokens long")
    b = rows(other, "row_id long, tokens long")
    with pytest.raises(Exception, match="row not counted once"):
        align({"d": {"A": a, "B": b}}, PAIR).collect()


def items(rows, data):
    return rows(data, "A long, B long")


def test_fit_recovers_a_line_and_degenerate_inputs(rows):
    def fit(data):
        row = compare.fits(compare.comparison_totals(items(rows, data), PAIR), PAIR).first()
        return row.slope, row.intercept, row.r2

    assert fit([(1, 3), (2, 5), (3, 7)]) == pytest.approx((2, 1, 1))
    assert all(map(math.isnan, fit([(2, 3), (2, 5)])))
    assert all(map(math.isnan, fit([(2, 3)])))
    slope, intercept, r2 = fit([(1, 4), (2, 4), (3, 4)])
    assert (slope, intercept) == (0, 4) and math.isnan(r2)


def test_comparison_sections(rows):
    frame = items(rows, [(100, 120), (100, 90), (0, 0), (2000, 2000)])
    totals = compare.comparison_totals(frame, PAIR, [99, 100])
    whole = {r.tokenizer: r for r in compare.overall(frame, PAIR, totals).collect()}
    assert (whole["B"].sum_tokens, whole["B"].difference, whole["B"].median_tokens) == (2210, 10, 105.0)
    assert whole["B"].percent == pytest.approx(10 / 2200 * 100) and whole["A"].percent == 0
    limits = {(r.limit, r.tokenizer): (r.above, r.change) for r in compare.above_limits(totals, PAIR, [99, 100]).collect()}
    assert limits == {(99, "A"): (3, 0), (99, "B"): (2, -1), (100, "A"): (1, 0), (100, "B"): (2, 1)}
    row = compare.directions(totals, PAIR).first()
    assert (row.less, row.equal, row.more) == (1, 2, 1)
    lengths = [tuple(r) for r in compare.by_length(frame, PAIR).orderBy("position").collect()]
    assert lengths == [(0, "<2k", 3, 200 / 3, 70.0, 1.05), (1, "2k–8k", 1, 2000.0, 2000.0, 1.0)]
    found = {r.label: r for r in compare.quantiles(frame, PAIR).collect()}
    assert found["min"].difference == -10 and found["max"].difference == 20
    assert found["min"].ratio == 0.9 and math.isnan(found["max"].ratio)


def test_pairs_are_relative_to_the_core(rows):
    totals = compare.comparison_totals(items(rows, [(100, 120)]), PAIR)
    found = {r.core: (r.other, r.difference, r.verdict, r.percent) for r in compare.pairs(totals, PAIR).collect()}
    assert found["A"] == ("B", 20, "more", 20.0)
    assert found["B"][:3] == ("A", -20, "less") and found["B"][3] == pytest.approx(20 / 120 * 100)
    same = compare.pairs(compare.comparison_totals(items(rows, [(1, 1)]), PAIR), PAIR).first()
    assert (same.verdict, same.percent) == ("same", 0.0)


def test_no_items_is_an_error(rows):
    with pytest.raises(Exception, match="no items"):
        compare.comparison_totals(items(rows, []), PAIR).collect()


def test_group_totals_with_grand_total(rows):
    frame = rows([("x", 1, 2), (None, 3, 3), ("x", 0, 1)], "g string, A long, B long")
    found = {(r.group, r.is_total): tuple(r)[2:] for r in compare.group_totals(frame, PAIR, F.upper("g")).collect()}
    assert found == {("X", False): (2, 1, 3, 3.0), ("", False): (1, 3, 3, 1.0), ("", True): (3, 4, 6, 1.5)}
    zero = compare.group_totals(rows([("x", 0, 2)], "g string, A long, B long"), PAIR, "g", grand_total=False)
    assert math.isnan(zero.first().B_ratio)


def test_names_with_spaces_and_dots(rows):
    named = TokenizerSet.of(["A 4.1=a", "B 5.2=b"])
    a = rows([(0, 5), (1, 7)], "row_id long, tokens long")
    aligned = align({"d": {"A 4.1": a, "B 5.2": a.withColumn("tokens", F.col("tokens") * 2)}}, named)
    totals = compare.comparison_totals(aligned, named)
    assert compare.fits(totals, named).first().slope == pytest.approx(2)
    assert {r.tokenizer: r.sum_tokens for r in compare.overall(aligned, named, totals).collect()} == {"A 4.1": 12, "B 5.2": 24}
    assert compare.group_totals(aligned, named, "dataset").where("is_total").first()["B 5.2_ratio"] == 2.0
    assert compare.by_length(aligned, named).first()["A 4.1_mean"] == 6.0
    assert compare.quantiles(aligned, named).count() == 8
    files = rows([("a/1.md", "x y"), ("a/2.md", "z")], "path string, text string")
    tokenizers = [Pattern("A 4.1", "[a-z]", None), Chars("B 5.2")]
    items = corpus.count_files(files, tokenizers)
    chunk = corpus.chunk_totals(items, named, 5).first()
    assert (chunk["A 4.1"], chunk["B 5.2"]) == (3, 4)
    assert corpus.details(items, named).count() == 2 and corpus.file_groups(items, named).count() == 1


def test_quantiles_skip_nulls(rows):
    frame = rows([(1.0,), (None,), (3.0,), (None,)], "x double")
    found = {r.quantile: r.value for r in exact_quantiles(frame, {"x": (F.col("x"), [0.0, 0.5, 1.0])}).collect()}
    assert found == {0.0: 1.0, 0.5: 2.0, 1.0: 3.0}
    assert exact_quantiles(frame.where("x IS NULL"), {"x": (F.col("x"), [0.5])}).count() == 0
