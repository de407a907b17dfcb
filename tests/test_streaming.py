"""Streams in batch and streaming form."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Row, functions as F

from tokentide.plans.jobs import evaluate_line_stream, evaluate_lines
from tokentide.plans.stream_queries import _drain, _drain_batches, _flat
from tokentide.session import scratch_path, state_settings
from tokentide.sinks.results import once_per_sample, untimed_responses
from tokentide.sources.samples import as_samples
from tokentide.streaming.assemble import (
    _Assembler, _see, as_responses, assemble, assemble_stream, ticks_from_lines, unplaced_lines,
)
from tokentide.streaming.rates import (
    _Requests, active_requests, active_states, live_rate, live_rate_stream, merge_active, request_states, unplaced_ticks,
)
from tokentide.streaming.totals import running_totals


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Two tasks of state are enough for a handful of keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def chunk(*deltas, usage=None):
    value = {"choices": [{"delta": delta} for delta in deltas]}
    if usage is not None:
        value["usage"] = usage
    return "data: " + json.dumps(value)


def total(n):
    return {"prompt_tokens": 1, "completion_tokens": n - 1, "total_tokens": n}


LINES = {
    1: [
        chunk({"content": "a"}, {"content": "b", "reasoning_content": "r"}) + "\r",
        "data: {broken",
        ": comment",
        "",
        chunk({"content": None, "reasoning_content": "s"}, usage=total(0)),
        chunk({"content": "c\n"}, usage=total(5)),
        "data: [DONE]",
        chunk({"content": "late"}, usage=total(9)),
    ],
    2: [chunk({"content": "x"}, usage=total(3)), chunk({}, usage=total(4)), "data: [DONE]"],
    3: ["data: [DONE]"],
}
EXPECTED = {1: ("abc\n", "rs", 5), 2: ("x", None, 4), 3: ("", None, None)}


def lines_of(rows, data, shuffle=0):
    listed = [(key, seq, line) for key, lines in data.items() for seq, line in enumerate(lines)]
    random.Random(shuffle).shuffle(listed)
    return rows(listed, "sample_index long, seq long, line string")


def shown(flat):
    return {r.sample_index: (r.content, r.reasoning, r.total_tokens) for r in flat.collect()}


def test_assemble(rows):
    assert shown(_flat(assemble(lines_of(rows, LINES)))) == EXPECTED


def test_assemble_joins_many_segments(rows):
    texts = [str(n) + "," for n in range(10_000)]
    data = {1: [chunk({"content": text}, usage=total(n + 1)) for n, text in enumerate(texts)]}
    data[1].insert(9_000, "data: [DONE]")
    found = shown(_flat(assemble(lines_of(rows, data))))
    assert found == {1: ("".join(texts[:9_000]), None, 9_000)}


def stream_of(spark, frames):
    """A stream that sees each frame in a micro-batch of its own."""
    path = scratch_path(spark, "batches")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches", [1, 3])
def test_assemble_stream_equals_batch(spark, rows, batches):
    data = {key: lines[: lines.index("data: [DONE]") + 1] for key, lines in LINES.items()}
    lines = lines_of(rows, data, shuffle=batches).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    )
    listed = lines.collect()
    frames = [rows(listed[i::batches], lines.schema) for i in range(batches)]
    assert shown(_drain(assemble_stream(stream_of(spark, frames)), "assembled")) == EXPECTED


def test_idle_sample_is_emitted_as_it_is(spark, rows):
    schema = "sample_index long, seq long, line string, ts timestamp"
    start = rows([(1, 0, chunk({"content": "part"}))], "sample_index long, seq long, line string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000))
    )
    later = rows([(2, 0, "data: [DONE]")], "sample_index long, seq long, line string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_009_000))
    )
    stream = stream_of(spark, [start.select(*[f.split()[0] for f in schema.split(", ")]), later])
    found = shown(_drain(assemble_stream(stream, late="1 minute", idle="1 hour"), "idle"))
    assert found == {1: ("part", None, None), 2: ("", None, None)}


def timed(rows, data, start=1_700_000_000):
    """Lines (sample, seq, line) with a second between them."""
    frame = rows(data, "sample_index long, seq long, line string")
    return frame.withColumn("ts", F.timestamp_seconds(F.lit(start) + F.col("seq")))


def test_lines_after_the_end_do_not_begin_a_sample_anew(spark, rows):
    frames = [
        timed(rows, [(1, 0, chunk({"content": "a"})), (1, 1, "data: [DONE]")]),
        timed(rows, [(1, 2, "")]),
        timed(rows, [(1, 2, ""), (2, 0, "data: [DONE]")], 1_700_009_000),
        timed(rows, [(3, 0, "data: [DONE]")], 1_700_099_000),
    ]
    found = _drain(assemble_stream(stream_of(spark, frames), late="1 minute", idle="1 hour"), "after").collect()
    assert sorted((r.sample_index, r.content) for r in found) == [(1, "a"), (2, ""), (3, "")]


def test_a_line_that_comes_again_does_not_complete_a_sample(spark, rows):
    frames = [
        timed(rows, [(1, 0, chunk({"content": "a"})), (1, 2, "data: [DONE]"), (1, 0, chunk({"content": "a"}))]),
        timed(rows, [(1, 0, chunk({"content": "a"}))]),
        timed(rows, [(1, 1, chunk({"content": "b"}))]),
    ]
    assert shown(_drain(assemble_stream(stream_of(spark, frames)), "again")) == {1: ("ab", None, None)}


def test_seen_ranges_join():
    seen, order = [], list(range(40)) * 2
    random.Random(5).shuffle(order)
    assert sum(_see(seen, seq) for seq in order) == 40 and seen == [0, 40]


STRANGE = {
    # Parts that are no texts are none; what is not one JSON document is no chunk.
    1: [
        'data: {"choices":[{"delta":{"content":5}}]}',
        'data: {"choices":[{"delta":{"content":{"x":1}}}]}',
        "data: {'choices':[{'delta':{'content':'q'}}]}",
        'data: {"choices":[{"delta":{"content":"t"}}]} junk',
        'data: {"choices":[{"delta":{"content":"t"}}]}{"choices":[]}',
        'data: {"choices":[{"delta":{"content":"t"}}]},"sha":1',
        chunk({"content": "z"}),
        'data: {"choices":[5,[1],null,{"delta":3},{"delta":null},{"delta":{"content":"a","reasoning_content":7}}]}',
        'data: {"choices":{"delta":{"content":"n"}}}',
        "data: 7",
        'data: {"usage":7}',
        "data:" + chunk({"content": "no blank"})[6:],
        chunk({}, usage=total(3)),
        "data: [DONE]",
    ],
    2: [chunk({}, usage={"prompt_tokens": 1, "completion_tokens": 1.5, "total_tokens": 2}), "data: [DONE]"],
    3: [chunk({"content": "x"}, usage={"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 1 << 40}), "data: [DONE]"],
    4: [chunk({"content": "x"}, usage={"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": "9"}), "data: [DONE]"],
}


def test_strange_lines_in_batch_and_stream(spark, rows):
    listed = [(key, seq, line) for key, lines in STRANGE.items() for seq, line in enumerate(lines)]
    listed += [(1, None, chunk({"content": "nowhere"})), (None, 0, chunk({"content": "nobody"}))]
    listed += listed[:9] + [(5, 0, None), (5, 1, chunk({"content": "y"})), (5, 1, chunk({"content": "y"})), (5, 2, "data: [DONE]")]
    random.Random(8).shuffle(listed)
    lines = timed(rows, listed)
    batch = as_responses(assemble(lines))
    # Every third line has no time.
    untimed = lines.withColumn("ts", F.when(F.col("seq") % 3 != 1, F.col("ts"))).collect()
    frames = [rows(untimed[i::3], lines.schema) for i in range(3)]
    stream = as_responses(_drain(assemble_stream(stream_of(spark, frames)), "strange"))
    for frame in (batch, stream):
        found = {r.row_id: r for r in frame.collect()}
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert found[1].content == "za" and found[1].reasoning is None and found[1].usage.total_tokens == 3
        assert found[2].error and found[3].error and found[2].content is None and found[3].usage is None
        assert found[4].content == "x" and found[4].usage is None and found[4].error is None
        assert found[5].content == "y"
    assert unplaced_lines(lines).count() == 2


def test_lines_over_three_batches_again_and_out_of_order(spark, rows):
    dice = random.Random(6)
    data = {
        key: [chunk({"content": f"{key}.{n},", "reasoning_content": "r" * (n % 3)}, usage=total(n + 2)) for n in range(40 * key)] + ["data: [DONE]"]
        for key in range(1, 6)
    }
    lines = lines_of(rows, data).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    listed = lines.collect()
    listed += dice.sample(listed, 200)
    dice.shuffle(listed)
    frames = [rows(listed[i::3], lines.schema) for i in range(3)]
    assert shown(_drain(assemble_stream(stream_of(spark, frames)), "shuffled")) == shown(_flat(assemble(rows(listed, lines.schema))))


def test_state_written_does_not_grow_with_a_response(spark, rows):
    frames = [timed(rows, [(1, 500 * b + n, chunk({"content": "abcdefgh" * 8 + str(n)})) for n in range(500)]) for b in range(5)]
    told = scratch_path(spark, "growth")
    stream = assemble_stream(stream_of(spark, frames))
    with state_settings(spark):
        query = stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", told + "-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    written = [p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"] for p in query.recentProgress if p["numInputRows"]]
    assert len(written) == 5 and max(written) < 1.2 * min(written)


def test_ticks_of_lines_in_batch_and_stream(spark, rows):
    lines = timed(rows, [(key, seq, line) for key, own in LINES.items() for seq, line in enumerate(own)])
    expected = {(1, 0, 2, 1, False), (1, 4, 0, 1, False), (1, 5, 2, 0, False), (1, 6, 0, 0, True), (1, 7, 4, 0, False), (2, 0, 1, 0, False), (2, 2, 0, 0, True), (3, 0, 0, 0, True)}
    names = ("sample_index", "seq", "content_delta_chars", "reasoning_delta_chars", "finished")
    stream = ticks_from_lines(stream_of(spark, [lines]))
    for ticks in (ticks_from_lines(lines), _drain(stream, "line-ticks")):
        assert {tuple(r[n] for n in names) for r in ticks.collect()} == expected
    states = _drain(request_states(ticks_from_lines(stream_of(spark, [lines]))), "line-states")
    # Characters after the end of sample 1 begin it anew.
    assert [tuple(r) for r in active_states(states).collect()] == [(1, 4, 0)]


def test_lines_to_results(spark, rows):
    schema = "row_id long, prompt string, answer_nodes array<string>, problem_type string"
    samples = as_samples(rows([(i, "p", ["a", "b"], "x") for i in range(4)], schema))
    answer = lambda text: [chunk({"content": "Final Answer: "}), chunk({"content": text}, usage=total(3)), "data: [DONE]"]
    data = {0: answer("[a, b]"), 1: answer("[a]"), 2: [chunk({}, usage={"total_tokens": 4}), "data: [DONE]"]}
    lines = timed(rows, [(key, seq, line) for key, own in data.items() for seq, line in enumerate(own)])
    sections = evaluate_lines(samples, lines)
    found = {r.row_id: r for r in sections["results"].collect()}
    assert [found[i].f1 for i in range(4)] == [1.0, pytest.approx(2 / 3), 0.0, 0.0]
    assert found[2].error == "response usage is not valid" and found[3].error == "no response"
    assert sections["summary"].first().exact_matches == 1
    output = scratch_path(spark, "line-results")
    listed = lines.collect()
    query = evaluate_line_stream(samples, stream_of(spark, [rows(listed[i::3], lines.schema) for i in range(3)]), output, output + "-progress")
    query.processAllAvailable()
    query.stop()
    written = {int(r["index"]): r for r in spark.read.option("header", True).csv(output).collect()}
    assert {i: r.f1 for i, r in written.items()} == {0: "1.0000", 1: "0.6667", 2: "0.0000"}


def test_a_repeated_response_counts_once(spark, rows):
    schema = "row_id long, status int, body string, ts long"
    frames = [rows(part, schema).withColumn("ts", F.timestamp_seconds("ts")) for part in (
        [(1, 200, "a", 100), (2, 200, "b", 100), (1, 200, "a", 100)], [(1, 200, "a", 160), (None, 200, "x", 100)], [(2, 200, "b", 200), (3, 200, "c", None), (4, 200, "d", 300)],
    )]
    found = _drain(once_per_sample(stream_of(spark, frames)), "once")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 200, "a"), (2, 200, "b"), (4, 200, "d")]
    assert untimed_responses(frames[1].unionByName(frames[2])).count() == 2


def test_bad_usage_is_an_error_row(spark, rows):
    bad = {"total_tokens": 5, "completion_tokens": 1}
    data = {
        1: [chunk({"content": "x"}, usage=bad), "data: [DONE]"],
        2: [chunk({"content": "y"}, usage=total(3)), "data: [DONE]", chunk({}, usage=bad)],
    }
    batch = as_responses(assemble(lines_of(rows, data)))
    stream = assemble_stream(stream_of(spark, [timed(rows, [(k, i, x) for k, ls in data.items() for i, x in enumerate(ls)])]))
    for frame in (batch, as_responses(_drain(stream, "bad-usage"))):
        found = {r.row_id: r for r in frame.collect()}
        assert found[1].content is None and "usage" in found[1].error
        assert found[2].content == "y" and found[2].error is None and found[2].usage.total_tokens == 3


TICKS = [(0, 10), (200_000, 10), (2_000_000, 20), (7_000_000, 5), (20_000_000, 5)]


def ticks_of(rows, data):
    """Ticks from (sample, seq, micros, chars)."""
    frame = rows(data, "sample_index long, seq long, micros long, content_delta_chars int")
    base = 1_700_000_000_000_000
    return frame.select(
        "sample_index", "seq", F.timestamp_micros(F.lit(base) + F.col("micros")).alias("ts"),
        "content_delta_chars", F.lit(0).alias("reasoning_delta_chars"),
    )


def test_live_rate_of_known_ticks(rows):
    data = [(1, i, micros, chars) for i, (micros, chars) in enumerate(TICKS)] + [(1, 9, 7_500_000, 0)]
    for slice_windows in (1, 3, 100):
        found = live_rate(ticks_of(rows, data), slice_windows=slice_windows).orderBy("micros").collect()
        assert [r.chars_per_sec for r in found] == [0, 0, 20, 5, 5]
        assert [r.chars for r in found] == [10, 20, 40, 45, 50]


def brute_force(data, span=5_000_000):
    """The rule tick by tick, in plain Python."""
    state, out = {}, {}
    for sample, seq, micros, chars in sorted(data, key=lambda t: (t[2], t[1])):
        if chars == 0:
            continue
        total_chars, rate, window = state.get(sample, (0, 0, []))
        window = [(t, n) for t, n in [*window, (micros, chars)] if micros - t <= span]
        seconds = (micros - window[0][0]) / 1e6
        if len(window) >= 2 and seconds > 0.3:
            rate = int(sum(n for _, n in window) / seconds)
        state[sample] = (total_chars + chars, rate, window)
        out[(sample, seq)] = (total_chars + chars, rate)
    return out


def random_ticks(seed):
    """Most ticks belong to one sample, with ties and gaps."""
    dice = random.Random(seed)
    return [
        (1 if dice.random() < 0.7 else dice.randrange(2, 6), i, dice.randrange(0, 120) * 250_000, dice.randrange(0, 9))
        for i in range(1500)
    ]


def rated(frame):
    return {(r.sample_index, r.seq): (r.chars, r.chars_per_sec) for r in frame.collect()}


@pytest.mark.parametrize("slice_windows", [1, 2, 50])
def test_live_rate_equals_brute_force(rows, slice_windows):
    data = random_ticks(slice_windows)
    assert rated(live_rate(ticks_of(rows, data), slice_windows=slice_windows)) == brute_force(data)


def test_live_rate_stream_equals_brute_force(spark, rows):
    data = sorted(random_ticks(3), key=lambda t: (t[2], t[1]))
    edges = [0, 400, 401, 1000, len(data)]
    cuts = [data[a:b] for a, b in zip(edges, edges[1:])]
    stream = stream_of(spark, [ticks_of(rows, cut) for cut in cuts])
    assert rated(_drain(live_rate_stream(stream), "rates")) == brute_force(data)


def test_finished_request_starts_afresh(spark, rows):
    first = ticks_of(rows, [(1, 0, 0, 5), (1, 1, 1_000_000, 5)]).withColumn("finished", F.col("seq") == 1)
    second = ticks_of(rows, [(1, 2, 2_000_000, 7)]).withColumn("finished", F.lit(None).cast("boolean"))
    found = rated(_drain(live_rate_stream(stream_of(spark, [first, second])), "fresh"))
    assert found == {(1, 0): (5, 0), (1, 1): (10, 10), (1, 2): (7, 0)}


def test_an_empty_tick_finishes_a_request(spark, rows):
    def part(data):
        return ticks_of(rows, [d[:4] for d in data]).join(
            rows([(d[1], d[4]) for d in data], "seq long, finished boolean"), "seq"
        ).select("sample_index", "seq", "ts", "content_delta_chars", "reasoning_delta_chars", "finished")

    first = part([(1, 0, 0, 5, False), (1, 1, 1_000_000, 5, False)])
    second = part([(1, 2, 2_000_000, 0, True)])
    third = part([(1, 3, 3_000_000, 7, False), (1, 4, 4_000_000, 0, True), (1, 5, 5_000_000, 3, False)])
    stream = stream_of(spark, [first, second, third])
    assert rated(_drain(live_rate_stream(stream), "empty-finish")) == {
        (1, 0): (5, 0), (1, 1): (10, 10), (1, 3): (7, 0), (1, 5): (3, 0),
    }
    states = _drain(request_states(stream_of(spark, [first, second])), "finished-states")
    assert active_states(states).count() == 0


def test_ticks_without_a_place_or_a_part(spark, rows):
    ticks = rows(
        [(1, 0, 0, 5, None), (1, 1, 1_000_000, None, 5), (1, 2, 2_000_000, None, None), (1, 3, None, 9, 9), (1, None, 2_500_000, 9, 9), (None, 4, 0, 9, 9), (1, 5, 3_000_000, 3, 2)],
        "sample_index long, seq long, micros long, content_delta_chars int, reasoning_delta_chars int",
    ).withColumn("ts", F.timestamp_micros(F.col("micros") + 1_700_000_000_000_000)).drop("micros")
    expected = {(1, 0): (5, 0), (1, 1): (10, 10), (1, 5): (15, 5)}
    assert rated(live_rate(ticks)) == expected
    listed = ticks.collect()
    frames = [rows(listed[:4], ticks.schema), rows(listed[4:], ticks.schema)]
    assert rated(_drain(live_rate_stream(stream_of(spark, frames)), "placed")) == expected
    assert unplaced_ticks(ticks).count() == 3


def test_listing_of_active_samples_by_batches(spark, rows):
    def part(data):
        base = 1_700_000_000
        return rows(data, "sample_index long, seq long, second long, content_delta_chars int, finished boolean").select(
            "sample_index", "seq", F.timestamp_seconds(F.col("second") + base).alias("ts"), "content_delta_chars",
            F.lit(0).alias("reasoning_delta_chars"), "finished",
        )

    frames = [
        part([(1, 0, 0, 5, False), (2, 0, 0, 7, False), (3, 0, 0, 1, False), (3, 1, 1, 0, True)]),
        part([(1, 1, 2, 5, False), (2, 1, 2, 0, True)]),
        part([(4, 0, 5, 2, False), (2, 2, 6, 3, False), (3, 2, 6, 0, True)]),
    ]
    folder, kept = scratch_path(spark, "listing"), []
    merge = merge_active(folder)

    def twice(states, batch):
        # A batch that is run again changes nothing.
        merge(states, batch)
        once = sorted(map(tuple, spark.read.parquet(f"{folder}/{batch}").collect()))
        merge(states, batch)
        assert sorted(map(tuple, spark.read.parquet(f"{folder}/{batch}").collect())) == once
        kept.append(once)

    stream = request_states(stream_of(spark, frames), last_only=True)
    progress = scratch_path(spark, "listing-progress")
    writer = stream.writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", progress).trigger(availableNow=True)
    with state_settings(spark):
        query = writer.start()
    query.awaitTermination()
    assert kept[:3] == [[(1, 5, 0), (2, 7, 0)], [(1, 10, 5)], [(1, 10, 5), (2, 3, 0), (4, 2, 0)]]
    # State is kept of the active samples and of no others.
    with state_settings(spark):
        for name, column in (("head", "key"), ("ring", "key")):
            state = spark.read.format("statestore").option("path", progress).option("stateVarName", name).load()
            assert {r[0].sample_index for r in state.select(column).collect()} == {1, 2, 4}, name


def test_idle_requests_leave_the_listing(spark, rows):
    frames = [ticks_of(rows, [(1, 0, 0, 5)]), ticks_of(rows, [(2, 1, 20_000_000_000, 4)]), ticks_of(rows, [(2, 2, 20_001_000_000, 4)])]
    folder = scratch_path(spark, "idle-listing")
    stream = request_states(stream_of(spark, frames), late="1 minute", idle="1 hour", last_only=True)
    last = _drain_batches(stream, "idle-listing", "update", merge_active(folder))
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/{last}").collect()] == [(2, 8, 8 // 1)]


def test_active_requests(rows):
    rates = rows([(1, 0, 5, 3, 1), (1, 1, 6, 9, 2), (2, 0, 1, 4, 0)], "sample_index long, seq long, micros long, chars long, chars_per_sec long")
    finished = rows([(2,)], "sample_index long")
    assert [tuple(r) for r in active_requests(rates, finished).collect()] == [(1, 9, 2)]


def test_running_totals(rows):
    data = [(1, 10, 5, 6, "#1 F1=1.00"), (2, 30, None, None, "#2 ERR"), (3, 20, 1, 1, "#3 F1=0.50")]
    schema = "sample_index long, finished_at long, prompt_tokens long, completion_tokens long, label string"
    row = running_totals(rows(data, schema)).first()
    assert tuple(row) == (3, 6, 7, "#2 ERR", 4)
    nothing = running_totals(rows([], schema)).first()
    assert (nothing.completed, nothing.average_tokens, nothing.last_finished) == (0, 0, None)


class Store:
    """A state store of one key that counts the calls made to it."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def variable(self, name, *schemas):
        store = self

        class Variable:
            def __getattr__(self, call):
                store.calls += 1
                held = store.held
                return {
                    "get": lambda: iter(held.get(name, [])) if name == "pieces" else held.get(name),
                    "exists": lambda: name in held,
                    "update": lambda value: held.update({name: value}),
                    "appendList": lambda rows: held.setdefault(name, []).extend(rows),
                    "clear": lambda: held.pop(name, None),
                    "iterator": lambda: iter(held.get(name, {}).items()),
                    "updateValue": lambda key, value: held.setdefault(name, {}).update({key: value}),
                    "removeKey": lambda key: held[name].pop(key),
                }[call]

        return Variable()

    getListState = getValueState = getMapState = variable

    def registerTimer(self, at):
        self.calls += 1


class Times:
    def getCurrentWatermarkInMs(self):
        return 0


def test_a_sample_takes_few_calls_to_the_state_store():
    """Rows go to the state without data frames, and a sample that comes whole writes no pieces."""
    line = Row("seq", "done", "bad", "content", "reasoning", "usage", "millis")
    lines = [line(0, False, False, "a", "", None, 5), line(1, False, False, "b", "r", [1, 2, 3, None, None, None], None), line(2, True, False, "", "", None, 7)]
    whole, parted = Store(), Store()
    processor = _Assembler(1000)
    processor.init(whole)
    (told,) = processor.handleInputRows((1,), iter(lines), Times())
    assert (told.content, told.reasoning, told.total_tokens, told.error) == ("ab", "r", 3, None)
    assert whole.calls <= 3 and "pieces" not in whole.held
    processor.init(parted)
    assert not list(processor.handleInputRows((1,), iter([lines[2], lines[0]]), Times())) and parted.calls <= 4
    assert list(processor.handleInputRows((1,), iter(lines[1:]), Times())) == [told] and parted.calls <= 8
    assert "pieces" not in parted.held


def test_a_request_takes_few_calls_to_the_state_store():
    tick = Row("micros", "seq", "delta", "finished")
    store, processor = Store(), _Requests(5_000_000, 1000, False)
    processor.init(store)
    told = list(processor.handleInputRows((1,), iter([tick(1_000_000, 1, 5, False), tick(0, 0, 5, False), tick(2_000_000, 2, 0, True)]), Times()))
    assert [(r.chars, r.chars_per_sec) for r in told] == [(5, 0), (10, 10), (10, 10)] and store.calls == 1 and not store.held
    list(processor.handleInputRows((1,), iter([tick(3_000_000, 3, 5, False)]), Times()))
    assert store.calls <= 5
