"""Requests, responses, scores and summaries."""

from __future__ import annotations

import json

import pytest

from tokentide.operators import evaluate
from tests.plans import plan_text
from tokentide.plans.jobs import evaluate_responses
from tokentide.session import materialize
from tokentide.sources.samples import as_samples, of_type

USAGE = {"prompt_tokens": 5, "completion_tokens": 7, "total_tokens": 12}


def body(content, usage=None, **message):
    value = {"choices": [{"message": {"content": content, **message}}], "other": 1}
    if usage is not None:
        value["usage"] = usage
    return json.dumps(value)


@pytest.fixture
def samples(rows):
    schema = "row_id long, prompt string, answer_nodes array<string>, problem_type string, input_tokens int"
    return as_samples(
        rows([(i, f"p{i}", ["a", "b"], "x" if i % 2 else "y", i) for i in range(5)], schema)
    )


@pytest.fixture
def responses(rows):
    return rows(
        [
            (0, 200, body("Final Answer: [a, b]", USAGE, reasoning_content="r")),
            (1, 200, body("Final Answer: [a]", USAGE)),
            (2, 429, "slow down"),
            (3, 200, body(None, USAGE)),
        ],
        "row_id long, status int, body string",
    )


def test_request_json(samples):
    plain = json.loads(evaluate.build_requests(samples, "m").where("row_id = 1").first().request)
    assert plain == {
        "model": "m", "messages": [{"role": "user", "content": "p1"}], "temperature": 0.0, "max_tokens": 393216,
    }
    full = json.loads(evaluate.build_requests(samples, "m", "high", stream=True).first().request)
    assert full["reasoning_effort"] == "high" and full["thinking"] == {"type": "enabled"} and full["stream"] is True


@pytest.mark.parametrize(
    "status, text, error",
    [
        (200, body("x"), None),
        (204, body("x"), None),
        (199, body("x"), "status 199"),
        (500, None, "status 500"),
        (None, body("x"), "no response"),
        (200, None, "not valid"),
        (200, "{nope", "not valid"),
        (200, "{}", "no choices"),
        (200, '{"choices": []}', "no choices"),
        (200, '{"choices": [{}]}', "no choices"),
        (200, body("x", {"prompt_tokens": 1, "total_tokens": 2}), "usage"),
        (200, body("x", {**USAGE, "prompt_tokens": "many"}), "not valid"),
        (200, body("x") + " trailing", "not valid"),
        (200, body("x") + body("y"), "not valid"),
        (200, "{'choices': [{'message': {'content': 'x'}}]}", "not valid"),
        (200, body(3), "not valid"),
        (200, body("x", reasoning_content=["y"]), "not valid"),
        (200, body("x") + ',"extra":1', "not valid"),
        (200, body("x")[:-1] + '},"body":' + body("EVIL"), "not valid"),
        (200, body("x") + "]", "not valid"),
        (200, body("x") + '] {"more": 1}', "not valid"),
        (200, " " + body("x") + "\n", None),
        (200, "[" + body("x") + "]", "not valid"),
        (200, '{"choices": [{"message": {"content": "x"}}, {}]}', "not valid"),
        (200, '{"choices": [{"message": {"content": "x"}}, {"message": {"content": 4}}]}', "not valid"),
        (200, '{"choices": [{"message": {"content": "x"}, "message": {"content": "y"}}]}', "not valid"),
        (200, body("x", {**USAGE, "total_tokens": 12.0}), "usage"),
        (200, body("x", {**USAGE, "total_tokens": -1}), "usage"),
        (200, body("x", {**USAGE, "prompt_cache_hit_tokens": None}), "usage"),
        (200, body("x", {**USAGE, "completion_tokens_details": None}), None),
        (200, body("x", 5), "usage"),
    ],
)
def test_response_errors(rows, status, text, error):
    frame = rows([(0, status, text)], "row_id long, status int, body string")
    row = evaluate.parse_responses(frame).first()
    assert (row.error is None) if error is None else (error in row.error and row.content is None)
    assert row.content == ("x" if error is None else None)


def test_usage_defaults(rows):
    details = {**USAGE, "prompt_cache_hit_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 4}}
    frame = rows([(0, 200, body("x", details)), (1, 200, body("x", USAGE)), (2, 200, body("x"))], "row_id long, status int, body string")
    found = {r.row_id: r.usage for r in evaluate.parse_responses(frame).collect()}
    assert tuple(found[0]) == (5, 7, 12, 3, 0, 4) and tuple(found[1]) == (5, 7, 12, 0, 0, 0) and found[2] is None


def test_results_and_summaries(samples, responses):
    sections = evaluate_responses(samples, responses)
    results = {r.row_id: r for r in sections["results"].collect()}
    assert [results[i].f1 for i in range(5)] == [1.0, pytest.approx(2 / 3), 0.0, 0.0, 0.0]
    assert results[0].predicted == ["a", "b"] and results[0].reasoning == "r"
    assert results[2].error == "status 429: slow down" and results[2].response == "" and results[2].recall == 0
    assert results[3].error is None and results[3].response == "" and results[3].precision == 1.0
    assert results[4].error == "no response"
    summary = sections["summary"].first()
    assert (summary.samples, summary.errors, summary.exact_matches) == (5, 2, 1)
    assert summary.exact_share == pytest.approx(100 / 3) and summary.mean_f1 == pytest.approx((1 + 2 / 3) / 3)
    assert [r.results for r in sections["f1_histogram"].orderBy("position").collect()] == [1, 0, 1, 0, 1]
    assert {r.problem_type: r.results for r in sections["f1_by_type"].collect()} == {"x": 2, "y": 1}
    usage = sections["usage"].first()
    assert (usage.completed, usage.prompt_tokens, usage.completion_tokens, usage.average_tokens) == (5, 15, 21, 7)
    assert [r.row_id for r in sections["defects"].collect()] == [1, 2, 3, 4]


def test_defects_only_up_to_the_limit(samples, responses):
    results = evaluate.score_responses(samples, evaluate.parse_responses(responses))
    assert evaluate.defects(results, most=4).count() == 4
    assert evaluate.defects(results, most=3).count() == 0
    assert [r.row_id for r in evaluate.defects(results).collect()] == [1, 2, 3, 4]


def test_a_capped_listing_orders_ids_alone(samples, responses):
    results = materialize(evaluate.score_responses(samples, evaluate.parse_responses(responses)))
    plan = plan_text(evaluate.defects(results, most=4))
    windows = [line for line in plan.splitlines() if "Window" in line or "TakeOrdered" in line or "GlobalLimit" in line]
    assert windows and all("response" not in line and "reasoning" not in line for line in windows)
    assert [r.response for r in evaluate.defects(results, most=4).collect()][0] == "Final Answer: [a]"


def test_one_result_per_sample(samples, rows):
    again = rows(
        [(0, 500, "busy"), (0, 200, body("Final Answer: [b]")), (0, 200, body("Final Answer: [a, b]")), (1, 500, "x"), (1, 429, "y")],
        "row_id long, status int, body string",
    )
    results = {r.row_id: r for r in evaluate.score_responses(samples, evaluate.parse_responses(again)).collect()}
    assert len(results) == 5 and results[0].predicted == ["a", "b"] and results[0].error is None
    assert results[1].error == "status 429: y"


def test_summaries_of_nothing(samples, responses):
    results = evaluate.score_responses(samples, evaluate.parse_responses(responses)).where("row_id < 0")
    row = evaluate.evaluation_summary(results).first()
    assert (row.samples, row.exact_share, row.mean_f1) == (0, 0.0, 0.0)
    usage = evaluate.usage_totals(results).first()
    assert (usage.completed, usage.average_tokens) == (0, 0)
    assert evaluate.defects(results).count() == 0


def test_type_filter_keeps_row_ids(samples):
    assert sorted(r.row_id for r in of_type(samples, "x").collect()) == [1, 3]
    assert of_type(samples).count() == 5
