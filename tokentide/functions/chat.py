"""Chat requests, chat responses and response streams as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Request parameters and the response and stream formats.
MAX_OUTPUT_TOKENS = 393_216
TEMPERATURE = 0.0
DATA_PREFIX = "data: "
DONE = "[DONE]"
BAD_USAGE = "response usage is not valid"
# Required counts of a usage first, then those that are 0 where they are absent.
_NEEDED = ("prompt_tokens", "completion_tokens", "total_tokens")
_OPTIONAL = {
    "cache_hit_tokens": "$.prompt_cache_hit_tokens",
    "cache_miss_tokens": "$.prompt_cache_miss_tokens",
    "reasoning_tokens": "$.completion_tokens_details.reasoning_tokens",
}
MOST_COUNT = (1 << 32) - 1


def chat_request(
    prompt: Column, model: str, effort: str | None = None, stream: bool = False
) -> Column:
    """Request body as JSON; unset options are left out of it."""
    fields = [
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
        F.lit(TEMPERATURE).cast("float").alias("temperature"),
    ]
    if effort is not None:
        fields += [
            F.lit(effort).alias("reasoning_effort"),
            F.struct(F.lit("enabled").alias("type")).alias("thinking"),
        ]
    fields.append(F.lit(MAX_OUTPUT_TOKENS).alias("max_tokens"))
    if stream:
        fields.append(F.lit(True).alias("stream"))
    return F.to_json(F.struct(*fields))


def whole_json(text: Column) -> Column:
    """A JSON document as a variant; null unless the text is one document and nothing else.

    The parser stops after the first document and says nothing of what follows. So the text is
    the first of two elements, and the second, its own digest, which it cannot hold, must come
    next: a text that goes on after its document, or that closes the array itself, has
    something else there. Keys given twice, comments, bare words and single quotes are not JSON.
    """
    digest = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    return F.when(_get(both, "$[1]", "string") == digest, _get(both, "$[0]"))


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, VOID for a JSON null, and so on; null for what is absent."""
    return F.schema_of_variant(value)


def _is_object(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("OBJECT"))


def _text(value: Column, path: str) -> Column:
    """The text at a path, null for anything else."""
    found = _get(value, path)
    return F.when(_kind(found) == "STRING", _get(found, "$", "string"))


def _count(value: Column, path: str) -> Column:
    """The whole number from 0 to 2^32 - 1 at a path, null for anything else."""
    found = _get(value, path)
    number = F.when(_kind(found) == "BIGINT", _get(found, "$", "bigint"))
    return F.when(number.between(0, MOST_COUNT), number)


def _has(value: Column, path: str) -> Column:
    return _get(value, path).isNotNull()


def _is_null(value: Column, path: str) -> Column:
    return F.coalesce(_kind(_get(value, path)) == "VOID", F.lit(False))


def _usage(usage: Column) -> Column:
    """Flat counts of a usage object, absent optional ones as 0 and invalid ones as null."""
    details = "$.completion_tokens_details"
    needed = [_count(usage, f"$.{name}").alias(name) for name in _NEEDED]
    optional = [
        F.when(~_has(usage, path), F.lit(0).cast("long")).otherwise(_count(usage, path)).alias(name)
        for name, path in _OPTIONAL.items()
    ]
    inner = ~_has(usage, details) | _is_null(usage, details) | _is_object(_get(usage, details))
    flat = F.struct(*needed, *optional)
    valid = F.coalesce(_is_object(usage) & inner, F.lit(False))
    return F.when(valid, flat)


def _complete(usage: Column) -> Column:
    """Whether all counts of a flat usage are there."""
    found = F.lit(True)
    for name in [*_NEEDED, *_OPTIONAL]:
        found = found & usage[name].isNotNull()
    return F.coalesce(usage.isNotNull() & found, F.lit(False))


def parsed_response(body: Column) -> Column:
    """Response body as a struct, to be kept in a column of its own before reading it."""
    document = whole_json(body)
    return F.transform(
        F.array(document),
        lambda whole: F.struct(
            _is_object(whole).alias("readable"),
            _get(whole, "$.choices", "array<variant>").alias("choices"),
            _get(whole, "$.usage").alias("given"),
            _usage(_get(whole, "$.usage")).alias("usage"),
        ),
    )[0]


def read_response(status: Column, body: Column, parsed: Column) -> Column:
    """Struct of content, reasoning, usage and error of one parsed response.

    A status outside 200-299, a body that is not one JSON object, a content that is not a
    text, no choices, or usage with a count that is absent or no whole number gives an error
    and no content.
    """
    choices, usage = parsed["choices"], parsed["usage"]
    first = F.get(choices, F.lit(0))

    def well_formed(choice: Column) -> Column:
        message = _get(choice, "$.message")
        told = F.lit(True)
        for name in ("content", "reasoning_content"):
            kind = _kind(_get(message, f"$.{name}"))
            told = told & (kind.isNull() | kind.isin("STRING", "VOID"))
        return _is_object(choice) & (message.isNull() | (_is_object(message) & told))

    valid = F.coalesce(F.forall(choices, well_formed), F.lit(True))
    lacking = F.forall(F.slice(choices, 2, F.greatest(F.size(choices) - 1, F.lit(0))), lambda choice: _has(choice, "$.message"))
    given = F.coalesce(_kind(parsed["given"]) != "VOID", F.lit(False))
    refused = F.concat(
        F.lit("status "), status.cast("string"), F.lit(": "), F.coalesce(body, F.lit(""))
    )
    error = (
        F.when(status.isNull(), F.lit("no response"))
        .when(~status.between(200, 299), refused)
        .when(~F.coalesce(parsed["readable"], F.lit(False)), F.lit("response is not valid"))
        .when(~valid | ~F.coalesce(lacking, F.lit(True)), F.lit("response is not valid"))
        .when(first.isNull() | ~_has(first, "$.message"), F.lit("response has no choices"))
        .when(given & ~_complete(usage), F.lit(BAD_USAGE))
    )
    good = error.isNull()
    return F.struct(
        F.when(good, F.coalesce(_text(first, "$.message.content"), F.lit(""))).alias("content"),
        F.when(good, _text(first, "$.message.reasoning_content")).alias("reasoning"),
        F.when(good & given, usage).alias("usage"),
        error.alias("error"),
    )


def stream_data(line: Column) -> Column:
    """Payload of an event-stream line; null for a line without the data prefix."""
    clean = F.rtrim(line, F.lit("\r\n"))
    payload = F.substring(clean, F.lit(len(DATA_PREFIX) + 1), F.char_length(clean))
    return F.when(F.startswith(clean, F.lit(DATA_PREFIX)), payload)


def parsed_chunk(data: Column) -> Column:
    """Deltas and usage of a payload, to be kept in a column of its own before reading it.

    Null for the end marker and for anything that is not one JSON document; parts that are
    not of the expected kind count as absent.
    """
    deltas = lambda whole: F.transform(
        _get(whole, "$.choices", "array<variant>"),
        lambda choice: F.struct(
            *[F.coalesce(_text(choice, f"$.delta.{name}"), F.lit("")).alias(name) for name in ("content", "reasoning_content")]
        ),
    )
    parsed = F.transform(
        F.array(whole_json(F.when(data != DONE, data))),
        lambda whole: F.when(
            whole.isNotNull(),
            F.struct(
                deltas(whole).alias("deltas"),
                _usage(_get(whole, "$.usage")).alias("usage"),
                _positive(_get(whole, "$.usage")).alias("counts"),
            ),
        ),
    )
    return parsed[0]


def _positive(usage: Column) -> Column:
    """Whether a usage has a total above 0, however large; only such a usage counts."""
    total = _get(usage, "$.total_tokens")
    whole = _kind(total).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    return F.coalesce(whole & (_get(total, "$", "decimal(38,0)") > 0), F.lit(False))


def chunk_text(parsed: Column, name: str) -> Column:
    """``name`` of the deltas of all choices, joined in order."""
    return F.coalesce(F.array_join(F.transform(parsed["deltas"], lambda delta: delta[name]), ""), F.lit(""))


def chunk_deltas(parsed: Column) -> Column:
    """Characters of content and reasoning of every choice that has some, in order."""
    lengths = F.transform(
        parsed["deltas"],
        lambda delta: F.struct(
            F.char_length(delta["content"]).alias("content_delta_chars"),
            F.char_length(delta["reasoning_content"]).alias("reasoning_delta_chars"),
        ),
    )
    return F.filter(lengths, lambda one: one["content_delta_chars"] + one["reasoning_delta_chars"] > 0)


def chunk_usage(parsed: Column) -> Column:
    """Usage of a chunk, null unless its total is positive and its counts are valid."""
    return F.when(parsed["counts"] & _complete(parsed["usage"]), parsed["usage"])


def bad_chunk_usage(parsed: Column) -> Column:
    """Whether a chunk has usage with a positive total but without valid counts."""
    return F.coalesce(parsed["counts"] & ~_complete(parsed["usage"]), F.lit(False))
