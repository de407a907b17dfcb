"""Chat formatting of typed content parts, and reading the formatted text back.

A turn's content is an array of typed parts. Each part is visited by its kind: a text is
escaped, an image, audio or document part becomes a placeholder of that kind, and its
reference and expanded token count are recorded in the same order. Everything is column
expressions; a conversation is one row, as it is one training example.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokentide.llm.frames import column

START, END, PART, LINE = "<|im_start|>", "<|im_end|>", "<|part|>", "<|line|>"
PART_TYPE = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
# Kinds of attachments; any other kind that is not a text is refused.
ATTACHED = ("image", "audio", "document")
# An image costs a token per patch of so many pixels squared, audio so many tokens a second,
# a document so many a page. Missing measures count as one patch, second or page.
COSTS = {"patch": 28, "audio": 25, "page": 256}


def escape(text: Column) -> Column:
    """A text without ``<|``: every ``<`` before backslashes and a bar gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given: each such place loses one backslash."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """A text as an array of one part."""
    none = {"ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()],
        )
    )


def visit(part: Column) -> Column:
    """The formatted text of one part: an escaped text, or a placeholder of its kind."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    other = F.raise_error(F.concat(F.lit("unknown kind of part: "), kind)).cast("string")
    return (
        F.when(kind == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(kind.isin(*ATTACHED), F.concat(F.lit("<|"), kind, F.lit("|>")))
        .otherwise(other)
    )


def part_tokens(part: Column, costs: Mapping[str, int] = COSTS) -> Column:
    """Tokens that an attachment's placeholder stands for."""
    patches = lambda pixels: F.ceil(F.coalesce(pixels, F.lit(1)) / costs["patch"])
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * costs["audio"]))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * costs["page"])
        .cast("long")
    )


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    learned: str = "assistant",
    costs: Mapping[str, int] = COSTS,
) -> DataFrame:
    """One row per conversation: formatted text, spans under the loss, attachments and their tokens.

    ``parts`` is an array of structs with the fields of ``PART_TYPE``. spans holds
    (start, length) in code points of the content of each ``learned`` turn, in order;
    attachments holds (turn, kind, ref, tokens), in the order of the placeholders, turn
    being the position among the turns; tokens is their sum.

    Turns are in the order of their number, null first; turns of one number are in the
    order of role and content. Repeated rows are turns of their own. Null parts are an
    empty text; parts beside each other are kept apart by a mark, so a control string
    cannot form across them. A null role is the empty role. Rows of a null conversation
    are one conversation. Other input columns are left out. An empty table gives an
    empty result.
    """
    content = F.coalesce(column(parts), F.array().cast(f"array<{PART_TYPE}>"))
    attached = F.transform(
        F.filter(content, lambda p: p["kind"].isin(*ATTACHED)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p, costs).alias("tokens")),
    )
    named = F.coalesce(column(role), F.lit(""))
    rendered = turns.select(
        column(conversation).alias("_conversation"),
        F.struct(
            column(turn).alias("turn"),
            F.concat(F.lit(START), F.replace(escape(named), F.lit("\n"), F.lit(LINE)), F.lit("\n")).alias("head"),
            F.array_join(F.transform(content, visit), PART).alias("body"),
            (named == learned).alias("learned"),
            attached.alias("attached"),
        ).alias("_turn"),
    )
    # Running sums place the turns, so that long conversations cost no more a turn than short ones.
    tail = END + "\n"
    length = F.length("_turn.head") + F.length("_turn.body") + len(tail)
    fields = ["turn", "head", "body", "learned", "attached"]
    in_order = W.partitionBy("_conversation").orderBy(*[F.col(f"_turn.{name}") for name in fields])
    before = F.coalesce(F.sum(length).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = rendered.select(
        "_conversation", F.struct(before.alias("at"), *[F.col(f"_turn.{name}") for name in fields[1:]]).alias("_turn")
    )
    gathered = placed.groupBy("_conversation").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    spans = F.transform(
        F.filter("_turns", lambda t: t["learned"]),
        lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")),
    )
    attachments = F.flatten(
        F.transform(
            F.col("_turns"),
            lambda t, i: F.transform(
                t["attached"],
                lambda a: F.struct(
                    i.alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
                ),
            ),
        )
    )
    return gathered.select(
        F.col("_conversation").alias(conversation),
        F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        spans.alias("spans"),
        attachments.alias("attachments"),
    ).withColumn(
        "tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]),
    )


def read_parts(body: Column) -> Column:
    """Parts (kind, text) read from a turn's formatted content; attachments have no text."""
    kind = lambda piece: F.regexp_extract(piece, r"^<\|(\w+)\|>$", 1)
    return F.transform(
        F.split(body, r"<\|part\|>", -1),
        lambda piece: F.struct(
            F.when(kind(piece) == "", "text").otherwise(kind(piece)).alias("kind"),
            F.when(kind(piece) == "", unescape(piece)).alias("text"),
        ),
    )


def part_texts(body: Column) -> Column:
    """The texts of a turn's formatted content, joined."""
    return F.array_join(F.transform(read_parts(body), lambda part: F.coalesce(part["text"], F.lit(""))), "")


def read_spans(formatted: Column, spans: Column, block: int = 1 << 16) -> Column:
    """The pieces of a formatted conversation that its spans name, each cut from the blocks it lies in.

    A place in a text is found by counting from its beginning, which for all spans of a long
    conversation would be the square of its length.
    """
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def cut(own: Column, span: Column) -> Column:
        first, last = (F.floor(at / block).cast("int") for at in (span["start"], span["start"] + span["length"]))
        inside = F.array_join(F.slice(own, first + 1, last - first + 1), "")
        return F.substr(inside, span["start"] % block + 1, span["length"])

    # An array of one, so that the blocks are made once and not for each span.
    return F.flatten(F.transform(F.array(blocks), lambda own: F.transform(spans, lambda span: cut(own, span))))


def read_turns(formatted: Column) -> Column:
    """Turns (role, body) read from a formatted conversation; body is still formatted."""
    split = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(F.replace(F.substring_index(piece, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"),
            F.substring_index(_after_head(piece), END, 1).alias("body"),
        ),
    )


def _after_head(piece: Column) -> Column:
    return F.substr(piece, F.instr(piece, "\n") + 1)
