"""Responses assembled from event-stream lines (sample_index, seq, line)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokentide.functions.chat import (
    BAD_USAGE, DONE, bad_chunk_usage, chunk_deltas, chunk_text, chunk_usage, parsed_chunk, stream_data,
)
from tokentide.session import ship_package

USAGE_FIELDS = (
    "prompt_tokens", "completion_tokens", "total_tokens",
    "cache_hit_tokens", "cache_miss_tokens", "reasoning_tokens",
)
_SEGMENT = 4096  # lines of one sample that are joined in one group


def placed_lines(lines: DataFrame) -> DataFrame:
    """The lines that name their sample and their place in it; no others take part."""
    return lines.where("sample_index IS NOT NULL AND seq IS NOT NULL")


def unplaced_lines(lines: DataFrame) -> DataFrame:
    """The lines that take no part, for a table or a stream of their own."""
    return lines.where("sample_index IS NULL OR seq IS NULL")


def parse_lines(lines: DataFrame, *kept: str) -> DataFrame:
    """(sample_index, seq, done, content, reasoning, usage, bad) of each line, and ``kept`` columns."""
    parsed = lines.withColumn("_data", stream_data(F.col("line"))).withColumn(
        "_chunk", parsed_chunk(F.col("_data"))
    )
    chunk = F.col("_chunk")
    return parsed.select(
        "sample_index",
        "seq",
        *kept,
        F.coalesce(F.col("_data") == DONE, F.lit(False)).alias("done"),
        chunk_text(chunk, "content").alias("content"),
        chunk_text(chunk, "reasoning_content").alias("reasoning"),
        chunk_usage(chunk).alias("usage"),
        bad_chunk_usage(chunk).alias("bad"),
    )


def ticks_from_lines(lines: DataFrame) -> DataFrame:
    """Ticks of the lines (sample_index, seq, ts, line) of streams, for the live rate.

    (sample_index, seq, ts, content_delta_chars, reasoning_delta_chars, finished): one tick
    for each line with characters, those of all its choices, and one without characters that
    finishes the request for each end marker. The same for a table and for a stream.
    """
    parsed = placed_lines(lines).withColumn("_data", stream_data(F.col("line"))).withColumn(
        "_deltas", chunk_deltas(parsed_chunk(F.col("_data")))
    )
    zero = F.lit(0).cast("long")

    def chars(name: str) -> Column:
        summed = F.aggregate("_deltas", zero, lambda sum_, one: sum_ + one[name])
        return F.coalesce(summed, zero).alias(name)

    done = F.coalesce(F.col("_data") == DONE, F.lit(False))
    ticked = parsed.select(
        "sample_index", "seq", "ts", chars("content_delta_chars"), chars("reasoning_delta_chars"), done.alias("finished")
    )
    return ticked.where("content_delta_chars + reasoning_delta_chars > 0 OR finished")


def _joined(pieces: str, name: str) -> Column:
    """One text field of sorted pieces, joined."""
    return F.array_join(F.transform(pieces, lambda piece: piece[name]), "")


def _last_usage(pieces: str | Column) -> Column:
    return F.get(pieces, F.size(pieces) - 1)["usage"]


def assemble(lines: DataFrame) -> DataFrame:
    """(sample_index, content, reasoning, usage, error) of each sample's lines in seq order.

    The first end marker ends a sample, later lines are ignored; the usage is the last
    one before it; no reasoning text is null. Usage with a total but without its counts
    makes the sample an error without texts. Lines without a sample or a seq are ignored,
    see :func:`unplaced_lines`. A line that comes again counts once; where lines of one seq
    differ, the first by its parsed parts counts.

    Lines are joined in segments first, so a sample with very many of them is spread over
    tasks, and only texts meet again.
    """
    seq = F.col("seq")
    telling = F.col("done") | F.col("bad") | (F.col("content") != "") | (F.col("reasoning") != "") | F.col("usage").isNotNull()
    # A sample all of whose lines are silent is there all the same.
    line = F.when(telling, F.struct("seq", "done", "bad", "content", "reasoning", "usage"))
    gathered = (
        parse_lines(placed_lines(lines))
        .groupBy("sample_index", F.floor(seq / _SEGMENT).alias("segment"))
        .agg(F.sort_array(F.collect_list(line)).alias("sorted"))
    )
    once = F.filter("sorted", lambda one, at: (at == 0) | (one["seq"] != F.get("sorted", at - 1)["seq"]))
    marked = gathered.select("sample_index", "segment", once.alias("lines")).withColumns(
        {
            "end": F.get(F.filter("lines", lambda one: one["done"]), F.lit(0))["seq"],
            "bad": F.get(F.filter("lines", lambda one: one["bad"]), F.lit(0))["seq"],
        }
    )
    kept = F.filter("lines", lambda one: F.col("end").isNull() | (one["seq"] < F.col("end")))
    joined = marked.select("sample_index", "segment", "end", "bad", kept.alias("lines")).select(
        "sample_index",
        "segment",
        "end",
        "bad",
        _joined("lines", "content").alias("content"),
        _joined("lines", "reasoning").alias("reasoning"),
        _last_usage(F.filter("lines", lambda one: one["usage"].isNotNull())).alias("usage"),
    )
    samples = joined.groupBy("sample_index").agg(
        F.collect_list(F.struct("segment", "content", "reasoning", "usage")).alias("parts"),
        F.min(F.when(F.col("end").isNotNull(), F.col("segment"))).alias("last"),
        (F.min("bad") < F.coalesce(F.min("end"), F.lit((1 << 63) - 1))).alias("bad"),
    )
    kept = F.filter("parts", lambda part: F.col("last").isNull() | (part["segment"] <= F.col("last")))
    ordered = samples.select("sample_index", "bad", F.sort_array(kept).alias("parts"))
    good = ~F.coalesce("bad", F.lit(False))
    return ordered.select(
        "sample_index",
        F.when(good, _joined("parts", "content")).alias("content"),
        F.when(good, F.nullif(_joined("parts", "reasoning"), F.lit(""))).alias("reasoning"),
        F.when(good, _last_usage(F.filter("parts", lambda part: part["usage"].isNotNull()))).alias("usage"),
        F.when(~good, F.lit(BAD_USAGE)).alias("error"),
    )


def as_responses(assembled: DataFrame) -> DataFrame:
    """Assembled samples, of the batch or the stream form, as responses to be scored.

    (row_id, content, reasoning, usage, error), as parsed response bodies give them.
    """
    usage = F.col("usage")
    if "usage" not in assembled.columns:
        usage = F.when(F.col("total_tokens").isNotNull(), F.struct(*USAGE_FIELDS)).alias("usage")
    return assembled.select(F.col("sample_index").alias("row_id"), "content", "reasoning", usage, "error")


_USAGE_COLUMNS = ", ".join(f"{name} long" for name in USAGE_FIELDS)
_OUTPUT = f"sample_index long, content string, reasoning string, {_USAGE_COLUMNS}, error string"
_PIECE = "seq long, content string, reasoning string"
_HEAD = "seen array<long>, end long, bad long, usage_seq long, usage array<long>, finished boolean, latest long"


def _see(seen: list[int], seq: int) -> bool:
    """Whether ``seq`` is new to ``seen``, the flat ranges [start, end, ...) it is then added to."""
    at = bisect_right(seen, seq)
    if at % 2:
        return False
    joins_left, joins_right = at > 0 and seen[at - 1] == seq, at < len(seen) and seen[at] == seq + 1
    if joins_left and joins_right:
        del seen[at - 1 : at + 1]
    elif joins_left:
        seen[at - 1] = seq + 1
    elif joins_right:
        seen[at] = seq
    else:
        seen[at:at] = [seq, seq + 1]
    return True


class _Assembler(StatefulProcessor):
    """Pieces of text of a sample as a list that is only appended to, beside a head of a few numbers.

    Each call to the state store takes longer than a line, so there are few: pieces that complete
    a sample are told without being written.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", _PIECE)
        self.head = handle.getValueState("head", _HEAD)

    def _told(self, key: tuple, head: tuple, pieces: Iterable[tuple]) -> Row:
        """The sample as far as its lines have come."""
        _, end, bad, _, usage, _, _ = head
        good = bad is None or (end is not None and bad > end)
        kept = sorted(piece for piece in pieces if end is None or piece[0] < end) if good else []
        row = {
            "sample_index": key[0],
            "content": "".join(content for _, content, _ in kept) if good else None,
            "reasoning": "".join(reasoning for _, _, reasoning in kept) or None if good else None,
        }
        row.update(dict(zip(USAGE_FIELDS, usage if usage and good else [None] * len(USAGE_FIELDS))))
        return Row(**row, error=None if good else BAD_USAGE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.head.get()
        known = held is not None
        seen, end, bad, usage_seq, usage, finished, latest = held if known else ([], None, None, None, [], False, 0)
        seen, usage, new = list(seen), list(usage or []), []
        latest = max(latest, timerValues.getCurrentWatermarkInMs())
        for row in rows:
            # A line without a time is a line like others; it only tells nothing of the time.
            latest = max(latest, row.millis or 0)
            seq = row.seq
            if finished or not _see(seen, seq):
                continue
            if row.done:
                end = seq if end is None else min(end, seq)
            if row.bad:
                bad = seq if bad is None else min(bad, seq)
            if row.content or row.reasoning:
                new.append((seq, row.content, row.reasoning))
            if row.usage is not None and (usage_seq is None or seq > usage_seq) and (end is None or seq < end):
                usage_seq, usage = seq, list(row.usage)
        head = (seen, end, bad, usage_seq, usage, finished, latest)
        if not finished and end is not None and seen[:1] == [0] and seen[1] > end:
            yield self._told(key, head, [*self.pieces.get(), *new] if known else new)
            if known:
                self.pieces.clear()
            head = ([], None, None, None, [], True, latest)
        elif new:
            self.pieces.appendList(new)
        self.head.update(head)
        if not known:
            self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        head = self.head.get()
        if head[-1] + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(head[-1] + self.idle_ms)  # lines have come since it was set
            return
        if not head[-2]:
            yield self._told(key, head, self.pieces.get())
        self.pieces.clear()
        self.head.clear()


def assemble_stream(lines: DataFrame, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """Streaming form of :func:`assemble`: a sample is emitted once it is complete.

    Lines also carry their event time ``ts``. ``seq`` numbers the lines of a sample from
    0, so a sample is complete when the end marker and all lines before it have arrived,
    in whatever order; a line that comes again is ignored, and of lines of one seq that differ
    the first to come counts. A sample whose last line lies more than ``idle`` behind the
    watermark is emitted as it is. A sample that was emitted leaves a mark for ``idle``, so that
    lines after its end do not begin it anew. Lines without a sample or a seq are ignored; a line
    without a time is taken.

    JSON is parsed by Spark; the state appends pieces of text and never writes one again. It
    needs the state store of :data:`tokentide.session.STATE_SETTINGS` when the query starts.
    """
    ship_package(lines.sparkSession)
    pieces = parse_lines(placed_lines(lines).withWatermark("ts", late), "ts")
    usage = F.when(
        F.col("usage").isNotNull(), F.array(*[F.col(f"usage.{name}") for name in USAGE_FIELDS])
    )
    return (
        pieces.withColumn("usage", usage)
        .withColumn("millis", F.unix_millis("ts"))
        .drop("ts")
        .groupBy("sample_index")
        .transformWithState(
            _Assembler(int(pd.Timedelta(idle).total_seconds() * 1000)), _OUTPUT, "append", "EventTime"
        )
    )
