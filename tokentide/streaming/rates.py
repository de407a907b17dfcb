"""Live output rate per request from ticks.

Ticks are rows (sample_index, seq, ts, content_delta_chars, reasoning_delta_chars).
The rate after a tick is the characters of the trailing window divided by the time
since its first tick, cut to an integer. It needs two ticks more than 0.3 s apart and
otherwise stays as it was, 0 at first. A tick exactly one window old still counts, and
ticks without characters are ignored. A null delta is 0. Ticks without a sample, a time or a
seq have no place in a request: they take no part, and :func:`unplaced_ticks` gives them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokentide.session import materialize, ship_package

# The trailing window and the least time a rate is taken over, in seconds.
WINDOW_SECONDS = 5.0
LEAST_SECONDS = 0.3


def _delta() -> Column:
    parts = [F.coalesce(name, F.lit(0)).cast("long") for name in ("content_delta_chars", "reasoning_delta_chars")]
    return parts[0] + parts[1]


_PLACED = "sample_index IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL"


def unplaced_ticks(ticks: DataFrame) -> DataFrame:
    """The ticks that take no part, for a table or a stream of their own."""
    return ticks.where(f"NOT ({_PLACED})")


def _counted(ticks: DataFrame) -> DataFrame:
    return ticks.where(_PLACED).withColumn("delta", _delta()).where(F.col("delta") > 0)


def live_rate(
    ticks: DataFrame, window_seconds: float = WINDOW_SECONDS, slice_windows: int = 100
) -> DataFrame:
    """(sample_index, seq, micros, chars, chars_per_sec) after every tick.

    Each sample's time line is cut into slices of ``slice_windows`` windows, with the
    last window of a slice repeated in the next one, so a sample with very many ticks
    is spread over tasks. One row per sample and slice carries the characters so far
    and the last rate into later slices.
    """
    span = int(window_seconds * 1_000_000)
    width = span * slice_windows
    micros = F.unix_micros("ts")
    own = F.col("micros") - F.pmod("micros", F.lit(width))
    nearly_over = F.col("micros") >= own + width - span
    cut = (
        _counted(ticks)
        .select("sample_index", "seq", micros.alias("micros"), "delta")
        .withColumn("own", own)
        .withColumn(
            "slice",
            F.explode(
                F.when(nearly_over, F.array(F.col("own"), F.col("own") + width)).otherwise(F.array("own"))
            ),
        )
    )
    # A range frame would visit every tick of a window again for every tick. Instead each
    # tick sends a mark to the instant its window opens; marks and ticks sort together,
    # and running sums tell the mark what came before it. Marks keep the order of their
    # ticks, so the n-th mark belongs to the n-th tick.
    events = cut.repartition("sample_index", "slice").withColumn(
        "event",
        F.explode(
            F.array(
                F.struct(F.col("micros").alias("at"), F.lit(1).alias("tick")),
                F.struct((F.col("micros") - span).alias("at"), F.lit(0).alias("tick")),
            )
        ),
    ).select("sample_index", "slice", "seq", "own", "delta", "event.*")
    part = W.partitionBy("sample_index", "slice")
    onward = part.orderBy("at", "tick", "seq").rowsBetween(W.unboundedPreceding, 0)
    back = part.orderBy(F.desc("at"), F.desc("tick"), F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    is_tick = F.col("tick") == 1
    summed = (
        events.withColumn("running", F.sum(F.col("delta") * F.col("tick")).over(onward))
        .withColumn("place", F.sum("tick").over(onward))
        .withColumn("number", F.when(is_tick, F.col("place")).otherwise(F.sum(1 - F.col("tick")).over(onward)))
        .withColumn("next", F.last(F.when(is_tick, F.col("at")), ignorenulls=True).over(back))
    )

    def of_tick(name: str, alias: str | None = None) -> Column:
        return F.max(F.when(is_tick, F.col(name))).alias(alias or name)

    def of_mark(name: str, alias: str) -> Column:
        return F.max(F.when(~is_tick, F.col(name))).alias(alias)

    windowed = (
        summed.groupBy("sample_index", "slice", "number")
        .agg(
            of_tick("seq"), of_tick("own"), of_tick("delta"), of_tick("running"), of_tick("at", "micros"),
            of_mark("running", "_before"), of_mark("place", "_earlier"), of_mark("next", "_first"),
        )
        .where(F.col("slice") == F.col("own"))
    )
    seconds = (F.col("micros") - F.col("_first")) / 1_000_000
    moving = (F.col("number") > F.col("_earlier") + 1) & (seconds > LEAST_SECONDS)
    rate = F.floor((F.col("running") - F.col("_before")) / seconds)
    # Read twice below, so the sorts are not repeated.
    rated = materialize(
        windowed.select(
            "sample_index", "seq", "micros", "slice", "number", "delta", F.when(moving, rate).alias("rate")
        ),
        "rates",
    )
    slices = rated.groupBy("sample_index", "slice").agg(
        F.sum("delta").alias("_chars"),
        F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("number"))).alias("_rate"),
    )
    earlier = W.partitionBy("sample_index").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(
        "sample_index",
        "slice",
        F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_chars"),
        F.last("_rate", ignorenulls=True).over(earlier).alias("_rate"),
    )
    so_far = part.orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    return rated.join(carried, ["sample_index", "slice"]).select(
        "sample_index",
        "seq",
        "micros",
        (F.col("_chars") + F.sum("delta").over(so_far)).alias("chars"),
        F.coalesce(F.last("rate", ignorenulls=True).over(so_far), "_rate", F.lit(0)).alias("chars_per_sec"),
    )


_OUTPUT = (
    "sample_index long, seq long, micros long, chars long, chars_per_sec long, delta long, finished boolean"
)


_told_row = Row(*[field.split()[0] for field in _OUTPUT.split(", ")])


class _Requests(StatefulProcessor):
    """The ticks of a request's last window by their time, beside its characters and rate.

    A micro-batch reads the window of a request once and writes the times that came or went.
    """

    def __init__(self, span: int, idle_ms: int, last_only: bool) -> None:
        self.span, self.idle_ms, self.last_only = span, idle_ms, last_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "micros long", "chars long, ticks long")
        self.head = handle.getValueState("head", "chars long, rate long, latest long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        saved = self.head.get()
        known = saved is not None
        chars, rate, latest = saved if known else (0, 0, 0)
        before = {at[0]: tuple(value) for at, value in self.ring.iterator()} if known else {}
        ring = dict(sorted(before.items()))  # stays in the order of time, as ticks never go back
        held, ticks = (sum(value[i] for value in ring.values()) for i in (0, 1))
        new = sorted((row.micros, row.seq, row.delta, row.finished) for row in rows)
        told, alive = [], known
        for micros, seq, delta, finished in new:
            if delta > 0:
                alive = True
                now = max(micros, latest)
                latest, chars, held, ticks = now, chars + delta, held + delta, ticks + 1
                sum_, count = ring.get(now, (0, 0))
                ring[now] = (sum_ + delta, count + 1)
                first = next(iter(ring))
                while now - first > self.span:
                    gone, count = ring.pop(first)
                    held, ticks = held - gone, ticks - count
                    first = next(iter(ring))
                seconds = (now - first) / 1_000_000
                if ticks >= 2 and seconds > LEAST_SECONDS:
                    rate = int(held / seconds)
            told.append((key[0], seq, micros, chars, rate, delta, finished))
            if finished:
                chars, rate, latest, held, ticks, alive = 0, 0, 0, 0, 0, False
                ring = {}
        if alive:
            for at in before.keys() - ring.keys():
                self.ring.removeKey((at,))
            for at, value in ring.items():
                if before.get(at) != value:
                    self.ring.updateValue((at,), value)
            self.head.update((chars, rate, latest))
            if not known:  # a known request has its timer
                self.handle.registerTimer(max(latest // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        elif known:
            self._forget()
        yield from (_told_row(*one) for one in (told[-1:] if self.last_only else told))

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.ring.clear()
        self.head.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        chars, rate, latest = self.head.get()
        if latest // 1000 + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(latest // 1000 + self.idle_ms)  # ticks have come since it was set
            return
        self.ring.clear()
        self.head.clear()
        if self.last_only:
            yield _told_row(key[0], None, latest, chars, rate, 0, True)


def request_states(
    ticks: DataFrame,
    window_seconds: float = WINDOW_SECONDS,
    late: str = "10 minutes",
    idle: str = "1 hour",
    last_only: bool = False,
) -> DataFrame:
    """State of a request after each tick that has characters or finishes it, of a stream.

    (sample_index, seq, micros, chars, chars_per_sec, delta, finished). A tick whose
    optional boolean column ``finished`` is true ends its request, with characters or
    without; the next tick of that sample begins a new one. State is dropped then, or when
    event time passes ``idle`` beyond the last tick. A tick older than one already seen
    counts at the newer time, as it would on arrival.

    With ``last_only`` there is one row for each request and micro-batch, its last state, and a
    request dropped for being idle is told as finished, without a seq. The query needs the
    state store of :data:`tokentide.session.STATE_SETTINGS` when it starts.
    """
    ship_package(ticks.sparkSession)
    processor = _Requests(int(window_seconds * 1_000_000), int(pd.Timedelta(idle).total_seconds() * 1000), last_only)
    finished = F.col("finished") if "finished" in ticks.columns else F.lit(False)
    marked = ticks.where(_PLACED).withColumns({"delta": _delta(), "finished": F.coalesce(finished, F.lit(False))})
    return (
        marked.where("delta > 0 OR finished")
        .withWatermark("ts", late)
        .select("sample_index", "seq", "ts", F.unix_micros("ts").alias("micros"), "delta", "finished")
        .groupBy("sample_index")
        .transformWithState(processor, _OUTPUT, "append" if not last_only else "update", "EventTime")
    )


def live_rate_stream(
    ticks: DataFrame,
    window_seconds: float = WINDOW_SECONDS,
    late: str = "10 minutes",
    idle: str = "1 hour",
) -> DataFrame:
    """Streaming form of :func:`live_rate`, with requests that may finish and begin again."""
    states = request_states(ticks, window_seconds, late, idle).where("delta > 0")
    return states.select("sample_index", "seq", "micros", "chars", "chars_per_sec")


def active_states(states: DataFrame) -> DataFrame:
    """Characters and rate of each sample whose latest state, of a table of states, is not a finish."""
    latest = states.groupBy("sample_index").agg(
        F.max_by(F.struct("chars", "chars_per_sec", "finished"), F.struct("micros", "seq")).alias("r")
    )
    return latest.where("NOT r.finished").select("sample_index", "r.chars", "r.chars_per_sec")


def merge_active(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of :func:`request_states` with ``last_only``: the listing of active samples.

    Batch n writes the listing after it as the table ``folder``/n: the listing of batch n - 1
    without the samples of this batch, and those of them that go on. A batch that is run again
    reads and writes the same tables, so it changes nothing. Listings before the last two are
    of no more use.
    """

    def merge(states: DataFrame, batch: int) -> None:
        spark = states.sparkSession
        now = materialize(states, "active-changes")
        going = now.where("NOT finished").select("sample_index", "chars", "chars_per_sec")
        if batch > 0:
            known = spark.read.schema(going.schema).parquet(f"{folder}/{batch - 1}")
            going = known.join(now.select("sample_index"), "sample_index", "left_anti").unionByName(going)
        going.write.mode("overwrite").parquet(f"{folder}/{batch}")

    return merge


def active_requests(rates: DataFrame, finished: DataFrame) -> DataFrame:
    """Characters and rate of each sample that has ticks and is not finished."""
    latest = rates.groupBy("sample_index").agg(
        F.max_by(F.struct("chars", "chars_per_sec"), F.struct("micros", "seq")).alias("r")
    )
    return latest.join(finished, "sample_index", "left_anti").select("sample_index", "r.*")
