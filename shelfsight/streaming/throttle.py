"""The info throttle as a stream: events wait, in order of time, until none before them can come any more."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..sources.scratch import written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Level of an event that only moves the watermark, so that what waits is given.
END = "end"
EPOCH = datetime(1970, 1, 1)


def _micros(t: datetime) -> int:
    gone = (t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t) - EPOCH
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


#: Rows of a page of waiting events, and arrived rows of a run that are held before they go to its pages.
PAGE, HELD = 1_000, 10_000


class Throttle(StatefulProcessor):
    """State of a run: `run`, which has the time of the last info event kept, the next timer and the first times of its pages, and `pages`, the info events that wait.

    A page has the events of a stretch of time, so that a run costs a few calls of the state store a page, not some an event. A run has one timer, at the end of the slot of
    time of its first waiting event: all that the watermark has passed is then handled in time order, of equal times the smallest event_id. `last`
    is dropped once an event that may still come is kept with or without it. A run with very many events holds a page or the newest arrivals in memory, never all that wait.
    """

    def __init__(self, schema: StructType, gap: int, slot: int, page: int = PAGE, held: int = HELD):
        self.schema, self.gap, self.slot, self.page, self.held = schema, gap, slot, page, held
        self.at, self.id, self.level = (schema.names.index(c) for c in ("at", "event_id", "level"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(*self.schema.names)
        self.run = handle.getValueState("run", StructType([StructField("last", LongType()), StructField("timer", LongType()), StructField("starts", ArrayType(LongType()))]))
        self.pages = handle.getMapState("pages", StructType([StructField("start", LongType())]), StructType([StructField("rows", BinaryType())]))

    def _state(self) -> tuple[int | None, int | None, list[int]]:
        last, timer, starts = self.run.get() or (None, None, [])
        return last, timer, list(starts)

    def _page(self, start: int) -> dict[int, tuple]:
        return {r[self.at]: r for r in pickle.loads(self.pages.getValue((start,))[0])}

    def _slot_end(self, at: int) -> int:
        return -(-(at // self.slot + 1) * self.slot // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived: dict[int, tuple] = {}
        for row in rows:
            at, level = row[self.at], row[self.level]
            if level == "info" and at is not None:
                if at not in arrived or row[self.id] < arrived[at][self.id]:
                    arrived[at] = tuple(row)
                if len(arrived) >= self.held:
                    self._wait(arrived)
                    arrived = {}
            elif level is not None and level != END:
                yield row
        if arrived:
            self._wait(arrived)

    def _wait(self, arrived: dict[int, tuple]) -> None:
        """Put rows, one a time, into the pages of their times; a page of over twice its size is split."""
        last, timer, starts = self._state()
        kept: list[int] = []
        times, i = sorted(arrived), 0
        for p in range(max(1, len(starts))):
            end = bisect_left(times, starts[p + 1], i) if p + 1 < len(starts) else len(times)
            if i == end:
                kept.append(starts[p])
                continue
            rows = self._page(starts[p]) if starts else {}
            for at in times[i:end]:
                if at not in rows or arrived[at][self.id] < rows[at][self.id]:
                    rows[at] = arrived[at]
            first = self._put(rows)
            if starts and starts[p] not in first:
                self.pages.removeKey((starts[p],))
            kept += first
            i = end
        self.run.update((last, self._timer(timer, self._slot_end(kept[0])), kept))

    def _put(self, rows: dict[int, tuple]) -> list[int]:
        """Store rows as pages and return their first times."""
        times = sorted(rows)
        size = self.page if len(times) > 2 * self.page else len(times)
        for i in range(0, len(times), size):
            self.pages.updateValue((times[i],), (pickle.dumps([rows[at] for at in times[i : i + size]]),))
        return times[::size]

    def _timer(self, timer: int | None, wanted: int) -> int:
        if timer is not None and timer <= wanted:
            return timer
        self.handle.registerTimer(wanted)
        return wanted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # later events come after it
        last, timer, starts = self._state()
        while starts and starts[0] <= passed:
            start, *starts = starts
            rows = self._page(start)
            self.pages.removeKey((start,))
            for at in sorted(rows):
                if at > passed:
                    starts = self._put({k: r for k, r in rows.items() if k > passed}) + starts
                    break
                if last is None or at >= last + self.gap:
                    last = at
                    yield self.row(*rows[at])
        if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
            timer = None
        if last is not None and last + self.gap <= passed:
            last = None
        if starts or last is not None:
            self.run.update((last, self._timer(timer, self._slot_end(starts[0]) if starts else -(-(last + self.gap) // 1000)), starts))
        else:
            self.run.clear()

    def close(self) -> None:
        pass


def _seconds(interval: str) -> float:
    n, unit = interval.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def throttled(events: DataFrame, *, gap_seconds: float = 2.0, late: str = "10 minutes") -> DataFrame:
    """Streaming form of `throttle_info`, with the same result for events that come less than `late` behind the newest, in whatever order and batches.

    Info events are given when the watermark has passed them, other levels at once, info events without a time too. An event of level "end" is not given; one far
    ahead in time, see `with_end`, brings out all that waits. events: event_id, run_id, ts, level, and any others.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the state that timers need
    timed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    slot = max(1000, int(_seconds(late) * 1e6 / 16) // 1000 * 1000)  # whole milliseconds, as timers are
    schema = timed.schema
    out = timed.groupBy("run_id").transformWithState(Throttle(schema, int(gap_seconds * 1e6), slot), schema, "append", "eventTime")
    return out.drop("at")


def with_end(events: DataFrame, spark: SparkSession) -> DataFrame:
    """A finite stream of events, with one of level "end" that moves the watermark past all others; for streams that are read in one batch."""
    row = spark.range(1).select(*[(F.lit(END) if f.name == "level" else F.lit("9999-01-01") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    path = written(row, "end").inputFiles()[0].rsplit("/", 1)[0]
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))
