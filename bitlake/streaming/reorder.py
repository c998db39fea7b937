"""Display order of a stream of coded pictures: the streaming twin of pictures.display_order, with a bounded buffer.

Rows are taken in order of seq, whatever the cut into micro-batches: one that comes early is held until those before it are there, or
until more than WINDOW are held, when what is missing is given up. A picture then waits until its group is complete, which the next
refresh picture shows, or until more than `depth` wait; then the one of the lowest (group, order count) goes out. A row with `last`
set is no picture: it ends its stream, and what waits goes out; so it does when a stream has had no row for `idle` milliseconds.
What the caller hands along with a picture (`meta`) comes out with it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Pictures that wait at most, by default, and rows that are held at most for one that is missing.
DEPTH, WINDOW = 16, 256
PLACE = "group_no long, shown long, next long"
HELD = "seq long, idr boolean, poc long, last boolean, meta string"
WAITING = "group_no long, poc long, seq long, meta string"
OUT = "stream_id long, seq long, group_no long, poc long, meta string, shown long, late boolean"
ERROR = ", error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Order(StatefulProcessor):
    """One stream's state: its place as a value, the rows held for a missing one and the pictures that wait as lists."""

    def __init__(self, depth: int, idle: int):
        self.depth, self.idle = max(1, depth), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place, self.held, self.waiting = handle.getValueState("place", PLACE), handle.getListState("held", HELD), handle.getListState("waiting", WAITING)

    def close(self) -> None:
        pass

    def load(self) -> None:
        self.group, self.shown, self.next = self.place.get() if self.place.exists() else (0, 0, 0)
        self.early = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self.heap = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        heapq.heapify(self.early)
        heapq.heapify(self.heap)
        self.out: list[tuple] = []

    def save(self) -> None:
        self.place.update((self.group, self.shown, self.next))
        for state, rows in ((self.held, self.early), (self.waiting, self.heap)):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def release(self) -> None:
        g, poc, seq, meta = heapq.heappop(self.heap)
        self.shown += 1
        self.out.append((seq, g, poc, meta, self.shown, False, None))

    def taken(self, idr: bool, poc: int, last: bool, seq: int, meta: str | None) -> None:
        """The next row of the stream."""
        self.next = seq + 1
        if last or idr:
            while self.heap:
                self.release()
        if not last:
            self.group += idr
            heapq.heappush(self.heap, (self.group, poc, seq, meta))
            while len(self.heap) > self.depth:
                self.release()

    def drain(self, everything: bool) -> None:
        while self.early and (everything or self.early[0][0] <= self.next or len(self.early) > WINDOW):
            seq, idr, poc, last, meta = heapq.heappop(self.early)
            if seq < self.next:  # a second row of one place
                self.out.append((seq, None, poc, meta, None, True, None))
            else:
                self.taken(idr, poc, last, seq, meta)

    def frames(self, key: tuple) -> Iterator[pd.DataFrame]:
        rows = [(key[0], *r) for r in self.out]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in (OUT + ERROR).split(", ")]).astype({"seq": "Int64", "group_no": "Int64", "poc": "Int64", "shown": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        for frame in rows:
            for r in frame.itertuples(index=False):
                meta, last = None if pd.isna(r.meta) else r.meta, not pd.isna(r.last) and bool(r.last)
                missing = [n for n, v in (("seq", r.seq), ("poc", 0 if last else r.poc)) if pd.isna(v)]
                if missing:
                    number = lambda v: None if pd.isna(v) else int(v)
                    self.out.append((number(r.seq), None, number(r.poc), meta, None, False, f"no {missing[0]}"))
                elif r.seq < self.next:
                    self.out.append((int(r.seq), None, None if last else int(r.poc), meta, None, True, None))
                else:
                    heapq.heappush(self.early, (int(r.seq), not pd.isna(r.idr) and bool(r.idr), 0 if pd.isna(r.poc) else int(r.poc), last, meta))
            self.drain(False)
        self.save()
        self.timed(timerValues.getCurrentProcessingTimeInMs() + self.idle if self.idle else None)
        yield from self.frames(key)

    def timed(self, at: int | None) -> None:
        """One timer a stream, at this time; those set before go."""
        for old in list(self.handle.listTimers()) if self.idle else []:
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.drain(True)
        while self.heap:
            self.release()
        self.save()
        yield from self.frames(key)


def prepared(spark: SparkSession) -> None:
    """The session's streaming queries that start from now on keep their state in RocksDB, which list states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_display_order(pictures: DataFrame, depth: int = DEPTH, idle: int = 0) -> DataFrame:
    """(stream_id, seq, group_no, poc, meta, shown, late, error) of a streaming DataFrame of (stream_id, seq, idr, poc, last, meta).

    seq counts a stream's rows from 0. shown numbers its pictures as they go out; a row whose place was passed, or taken by
    another row, is late: it goes out at once with late set and shown null. A row without seq, or a picture without poc, goes out as an error, and
    the stream goes on. Null meta stays null, null idr and last are false. With idle a stream that rests so long is flushed.
    """
    prepared(pictures.sparkSession)
    own = pictures.select("stream_id", "seq", "idr", "poc", "last", "meta")
    return own.groupBy("stream_id").transformWithStateInPandas(Order(depth, idle), OUT + ERROR, "Append", "ProcessingTime" if idle else "None")
