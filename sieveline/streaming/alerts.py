"""Alerts with a hold time on a stream: the runs of ``monitor.alert_runs``, as they come about.

Events are first counted by window and series, which Spark does partly before the shuffle, so a busy series costs no more than another; only finished windows reach
the state, one row for each window and series. The state of a series is one row: its last window and its open run. Windows finish in order, as the watermark passes them; events that come
later than the watermark allows are dropped by the count. An event-time timer stands at the end of the window after the last one: if it fires, that window had no
event, so a series that falls silent ends its run without waiting for its next event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from sieveline.streaming.monitor import watermarked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HoldAlerts(StatefulProcessor):
    """Rows ``by.., kind, run_start, run_end, n_windows, alerted`` of one series.

    ``raised`` when a run has lasted for ``hold`` windows, ``ended`` when it is over. A window without events counts as firing only if ``silent_fires`` (then a silent
    series goes on until events come).
    """

    def __init__(self, by: Sequence[str], step_ms: int, hold: int, silent_fires: bool = False):
        self.by, self.step, self.hold, self.silent_fires = list(by), step_ms, hold, silent_fires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "last long, start long, n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # windows that finish in one batch come in any order; those of later batches are later
        windows = sorted((r["start_ms"], r["firing"]) for r in rows)
        state = self._read()
        if state is not None:
            self.handle.deleteTimer(self._due(state[0]))
        for at, firing in windows:
            if state is None:
                state = (at - self.step, 0, 0)
            silent = (at - state[0]) // self.step - 1
            if silent > 0:
                state = yield from self._go(key, state, silent, self.silent_fires)
            state = yield from self._go(key, state, 1, firing)
        self._write(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._read()
        if state is None or expiredTimerInfo.getExpiryTimeInMs() != self._due(state[0]):
            return
        # all windows that the watermark has passed are over
        silent = max(1, (timerValues.getCurrentWatermarkInMs() - state[0]) // self.step - 1)
        state = yield from self._go(key, state, silent, self.silent_fires)
        if self.silent_fires:
            self._write(state)
        else:
            self.state.clear()  # the next window begins a series anew

    def _due(self, last: int) -> int:
        return last + 2 * self.step + 1

    def _read(self) -> tuple[int, int, int] | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def _write(self, state: tuple[int, int, int]) -> None:
        self.state.update(state)
        self.handle.registerTimer(self._due(state[0]))

    def _go(self, key, state, windows: int, firing: bool) -> Iterator[Row]:
        """The state after so many windows that are alike; gives what they raise and end."""
        last, start, n = state
        if firing:
            start = start if n else last + self.step
            if n < self.hold <= n + windows:
                yield self._row(key, "raised", start, self.hold)
            return last + windows * self.step, start, n + windows
        if n:
            yield self._row(key, "ended", start, n)
        return last + windows * self.step, 0, 0

    def _row(self, key, kind: str, start: int, n: int) -> Row:
        at = [datetime.fromtimestamp(ms / 1000, tz=timezone.utc) for ms in (start, start + (n - 1) * self.step)]
        return Row(**dict(zip(self.by, key)), kind=kind, run_start=at[0], run_end=at[1], n_windows=n, alerted=n >= self.hold)


def milliseconds(width: str) -> int:
    """Of a width such as ``5 minutes``."""
    n, unit = width.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")])


def alerts(events: DataFrame, width: str, by: Sequence[str], counts: dict[str, Column], firing: Column, hold: int, delay: str = "10 minutes", ts: str = "ts", silent_fires: bool = False) -> DataFrame:
    """The stream of alerts of each series of a stream of events: ``by.., kind, run_start, run_end, n_windows, alerted``.

    ``counts`` are aggregates of a window, and ``firing`` a condition on them (null: doesn't fire). Rows whose time is null belong to no window; a null in ``by`` is a
    series of its own.
    """
    fields = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in by)
    windows = watermarked(events, delay, ts).groupBy(F.window(ts, width).alias("w"), *by).agg(*[c.alias(name) for name, c in counts.items()])
    finished = windows.select(F.window_time("w").alias("at"), *by, F.unix_millis("w.start").alias("start_ms"), F.coalesce(firing, F.lit(False)).alias("firing"))
    return finished.groupBy(*by).transformWithState(
        HoldAlerts(by, milliseconds(width), hold, silent_fires),
        f"{fields}, kind string, run_start timestamp, run_end timestamp, n_windows long, alerted boolean",
        "append",
        "eventTime",
    )


def write_alerts(stream: DataFrame, path: str, checkpoint: str, configure: Callable = lambda writer: writer.trigger(availableNow=True)) -> StreamingQuery:
    """Alerts to parquet files, each written once; a query that is started again on its checkpoint goes on where it was.

    Keyed state with timers needs the RocksDB state store, which this query is started with.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return configure(stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)).start()
    finally:
        spark.conf.set(name, before)
