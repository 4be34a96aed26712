"""Forecasts emitted at fixed times before schedule, from keyed streaming state.

The batch twin is `operators.asof`: select_at_horizons followed by with_revision.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lagline.operators.asof import EVENT, MAX_AGE_SECONDS, REVISION_LAG_SECONDS, SIGNAL_HORIZONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "received_ms bigint, snapshot_id string, cancelled boolean, delay double, bus_key string"
READ = ["received_ms", "scheduled_ms", "snapshot_id", "cancelled", "estimated_delay_seconds", "bus_key"]
OUTPUT = (
    "trip_key string, scheduled_stop_key string, scheduled_departure_raw string, horizon_minutes double, "
    "reason string, snapshot_id string, estimated_delay_seconds double, revision_reason string, "
    "revision_seconds double"
)
Forecast = Row(*[c.split(" ")[0] for c in OUTPUT.split(", ")])
HELD_ROWS = 256  # rows of one event in memory before they are cut to those that state needs


class HorizonForecasts(StatefulProcessor):
    """One timer at a time: the next cutoff, at last the moment that forgets the event, half an hour past its schedule.

    A pending forecast needs the last row at its cutoff and the last one a lag earlier, so
    state holds at most two rows per horizon however often the event is captured, in any
    order. Rows later than the forgetting time are ignored. Cutoffs that the watermark passes at
    once are judged in one call, so an event costs a call per batch that moves it, not one per horizon.
    """

    def __init__(self, horizons: list[float], max_age: float, lag: float, forget_minutes: float = 30):
        self.horizons, self.max_age, self.lag = sorted(map(float, horizons), reverse=True), max_age, lag
        self.forget_ms = int(forget_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(c.replace(" ", ": ") for c in KEPT.split(", "))
        self.event = handle.getValueState("event", f"scheduled_ms bigint, done array<double>, rows array<struct<{fields}>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        scheduled, done, kept = self._read()
        new = scheduled is None
        for row in rows:
            if row.received_ms <= row.scheduled_ms + self.forget_ms:
                scheduled = row.scheduled_ms
                kept.append((row.received_ms, row.snapshot_id, row.cancelled, row.estimated_delay_seconds, row.bus_key))
                if len(kept) >= HELD_ROWS:
                    kept = self._needed(scheduled, done, kept)
        if scheduled is not None:
            if new:
                self._wake(scheduled, done, timerValues.getCurrentWatermarkInMs())
            self._write(scheduled, done, kept)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        scheduled, done, rows = self._read()
        if scheduled is None:
            return iter([])
        expiry, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        passed = lambda moment: moment <= expiry or moment < watermark
        due = [h for h in self.horizons if h not in done and passed(self._cutoff(scheduled, h))]
        judged = [self._judge(key, rows, scheduled, h) for h in due]
        if passed(scheduled + self.forget_ms):
            self.event.clear()
        else:
            self._wake(scheduled, done + due, watermark)
            self._write(scheduled, done + due, rows)
        return iter(judged)

    def close(self) -> None:
        pass

    def _read(self):
        state = self.event.get()
        return (state[0], list(state[1]), [tuple(r) for r in state[2]]) if state else (None, [], [])

    def _wake(self, scheduled: int, done: list[float], watermark: int) -> None:
        pending = [self._cutoff(scheduled, h) for h in self.horizons if h not in done]
        self.handle.registerTimer(max(min([*pending, scheduled + self.forget_ms]), watermark + 1))

    def _write(self, scheduled: int, done: list[float], rows: list[tuple]) -> None:
        self.event.update((scheduled, done, sorted(self._needed(scheduled, done, rows), key=lambda r: (r[0], r[1]))))

    def _needed(self, scheduled: int, done: list[float], rows: list[tuple]) -> list[tuple]:
        """The rows that a pending cutoff, or the one a lag earlier, reads last."""
        lag = int(self.lag * 1000)
        cutoffs = [self._cutoff(scheduled, h) for h in self.horizons if h not in done]
        return list({self._last(rows, limit) for c in cutoffs for limit in (c, c - lag)} - {None})

    @staticmethod
    def _cutoff(scheduled: int, minutes: float) -> int:
        return scheduled - int(minutes * 60_000)

    @staticmethod
    def _last(rows: list[tuple], limit: float):
        return max((r for r in rows if r[0] <= limit), key=lambda r: (r[0], r[1]), default=None)

    def _judge(self, key, rows: list[tuple], scheduled: int, minutes: float) -> Row:
        cutoff = self._cutoff(scheduled, minutes)
        now = self._last(rows, cutoff)
        reason = revision = change = None
        if now is None:
            reason = "no_snapshot_before_cutoff"
        elif cutoff - now[0] > self.max_age * 1000:
            reason = "snapshot_stale"
        elif now[2]:
            reason = "cancelled_at_cutoff"
        elif now[3] is None:
            reason = "estimate_missing"
        if reason is None:
            revision, change = self._revise(rows, now, cutoff)
        usable = now if reason is None else (None,) * 5
        return Forecast(*key, float(minutes), reason, usable[1], usable[3], revision, change)

    def _revise(self, rows: list[tuple], now: tuple, cutoff: int):
        limit = cutoff - int(self.lag * 1000)
        old = self._last(rows, limit)
        if old is None:
            return "revision_history_missing", None
        if limit - old[0] > self.max_age * 1000:
            return "revision_history_stale", None
        if old[2] or old[3] is None:
            return "revision_history_unavailable", None
        if not now[4] or old[4] != now[4]:
            return "revision_bus_changed_or_missing", None
        if now[0] <= old[0]:
            return "revision_invalid_order", None
        return None, now[3] - old[3]


def horizon_forecasts(
    observations: DataFrame,
    horizons: list[float] = SIGNAL_HORIZONS,
    max_age_seconds: float = MAX_AGE_SECONDS,
    lag_seconds: float = REVISION_LAG_SECONDS,
    late: str = "2 minutes",
) -> DataFrame:
    """Stream of as-of forecasts per event and horizon; needs the RocksDB state store.

    Rows without a schedule or an event key have no cutoff and are left out, as in the
    batch twin. Rows more than `late` behind the newest receipt, or received over half an
    hour after their schedule, do not count; the query's progress reports the former as
    `numRowsDroppedByWatermark`.
    """
    millis = lambda c: F.floor(F.unix_micros(c) / 1000).cast("bigint")
    return (
        observations.withWatermark("received_at_utc", late)
        .withColumns({"received_ms": millis("received_at_utc"), "scheduled_ms": millis("scheduled_departure_utc")})
        .where(F.col("scheduled_ms").isNotNull() & F.greatest(*[F.col(c).isNull() for c in EVENT]).eqNullSafe(F.lit(False)))
        .select(*EVENT, "received_at_utc", *READ)
        .groupBy(*EVENT)
        .transformWithState(
            statefulProcessor=HorizonForecasts(horizons, max_age_seconds, lag_seconds),
            outputStructType=OUTPUT, outputMode="append", timeMode="EventTime",
        )
    )
