"""Pipeline runs as a stream: runs that are going on are state, and a timer closes those that never report an end."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed: hours after which a run that is still going on counts as failed, and what is then said of it.
STALE_HOURS, STALE = 24, "Marked as stale - exceeded max running time"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "run_id string, pipeline string, started timestamp, finished timestamp, status string, error string"


def closed_runs(events: DataFrame, hours: float = STALE_HOURS, as_of: Column | None = None) -> DataFrame:
    """CLOSED rows of events (run_id, pipeline, status, ts), where status is running or how a run ended.

    A run starts at its first running event and ends at its first other event, with that status (ties: the smaller one);
    if the end comes over `hours` after the start, or not at all, it is failed and stale at that time. With `as_of`, only
    runs closed by then come out. Runs without a start are left out, as are events without a run or a time.
    """
    going = F.col("status") == "running"
    rows = events.where("run_id IS NOT NULL AND ts IS NOT NULL")
    runs = rows.groupBy("run_id").agg(F.min("pipeline").alias("pipeline"), F.min(F.when(going, F.col("ts"))).alias("started"), F.min(F.when(~going, F.struct("ts", "status"))).alias("end"))
    limit = F.col("started") + F.make_dt_interval(hours=F.lit(int(hours)), secs=F.lit(round(hours % 1 * 3600, 6)))
    stale = F.col("end").isNull() | (F.col("end.ts") > limit)
    out = runs.where("started IS NOT NULL").select(
        F.col("run_id").cast("string").alias("run_id"), "pipeline", "started", F.when(stale, limit).otherwise(F.col("end.ts")).alias("finished"),
        F.when(stale, "failed").otherwise(F.col("end.status")).alias("status"), F.when(stale, STALE).alias("error"),
    )
    return out if as_of is None else out.where(F.col("finished") <= as_of)


def _ms(ts: datetime) -> int:
    return round(ts.replace(tzinfo=UTC).timestamp() * 1000)


def _ts(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class Runs(StatefulProcessor):
    """A run's first start and first end so far, and one timer: at its end, or where it would be stale. When the watermark
    passes the timer, no event that could change the run can come any more: the run is given out and its state cleared."""

    def __init__(self, hours: float):
        self.limit = round(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "pipeline string, started long, finished long, status string, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        pipeline, started, finished, status, timer = self.run.get() or (None, None, None, None, None)
        for r in rows:
            at = _ms(r.ts)
            pipeline = min((p for p in (pipeline, r.pipeline) if p is not None), default=None)
            if r.status == "running":
                started = at if started is None else min(started, at)
            elif finished is None or (at, r.status) < (finished, status):
                finished, status = at, r.status
        due = min(x for x in (None if started is None else started + self.limit, finished if started is not None else None if finished is None else finished + self.limit) if x is not None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.run.update((pipeline, started, finished, status, due))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        pipeline, started, finished, status, _ = self.run.get()
        self.run.clear()
        if started is None:  # an end whose start never came
            return
        stale = finished is None or finished > started + self.limit
        end = started + self.limit if stale else finished
        yield Row(run_id=str(key[0]), pipeline=pipeline, started=_ts(started), finished=_ts(end), status="failed" if stale else status, error=STALE if stale else None)

    def close(self) -> None:
        pass


def stream_closed_runs(events: DataFrame, hours: float = STALE_HOURS, late: str = "10 minutes") -> DataFrame:
    """CLOSED rows of a stream of events (run_id, pipeline, status, ts), in append mode: what closed_runs() gives once the
    watermark has passed a run's end. Events later than the watermark are dropped, so a run whose end is that late is
    stale. Times are kept to the millisecond. The state of a run is one row and one timer, and goes when it is closed."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.where("run_id IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL").select(F.col("run_id").cast("string").alias("run_id"), "pipeline", "status", "ts")
    return rows.withWatermark("ts", late).groupBy("run_id").transformWithState(Runs(hours), CLOSED, "Append", "EventTime")
