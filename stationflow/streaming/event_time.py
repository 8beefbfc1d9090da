"""Event-time state (T-S8): rows released in time order, late rows to a side output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def epoch_micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970; a timestamp without zone counts as UTC, so that no change of the clock reorders rows."""
    if dict(df.dtypes)[time] != "timestamp_ntz":
        return F.unix_micros(time)
    day = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    minutes = (F.hour(time) * 60 + F.minute(time)).cast("long") * 60_000_000
    return day + minutes + (F.expr(f"extract(SECOND FROM `{time}`)") * 1_000_000).cast("long")


def rolling_event_time(stream: DataFrame, station: str, time: str, tiebreak: tuple[str, ...], value: str, delay: str,
                       window: int = 48, min_periods: int = 24, out: str = "temp_rolling_48h", late: str = "late") -> DataFrame:
    """The mean of the last ``window`` rows per station, in the order of
    (``time``, ``tiebreak``) whatever the order of arrival.

    Rows wait in a list state until the watermark (the greatest time seen in the
    whole stream minus ``delay``) reaches them. An event-time timer then releases
    them in order, also in stations that get no more rows. A row at or before the
    time of the last row that its station released is late: it comes out at once,
    with ``late`` true and no mean, and enters no window; so does a row without a
    time. All other rows come out once with ``late`` false, and their means are
    those of the batch window over the released rows. Rows after the last
    watermark stay in the state for the next run with the same checkpoint.

    A station's state holds the rows of ``delay`` and ``window - 1`` values. Tie
    values that are NULL come first; a NULL station is a station. The watermark
    column is dropped before the state, or Spark would discard late rows unseen.
    Run it with :func:`run_split` (the state needs the RocksDB provider)."""
    rows = stream.withColumn("_us", epoch_micros(stream, time))
    rows = rows.withColumn("_clock", F.timestamp_micros("_us")).withWatermark("_clock", delay).drop("_clock")
    given = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    return rows.groupBy(station).transformWithState(
        ordered_rolling(f"{given}, `_us` bigint", tuple(tiebreak), value, window, max(1, min_periods), (out, late)),
        f"{given}, `{out}` double, `{late}` boolean", "append", "eventTime")


def ordered_rolling(schema: str, tiebreak: tuple[str, ...], value: str, window: int, min_periods: int,
                    added: tuple[str, str]):
    """The stateful processor of :func:`rolling_event_time`. The class is local,
    so that executors get its code with the query."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).names
    result = Row(*fields[:-1], *added)

    def order(row):
        return (row["_us"], *[(row[c] is not None, row[c] if row[c] is not None else 0) for c in tiebreak])

    class OrderedRolling(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", schema)
            self.tail = handle.getListState("tail", "value double")
            self.released = handle.getValueState("released", "us long")  # time of the last row released
            self.timer = handle.getValueState("timer", "ms long")  # the earliest timer that is set

        def handleInputRows(self, key, rows, timerValues):
            last = self.released.get()[0] if self.released.exists() else None
            keep, first = [], None
            for r in rows:
                us = r["_us"]
                if us is None or (last is not None and us <= last):
                    yield result(*r[:-1], None, True)
                else:
                    keep.append(tuple(r))
                    first = us if first is None else min(first, us)
            if keep:
                self.waiting.appendList(keep)
                self.wake(first)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.timer.exists() and self.timer.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
                self.timer.clear()
            reached = timerValues.getCurrentWatermarkInMs() * 1000
            ready, rest = [], []
            for t in self.waiting.get():
                r = dict(zip(fields, t))
                (ready if r["_us"] <= reached else rest).append((order(r), tuple(t), r[value]))
            if ready:
                ready.sort(key=lambda x: x[0])
                values = [x[0] for x in self.tail.get()] if self.tail.exists() else []
                for _, t, v in ready:
                    values.append(v)
                    seen = [x for x in values[-window:] if x is not None]
                    yield result(*t[:-1], sum(seen) / len(seen) if len(seen) >= min_periods else None, False)
                self.released.update((ready[-1][1][-1],))
                if window > 1:
                    self.tail.put([(x,) for x in values[1 - window:]])
                if rest:
                    self.waiting.put([t for _, t, _ in rest])
                else:
                    self.waiting.clear()
            if rest:
                self.wake(min(t[-1] for _, t, _ in rest))

        def wake(self, us):
            ms = -(-us // 1000)
            if not self.timer.exists() or ms < self.timer.get()[0]:
                self.handle.registerTimer(ms)
                self.timer.update((ms,))

        def close(self) -> None:
            pass

    return OrderedRolling()


def run_split(stream: DataFrame, flag: str, sink: str, side: str, checkpoint: str):
    """Drains the source once; rows whose ``flag`` is true go to ``side``, the
    others to ``sink``, both without it. A batch that is run again replaces its
    own folders."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for target, rows in ((sink, ~F.col(flag)), (side, F.col(flag))):
            batch.where(rows).drop(flag).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        batch.unpersist()

    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)
    q.awaitTermination()
    return q
