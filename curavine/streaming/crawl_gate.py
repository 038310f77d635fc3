"""Streams with state by key: which rows are news, and which visits a back-off lets through, with timers that end it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.files import exists

HOUR = 3_600_000_000  # microseconds


def with_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, which state with timers needs: what a task holds in memory doesn't grow with the number of keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class ByBatch:
    """A stream whose batches become rows of a schema as whole tables: rows(batch, number, folder), folder for what is kept between batches."""

    stream: DataFrame
    rows: Callable[[DataFrame, int, str], DataFrame]
    schema: StructType


def run_available(stream: DataFrame | ByBatch, folder: str, mode: str = "append") -> DataFrame:
    """Process what a stream has now, from where the run before in this folder has ended, and read all that it has put out.

    A batch that is handed over again after a failure writes in place of what it wrote before.
    """
    if isinstance(stream, ByBatch):
        spark, out = stream.stream.sparkSession, f"{folder}/out"
        write = lambda batch, number: stream.rows(batch, number, f"{folder}/kept").write.mode("overwrite").parquet(f"{out}/__batch={number}")
        started = stream.stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        started.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out).drop("__batch") if exists(spark, out) else spark.createDataFrame([], stream.schema)
    started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    started.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


class _News(StatefulProcessor):
    """The greatest time of a key, in microseconds. Rows of a batch are held against the mark from before the batch."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "micros bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.mark.get()[0] if self.mark.exists() else None
        top = before
        for pdf in rows:
            pdf.columns = self.columns  # names that start with "_" don't come through
            times = pdf["__micros"]
            if times.notna().any():
                top = int(times.max()) if top is None else max(top, int(times.max()))
            yield (pdf if before is None else pdf[times.isna() | (times > before)]).drop(columns="__micros")
        if top is not None and top != before:
            self.mark.update((top,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        top = initialState["micros"].max()
        if pd.notna(top):
            self.mark.update((int(top),))


def news(stream: DataFrame, key: str, time: str, marks: DataFrame | None = None, watermark: str = "watermark") -> DataFrame:
    """Rows that are later than their key's greatest time in the batches before; rows without a time always are.

    State has a timestamp for each key, which never expires. marks (key, watermark) are those to begin with. A row
    that comes too late to be news is left out however little it is late, as a key's mark is no event-time watermark.
    """
    with_state_store(stream.sparkSession)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begin = marks.select(key, micros(watermark).alias("micros")).groupBy(key) if marks is not None else None
    rows = stream.withColumn("__micros", micros(time))  # in pandas a column of floats if it has nulls: exact below 2 ** 53, to the year 2255
    return rows.groupBy(key).transformWithStateInPandas(_News(rows.columns), stream.schema, "Append", "None", begin)


class _BackOff(StatefulProcessor):
    """Failures of a key, and until when it is left alone; a timer ends that."""

    def __init__(self, key: str, hours: dict[str, float], default: float, by_clock: bool):
        self.key, self.hours, self.default, self.by_clock = key, hours, default, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures int, until bigint")

    def _known(self) -> tuple[int, int | None]:
        return self.state.get() if self.state.exists() else (0, None)

    def _wait(self, failures: int, until: int) -> None:
        self.state.update((failures, until))
        self.handle.registerTimer(-(-until // 1000))  # timers are whole milliseconds: not before the time

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[self.key, "visit", "kind", "at", "admitted", "failures", "until"])
        return out.astype({"visit": "Int64", "at": "Int64", "failures": "Int32", "until": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        failures, until = self._known()
        visits = pd.concat(list(rows)).sort_values(["at_time", "visit_id"])
        out = []
        for visit, at, ok, reason in zip(visits["visit_id"], visits["at_time"], visits["went_well"], visits["because"]):
            at = now if self.by_clock else int(at)
            if until is not None and at < until:
                out.append((key[0], visit, "visit", at, False, failures, until))
                continue
            if until is not None:
                self.handle.deleteTimer(-(-until // 1000))
            if ok:
                failures, until = 0, None
                self.state.update((failures, until))
            else:
                failures, until = failures + 1, at + int(self.hours.get(reason, self.default) * HOUR)
                self._wait(failures, until)
            out.append((key[0], visit, "visit", at, True, failures, until))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, until = self._known()
        if until is None or -(-until // 1000) != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.update((failures, None))
        yield self._frame([(key[0], None, "due", until, None, failures, None)])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        failures = int(first["failures"]) if pd.notna(first["failures"]) else 0
        if pd.notna(first["until_time"]):
            self._wait(failures, int(first["until_time"]))
        else:
            self.state.update((failures, None))


def back_off(stream: DataFrame, key: str, visit: str, time: str, ok: Column, reason: Column, hours: dict[str, float], default: float = 24,
             by_clock: bool = False, late: str = "0 seconds", states: DataFrame | None = None) -> DataFrame:
    """(key, visit, kind, at, admitted, failures, until) of visits to keys that are left alone after a failure.

    A visit before the end of its key's back-off isn't admitted and changes nothing. An admitted one clears the
    failures if it went well; else it adds one, and the key is left alone for so many hours, by the reason. Then a
    timer puts out a row of kind "due", which lets the key in again. Time is the rows' own, with timers that fire
    when all keys' rows have got so far, less what may be late; by_clock takes the clock's in place of it. states (key,
    failures, next_crawl_after) are those to begin with, one row for each key. visit is a whole number. Of a batch, a
    key's visits are taken by time and then by visit.
    """
    spark = stream.sparkSession
    with_state_store(spark)
    rows = stream.withColumn("__time", F.col(time).cast("timestamp"))
    rows = rows if by_clock else rows.withWatermark("__time", late)
    rows = rows.select(key, "__time", F.unix_micros("__time").alias("at_time"), F.col(visit).cast("long").alias("visit_id"), F.coalesce(ok, F.lit(False)).alias("went_well"), F.coalesce(reason, F.lit("")).alias("because"))
    begin = None
    if states is not None:
        begin = states.select(key, F.col("failures").cast("int").alias("failures"), F.unix_micros(F.col("next_crawl_after").cast("timestamp")).alias("until_time")).groupBy(key)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, visit bigint, kind string, at bigint, admitted boolean, failures int, until bigint"
    out = rows.groupBy(key).transformWithStateInPandas(_BackOff(key, hours, default, by_clock), schema, "Append", "ProcessingTime" if by_clock else "EventTime", begin)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "until")})
