"""Timers of cases in a stream: armed, moved, cancelled, fired once. State and registered timers live in the RocksDB store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRED = "case string, armed_at timestamp, due_at timestamp"


class CaseTimers(StatefulProcessor):
    """One timer a case. What comes waits in state until the watermark has passed it, so that events count in the order of their times
    however they arrive; then an arming event moves the timer, a cancelling one ends it, and a timer that is due before the
    case's next event fires. A case is woken by timers registered for its events and for its due time; a batch that is run again
    finds the state as it was, so nothing fires twice.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "armed_us long, due_us long")
        self.waiting = handle.getListState("waiting", "at_us long, what string, delay_us long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at_us"], r["what"], r["delay_us"] or 0, r["n"]) for r in rows]
        self.waiting.appendList(new)
        for at in {-(-r[0] // 1000) for r in new}:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(r) for r in self.waiting.get())
        armed = tuple(self.armed.get()) if self.armed.exists() else None
        before, out = armed, []

        def fire(upto):
            nonlocal armed
            if armed and armed[1] <= upto:
                out.append((*key, armed[0], armed[1]))
                armed = None

        done = [e for e in events if e[0] <= now]
        for at, what, delay, n in sorted(done, key=lambda e: (e[0], e[3])):
            fire(at)
            if what == "arm":
                armed = (at, at + delay)
            elif what == "cancel":
                armed = None
        fire(now)
        if done:
            self.waiting.put([e for e in events if e[0] > now]) if len(done) < len(events) else self.waiting.clear()
        if armed is None:
            self.armed.clear()
        elif armed != before:
            self.armed.update(armed)
            self.handle.registerTimer(-(-armed[1] // 1000))
        for case, a, d in out:
            yield Row(case=case, armed_us=a, due_us=d)

    def close(self) -> None:
        pass


def fired_timers(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(case, armed_at, due_at) as a stream: the timers that fire. events: case, at, what (arm, cancel, else nothing), delay_s, n (the order of
    events of one time). The session must use the RocksDB store (see rocks)."""
    us = F.unix_micros("at")
    rows = events.withWatermark("at", late).select(F.col("case").cast("string").alias("case"), "at", us.alias("at_us"), "what", (F.col("delay_s").cast("long") * 1_000_000).alias("delay_us"), F.col("n").cast("long").alias("n"))
    schema = T.StructType([T.StructField("case", T.StringType()), T.StructField("armed_us", T.LongType()), T.StructField("due_us", T.LongType())])
    got = rows.groupBy("case").transformWithState(CaseTimers(), schema, "append", "EventTime")
    return got.select("case", F.timestamp_micros("armed_us").alias("armed_at"), F.timestamp_micros("due_us").alias("due_at"))


def rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def fired_of_table(events: DataFrame, until) -> DataFrame:
    """The same of a table of all events, as of a moment: a timer fires unless another arming or cancelling event of its case comes before."""
    own = events.where((F.col("what").isin("arm", "cancel")) & (F.col("at") <= until)).withColumn("case", F.col("case").cast("string"))
    following = F.lead("at").over(Window.partitionBy("case").orderBy("at", "n"))
    due = F.timestamp_micros(F.unix_micros("at") + (F.col("delay_s").cast("long") * 1_000_000))
    rows = own.withColumn("next", following).where("what = 'arm'").withColumn("due_at", due)
    return rows.where((F.col("due_at") <= until) & (F.col("next").isNull() | (F.col("next") >= F.col("due_at")))).select("case", F.col("at").alias("armed_at"), "due_at")
