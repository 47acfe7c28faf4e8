"""Decisions as state of a streaming query: what was decided first of a name counts for later rows too, also after a restart, until it hasn't been seen for long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "scope string, name string, ts timestamp, ord long, type string, state string"


class DecisionProcessor(StatefulProcessor):
    """Rows (scope, name, ts, ord, type) of one name of a scope. State: the type and when it was last seen, in milliseconds; a timer drops it when nothing has been seen for `ttl` of event time."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "type string, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "ord", "type"])
        kind, seen = self.first.get() if self.first.exists() else (None, None)
        out = []
        for r in frame.itertuples():
            now = r.ts.value // 1_000_000
            fresh = kind is None or now - seen > self.ttl
            kind, seen = (r.type if fresh else kind), now if fresh else max(now, seen)
            out.append((*key, r.ts, r.ord, kind, "new" if fresh else "kept"))
        self.first.update((kind, int(seen)))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(seen) + self.ttl)
        yield pd.DataFrame(out, columns=["scope", "name", "ts", "ord", "type", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, seen = self.first.get()
        self.first.clear()
        yield pd.DataFrame([(*key, pd.Timestamp(seen, unit="ms"), None, kind, "expired")], columns=["scope", "name", "ts", "ord", "type", "state"])

    def close(self) -> None:
        pass


def first_decisions(found: DataFrame, ttl: str = "90 days", late: str = "1 day") -> DataFrame:
    """Streaming rows (scope, name, ts, ord, type) with the type that counts: the first of a name in its scope, as long as the name is seen again within ttl (of event time). state: new, kept, or a
    row of its own when a decision expired. Rows later than the watermark are left out."""
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = found.select(F.col("scope").cast("string").alias("scope"), F.col("name").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("ord").cast("long").alias("ord"), "type")
    keyed = rows.where("ts is not null and name is not null").withWatermark("ts", late).groupBy("scope", "name")
    return keyed.transformWithStateInPandas(DecisionProcessor(ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run_once(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Runs a streaming query over all that there is now, into Parquet; the next call goes on from there. State lives in the checkpoint, so lost executors and restarts lose nothing."""
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
