"""Streams over the request log: endpoint statistics, deliveries per session, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KEYS = 5000


def with_event_time(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; tables hold TIMESTAMP_NTZ."""
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(log: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return with_event_time(log).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(log: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return with_event_time(log).withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_windows(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return with_event_time(log).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def late_dedup(log: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return with_event_time(log).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def deliveries(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stateful: session, key -> session, key, already_returned. A session's keys are cleared when one more than MOST_KEYS was added; with ttl_ms, for streams that run on, sessions end by time-to-live, as a global count of sessions is no keyed state."""
    from pyspark.sql.streaming import StatefulProcessor

    class Seen(StatefulProcessor):
        def init(self, handle):
            self.keys = handle.getMapState("keys", "key string", "n int", ttlDurationMs=ttl_ms)
            self.held = handle.getValueState("held", "n int", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            held = self.held.get()[0] if self.held.exists() else 0
            for pdf in rows:
                out = []
                for k in pdf["key"]:
                    again = self.keys.exists() and self.keys.containsKey((k,))
                    if not again:
                        self.keys.updateValue((k,), (1,))
                        held += 1
                        if held > MOST_KEYS:
                            self.keys.clear()
                            held = 0
                    out.append((key[0], k, again))
                self.held.update((held,))
                yield pd.DataFrame(out, columns=["session", "key", "already_returned"])

        def close(self):
            pass

    return log.groupBy("session").transformWithStateInPandas(Seen(), "session string, key string, already_returned boolean", "append", "processingTime" if ttl_ms else "none")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is now, into a table in memory."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
