"""Request statistics of a stream: counts, and the latest requests of each route, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from larkspur.functions.vector import floor_rank, nearest_rank

STATE = "route string, salt int, n long, errors long, us long, id long, ms double"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest_requests(log: DataFrame, last: int = 1000, salts: int = 8) -> DataFrame:
    """Stream of route, ts, id, ms, is_error -> STATE: after each batch, for each route and salt that had requests, all counts and its latest `last` requests by time, then id.

    A route's requests are dealt to `salts` states, so a busy route is no single task's. Late requests take their place by time.
    What is kept is bounded by routes, salts and `last`, so states don't end.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Latest(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getListState("held", "us long, id long, ms double")
            self.counts = handle.getValueState("counts", "n long, errors long")

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            n, errors = self.counts.get() if self.counts.exists() else (0, 0)
            held = pd.DataFrame(list(self.held.get()), columns=["us", "id", "ms"]) if self.held.exists() else None
            for pdf in rows:
                n, errors, own = n + len(pdf), errors + int(pdf["is_error"].sum()), pdf[["us", "id", "ms"]]
                held = (own if held is None else pd.concat([held, own])).sort_values(["us", "id"]).tail(last)
            self.counts.update((n, errors))
            self.held.put([(int(u), int(i), float(m)) for u, i, m in held.itertuples(index=False)])
            yield pd.DataFrame({"route": key[0], "salt": key[1], "n": n, "errors": errors, "us": held["us"].astype("int64"), "id": held["id"].astype("int64"), "ms": held["ms"].astype(float)})

        def close(self):
            pass

    rows = log.select("route", F.pmod(F.xxhash64("id", "ts"), F.lit(salts)).cast("int").alias("salt"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").cast("long").alias("id"), F.col("ms").cast("double").alias("ms"), F.coalesce("is_error", F.lit(False)).alias("is_error"))
    return rows.groupBy("route", "salt").transformWithStateInPandas(Latest(), STATE, "update", "none")


def run_to_files(stream: DataFrame, mode: str, path: str, trigger: dict | None = None) -> DataFrame:
    """Runs a stream over what there is now into Parquet files at path/rows, with the number of its batch; driver memory holds none of it. A batch that runs again replaces its files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(stream.schema.add("batch", IntegerType())).parquet(f"{path}/rows")


def stats_now(states: DataFrame, last: int = 1000) -> DataFrame:
    """The rows of evaluate.request_stats from what latest_requests has written: each state's last batch, put together by route."""
    newest = states.groupBy("route", "salt").agg(F.max("batch").alias("batch"))
    now = states.join(newest, ["route", "salt", "batch"])
    counts = now.groupBy("route", "salt").agg(F.max("n").alias("n"), F.max("errors").alias("errors")).groupBy("route").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    rn = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("us"), F.desc("id")))
    held = now.withColumn("rn", rn).filter(F.col("rn") <= last).groupBy("route").agg(F.sort_array(F.collect_list("ms")).alias("v"))
    v = F.col("v")
    return counts.join(held, "route").select("route", "n", "errors", nearest_rank(v, 50).alias("p50"), nearest_rank(v, 95).alias("p95"), floor_rank(v, 95).alias("p95_floor"), F.element_at("v", -1).alias("max_ms"))
