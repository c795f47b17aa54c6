"""Queries over streams that read all there is and end, beside their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.plans.base import ORACLE_SQL, query, table
from larkspur.session import shared_dir
from larkspur.streaming.joins import followed
from larkspur.streaming.sessions import late_dedup, sliding
from larkspur.streaming.statistics import latest_requests, run_to_files, stats_now


def events(spark, sf):
    """The events as a stream."""
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def folder(spark, name):
    return f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"


PAIRS_SQL = "v AS (SELECT user_id, event_id AS first_id, ts AS first_ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id AS then_id, ts AS then_ts FROM events WHERE event_type = 'purchase'), j AS (SELECT v.user_id, first_id, first_ts, then_id FROM v LEFT JOIN p ON v.user_id = p.user_id AND then_ts BETWEEN first_ts AND first_ts + INTERVAL 12 HOUR)"


def _sides(e):
    side = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias("id"))
    return side("view"), side("purchase")


@query(f"WITH {PAIRS_SQL} SELECT user_id, first_id, then_id FROM j")
def views_followed(spark, sf):
    """What a user bought within 12 hours of a view, from tables."""
    return followed(*_sides(table(spark, sf, "events")), "user_id", "12 HOURS").select("user_id", "first_id", "then_id")


@query(f"WITH {PAIRS_SQL}, w AS (SELECT least((SELECT max(first_ts) FROM v), (SELECT max(then_ts) FROM p)) - INTERVAL 2 HOUR AS mark) SELECT user_id, first_id, then_id FROM j, w WHERE then_id IS NOT NULL OR first_ts + INTERVAL 12 HOUR < mark")
def stream_views_followed(spark, sf):
    """The same from two streams: a view that nothing followed comes when the watermark is past its time."""
    joined = followed(*_sides(events(spark, sf)), "user_id", "12 HOURS")
    return run_to_files(joined, "append", folder(spark, "followed")).select("user_id", "first_id", "then_id")


def _log(e):
    return e.select(F.col("event_type").alias("route"), "ts", F.col("event_id").alias("id"), F.col("value").alias("ms"), (F.col("event_id") % 9 == 0).alias("is_error"))


@query(ORACLE_SQL["endpoint_percentiles"])
def stream_request_stats(spark, sf):
    """endpoint_percentiles from a stream whose state is the last 1,000 requests of each route."""
    return stats_now(run_to_files(latest_requests(_log(events(spark, sf))), "update", folder(spark, "requests")))


@query("WITH e AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP), time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE]) AS start FROM events) SELECT start, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def sliding_windows(spark, sf):
    return sliding(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP) AS slot FROM events")
def stream_dedup(spark, sf):
    """Each user's first event of a type in six hours, from a stream that forgets what the watermark has passed."""
    slot = F.window(F.col("ts").cast("timestamp"), "6 hours")["start"].cast("timestamp_ntz")
    keyed = events(spark, sf).withColumn("slot", slot)
    return run_to_files(late_dedup(keyed, ["user_id", "event_type", "slot"]), "append", folder(spark, "dedup")).select("user_id", "event_type", "slot")
