"""Streams in several batches against their batch twins."""

import datetime
import random

from pyspark.sql import functions as F

from larkspur.operators.evaluate import request_stats
from larkspur.streaming.joins import followed
from larkspur.streaming.statistics import latest_requests, run_to_files, stats_now

START = datetime.datetime(2024, 1, 1)


def written(spark, tmp_path, rows, schema, parts):
    """rows in files of a folder, in their order, and a stream that takes a file at a time."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_views_and_purchases_over_many_batches(spark, tmp_path):
    """Pairs across batches are found, unmatched rows come once and only after the watermark, exactly those that the batch has."""
    rng = random.Random(2)
    rows = [(rng.randrange(4), START + datetime.timedelta(minutes=17 * n), rng.choice(["view", "purchase"]), n) for n in range(120)]
    rows += [(9, START + datetime.timedelta(days=9), kind, 1000 + k) for k, kind in enumerate(["view", "purchase"])]  # moves the watermark
    schema = "user_id long, ts timestamp, kind string, id long"
    stream, table = written(spark, tmp_path, rows, schema, 6), spark.createDataFrame(rows, schema)
    sides = lambda e: [e.filter(F.col("kind") == k).drop("kind") for k in ("view", "purchase")]
    pick = lambda df: sorted(str(tuple(r)) for r in df.filter("user_id < 9").select("user_id", "first_id", "then_id").collect())
    got = run_to_files(followed(*sides(stream), "user_id", "3 HOURS", late="30 minutes"), "append", f"file://{tmp_path}/out")
    want = pick(followed(*sides(table), "user_id", "3 HOURS"))
    assert pick(got) == want and any("None" in r for r in want) and len({r.batch for r in got.select("batch").collect()}) > 2
    brute = []
    for u, t, k, i in rows[:120]:
        if k == "view":
            near = [j for v, s, m, j in rows[:120] if m == "purchase" and v == u and t <= s <= t + datetime.timedelta(hours=3)]
            brute += [str((u, i, j)) for j in near or [None]]
    assert want == sorted(brute)


def test_request_statistics_over_many_batches(spark, tmp_path):
    """Late and equal times, several batches, more requests than are kept: as the batch has them after each batch."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b"]), START + datetime.timedelta(seconds=rng.randrange(200)), n, float(rng.randrange(1000)), rng.random() < 0.2) for n in range(400)]
    schema = "route string, ts timestamp, id long, ms double, is_error boolean"
    stream = written(spark, tmp_path, rows, schema, 4)
    states = run_to_files(latest_requests(stream, last=30, salts=3), "update", f"file://{tmp_path}/out")
    for upto in range(4):
        now = stats_now(states.filter(F.col("batch") <= upto), 30)
        want = request_stats(spark.createDataFrame(rows[: 100 * (upto + 1)], schema), 30)
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.select(now.columns).collect()))
    assert states.groupBy("batch", "route", "salt").count().agg(F.max("count")).first()[0] <= 30


def test_a_further_run_adds_nothing(spark, tmp_path):
    stream = written(spark, tmp_path, [(1,), (2,)], "x long", 2)
    first = run_to_files(stream, "append", f"file://{tmp_path}/out").collect()
    assert sorted(r.x for r in first) == [1, 2]
    # nothing new: a further run over the same state adds nothing
    assert sorted(map(tuple, run_to_files(stream, "append", f"file://{tmp_path}/out").collect())) == sorted(map(tuple, first))
