"""Longest-processing-time sharding: groups that stay together, by size, to the least-loaded shard through a heap.

Groups of at least total / BIG bytes are placed one by one; there are at most BIG of them. Smaller ones
are first joined to bundles by their key's hash, at most BIG as well, so what the driver holds and what
is broadcast has at most 2 x BIG rows whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch

BIG = 8192
#: Parts of each shard for numbering its rows, at least; they grow with the shuffle's partitions.
PARTS = 512


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(key, size) -> shard; ties by key, so the result doesn't depend on the order."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, big: int = BIG) -> DataFrame:
    """docs (doc_id, text; more columns are left out) -> doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Rows of equal text share a shard; null texts are a group of their own, of size 1 each, empty ones another; a very long text is
    a group like others. Rows of equal or null id, repeated rows too, get slots of their own. No rows, no result rows.
    Texts are read once; what follows works on their sizes and hashes, written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    spark, text = docs.sparkSession, F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.stage(rows, "rows")
    groups = scratch.stage(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, total // big + 1)
    bundle = F.pmod(F.xxhash64("key"), F.lit(big))
    named = sorted((bytes(r.key), r.bytes) for r in groups.filter(F.col("bytes") >= least).collect())  # at most big rows
    bundles = groups.filter(F.col("bytes") < least).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()  # at most big rows
    place = longest_first([(r.bundle, r.bytes) for r in bundles] + [(big + n, b) for n, (_, b) in enumerate(named)], shards)
    own = spark.createDataFrame([(k, place[big + n]) for n, (k, _) in enumerate(named)], "key binary, own int")
    theirs = spark.createDataFrame([(r.bundle, place[r.bundle]) for r in bundles], "bundle long, theirs int")
    parts = max(PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.join(F.broadcast(own), "key", "left").withColumn("bundle", bundle).join(F.broadcast(theirs), "bundle", "left")
    # a part is some of the rows whatever their ids, so rows that are equal stay spread
    placed = placed.select("doc_id", "size", "text_crc32", "row", F.coalesce("own", "theirs").alias("shard"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    placed = scratch.stage(placed, "placed")
    counts = placed.groupBy("shard", "part").count()  # shards x parts rows
    before = scratch.stage(counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("base")), "before")
    scratch.drop(placed, before)
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    out = placed.withColumn("rn", number).join(F.broadcast(before), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
