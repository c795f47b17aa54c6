"""SimHash near-duplicates: fingerprints of shingles, links by tiled exact comparison, components.

Fingerprints within the radius r agree in b - r of b blocks of bits, so distinct fingerprints are
compared within groups that share such blocks. b grows with their number, so a chance group stays
small. A group is sorted by population count and cut in tiles; a pair of tiles is compared by
exclusive-or and bit count, and skipped if the counts differ beyond the radius. All links come from
tiles. A group over SLAB fingerprints is first cut in slabs, ranges of the population count, and each
pair of slabs whose ranges lie within the radius is a unit of its own. A unit gives a spanning forest
of its links, never all of them; components follow from alternating star contractions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, column, free_names, mapped, slices

RADIUS = 3
#: Fingerprints of a tile, and pairs of tiles that are compared at once.
TILE, AT_ONCE = 64, 256
#: Fingerprints of a slab: bounds what a task holds to some MB, and a unit's comparisons.
SLAB = 1 << 14
#: Fingerprints that share their blocks by chance, at most, on average.
GROUP = 256
#: Rows that go, up to which their numbers are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """Lower-cases A-Z; words [^\\x20\\x09-\\x0D]+; a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # a very long text in portions
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs and a long column with each text's fingerprint (its 64 bits as a signed number); a null text has 0."""

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch):
                fps = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(fps)], [*rows.schema.names, name])

    return mapped(docs, run, [T.StructField(name, T.LongType())])


def masks(count: int, radius: int) -> list[int]:
    """Bit masks of the blocks that are compared for equality: fingerprints within the radius agree under one of them."""
    blocks = radius + 1
    while blocks < 16 and count >> (64 * (blocks - radius) // blocks) > GROUP:
        blocks += 1
    edges = [64 * n // blocks for n in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(each, blocks - radius)]


class Tiles:
    """Links among the fingerprints of units; counts the pairs of tiles that it compares and skips."""

    def __init__(self, radius: int = RADIUS, tile: int = TILE):
        self.radius, self.tile = radius, tile
        self.compared = self.skipped = 0

    def links(self, unit: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """unit (rising numbers) and fp, sorted by unit and population count -> a forest of the links, as stars (a, b)."""
        n, t = len(fp), self.tile
        # units stand further apart than any population counts
        key = unit.astype(np.int64) * 128 + np.bitwise_count(fp)
        lows, highs = key[::t], key[np.minimum(np.arange(t - 1, n + t - 1, t), n - 1)]
        until = np.searchsorted(lows, highs + self.radius, side="right")
        first = np.arange(len(lows))
        self.skipped += int((len(lows) - until).sum())
        room = len(lows) * t - n
        fp, key = np.append(fp, np.zeros(room, np.uint64)).reshape(-1, t), np.append(key, np.full(room, -(1 << 62))).reshape(-1, t)
        label = np.arange(fp.size)
        above = np.triu(np.ones((t, t), bool), 1)
        for away in range(int((until - first).max(initial=0))):
            a = first[first + away < until]
            for at in range(0, len(a), AT_ONCE):
                x = a[at : at + AT_ONCE]
                both = np.concatenate([label.reshape(-1, t)[x], label.reshape(-1, t)[x + away]], axis=1)
                x = x[(both != both[:, :1]).any(axis=1)]  # tiles of one component hold no further link
                self.compared += len(x)
                near = np.bitwise_count(fp[x][:, :, None] ^ fp[x + away][:, None, :]) <= self.radius
                near &= key[x][:, :, None] >> 7 == key[x + away][:, None, :] >> 7
                if not away:
                    near &= above
                k, i, j = np.nonzero(near)
                join(label, x[k] * t + i, (x[k] + away) * t + j)
        flat, tied = fp.reshape(-1)[:n], np.flatnonzero(label[:n] != np.arange(n))
        return flat[tied].view(np.int64), flat[label[tied]].view(np.int64)


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i and j in label, where each number has its component's smallest one."""
    while True:
        new = label[i] != label[j]
        i, j = i[new], j[new]
        if not len(i):
            return
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def units(fps: DataFrame, count: int, scratch: Scratch, radius: int = RADIUS, slab: int = SLAB) -> DataFrame:
    """Distinct fingerprints (fp) -> mask, value, i, j, ones, fp: a row for each unit that a fingerprint is compared in."""
    ones = F.bit_count("fp").cast("int").alias("ones")
    keyed = fps.select("fp", ones, F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("value")) for n, m in enumerate(masks(count, radius))])).alias("k")).select("fp", "ones", "k.*")
    group = ["mask", "value"]
    hot = scratch.stage(keyed.groupBy(*group).count().filter(F.col("count") > slab).select(*group), "hot")
    whole = keyed.select(*group, F.lit(0).alias("i"), F.lit(0).alias("j"), "ones", "fp")
    if hot.isEmpty():
        return whole
    # slabs of the hot groups: a population count over a slab is parted by hash
    counts = keyed.join(hot, group, "left_semi").groupBy(*group, "ones").count()
    before = F.sum("count").over(Window.partitionBy(*group).orderBy("ones")) - F.col("count")
    parts = scratch.stage(counts.select(*group, "ones", F.floor(before / slab).cast("int").alias("base"), F.ceil(F.col("count") / slab).cast("int").alias("parts")), "parts")
    spans = parts.select(*group, "ones", F.explode(F.sequence("base", F.col("base") + F.col("parts") - 1)).alias("own")).groupBy(*group, "own").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi"))
    lists = spans.groupBy(*group).agg(F.collect_list(F.struct("own", "lo", "hi")).alias("all"))  # a group's slabs, not its rows
    near = F.filter("all", lambda s: (s["lo"] <= F.col("hi") + radius) & (s["hi"] + radius >= F.col("lo")) & (s["own"] != F.col("own")))
    others = F.when(F.size("near") > 0, F.transform("near", lambda s: s["own"])).otherwise(F.array("own"))
    partners = scratch.stage(spans.join(lists, group).withColumn("near", near).select(*group, "own", others.alias("others")), "partners")
    placed = keyed.join(parts, [*group, "ones"]).withColumn("own", F.col("base") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = placed.join(partners, [*group, "own"]).withColumn("other", F.explode("others"))
    paired = paired.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "ones", "fp")
    return whole.join(hot, group, "left_anti").unionByName(paired)


def links(fps: DataFrame, count: int, scratch: Scratch, radius: int = RADIUS, tile: int = TILE, slab: int = SLAB) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all pairs within the radius, thinned to forests."""
    names = ["mask", "value", "i", "j"]

    def run(batches):
        tiles = Tiles(radius, tile)
        held: list[pa.RecordBatch] = []

        def compared(table: pa.Table):
            keys = [table.column(c).to_numpy() for c in names]
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            unit = np.concatenate([[0], np.cumsum(new)])
            a, b = tiles.links(unit, table.column("fp").to_numpy().view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def last(batch):
            return [batch.column(c)[batch.num_rows - 1].as_py() for c in names]

        for batch in batches:
            if not batch.num_rows:
                continue
            # whole units only: what is held waits for the end of its last unit
            keys = [batch.column(c).to_numpy() for c in names]
            if held and last(held[-1]) != [k[0].item() for k in keys] and sum(h.num_rows for h in held) > slab:
                yield compared(pa.Table.from_batches(held))
                held = []
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if len(ends) and sum(h.num_rows for h in held) + batch.num_rows > slab:
                cut = int(ends[-1]) + 1
                yield compared(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield compared(pa.Table.from_batches(held))

    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return units(fps, count, scratch, radius, slab).repartition(n, *names).sortWithinPartitions(*names, "ones").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) -> a row (node, root) for each node but the roots; the root is a component's smallest node.

    Alternating large-star and small-star contractions: each step keeps the components, and a fixed
    point is one star per component. A step's links and minima are written, so that the join with them is
    one of two scans, in which a hub's links can be split; earlier steps are deleted.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e, step):
        near = step.stage(both(e).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "near")
        return both(e).filter("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small(e, step):
        down = step.stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "down")
        near = step.stage(down.groupBy("a").agg(F.min("b").alias("m")), "near")
        linked = down.join(near, "a")
        return linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).distinct()

    step = Scratch(scratch.spark)
    e, mark = step.stage(edges.filter("a <> b"), "links"), None
    while True:
        following = Scratch(scratch.spark)
        e = following.stage(small(large(e, step), step), "links")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        step.drop()
        step = following
        if now.n == 0 or now == mark:
            scratch.adopt(step)
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def resolve(smallest: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """smallest (fp, low), a row per fingerprint -> fp, root (the component's smallest fingerprint), low."""
    smallest = scratch.stage(smallest, "fps")
    roots = components(links(smallest.select("fp"), smallest.count(), scratch, radius), scratch)
    return smallest.join(roots, smallest["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text; more columns are left out) -> doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have the fingerprint 0 and link like others; a text of any length is one
    fingerprint. Equal rows stay rows; a null doc_id never names a component that has other ids, and ties
    of ids don't matter. No rows, no result rows.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.stage(fingerprints(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "fp"), "narrow")
    named = scratch.stage(resolve(narrow.groupBy("fp").agg(F.min("doc_id").alias("low")), scratch, radius), "named")
    lowest = scratch.stage(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = scratch.stage(named.join(lowest, "root").select("fp", "component_id"), "components")
    scratch.drop(narrow, named)
    return narrow.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component one row, that with the smallest doc_id (null last), of several such the
    one whose text has the smallest hash, of equal ones any.

    Null and empty texts are near-duplicates of each other. All columns stay, whatever their names; texts of any
    length count whole; no rows, no result rows. Texts are written once and only shuffled where over BROADCAST_ROWS rows go.
    """
    scratch = Scratch(docs.sparkSession)
    fp, row, tie = free_names(docs, "fp", "row", "tie")
    marked = docs.withColumns({row: F.monotonically_increasing_id(), tie: F.xxhash64(F.col("text").cast("binary"))})
    marked = scratch.stage(fingerprints(marked, fp), "marked")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(tie).alias("tie"), F.col(row).alias("row"))
    named = resolve(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(own).alias("low")), scratch, radius)
    stay = named.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.row").alias(row))
    gone = scratch.stage(marked.select(row).join(stay, row, "left_anti"), "gone")
    scratch.drop(marked, gone)
    few = gone.count() <= BROADCAST_ROWS
    return marked.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*map(column, docs.columns))
