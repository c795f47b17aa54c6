"""Vectors in inverted lists: each stands in the list of its nearest centroid, and a search reads the lists near its query only.

Centroids are learnt on at most SAMPLE vectors, those with the least hashes of their ids; every vector is listed.
Lists are written in order, so a search reads their row groups. A list also has its radius, the widest angle between its
centroid and a member: what lies beyond it bounds the score of all that is in the list, so a search can be made certain.
How many lists another search needs depends on the vectors (clusters need few, noise needs most), so recall is measured at writing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import cosine, dot, norm

#: Vectors that centroids are learnt on, at most.
SAMPLE = 16384
#: Vectors of the sample that ask, and neighbours that each looks for, where recall is measured.
ASK, NEIGHBOURS = 64, 50
#: Lists, at most; they go to each task.
MOST_LISTS = 4096
#: Vectors and queries that one task compares, at most (a list's cut by hash is near that), and queries whose scores it holds at once.
SLICE, BLOCK, AT_ONCE = 1 << 15, 1 << 11, 64
#: Vectors that a task turns into a matrix at once where it learns or fills lists.
PASS = 1 << 11
#: The list of vectors without direction (null, of no length, holding null or NaN); each search reads it.
NOWHERE = -1


@dataclass
class VectorLists:
    rows: DataFrame  # list, doc_id, embedding
    centroids: DataFrame  # list, centroid, radius, n
    recall: DataFrame  # probes, recall

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession


def _matrix(vectors):
    """Arrow lists of numbers -> (matrix, lengths, widths); a vector that is null or holds null has width -1."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    width = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype("int64")
    flat, of = pc.list_flatten(vectors), pc.list_parent_indices(vectors).to_numpy()
    starts = np.concatenate([[0], np.cumsum(np.maximum(width, 0))])
    out = np.zeros((len(width), max(0, width.max(initial=0))))
    out[of, np.arange(len(of)) - starts[of]] = flat.cast("float64").to_numpy(zero_copy_only=False)
    holed = np.unique(of[flat.is_null().to_numpy(zero_copy_only=False)])
    out[holed], width[holed] = 0.0, -1
    with np.errstate(all="ignore"):
        return out, np.sqrt((out * out).sum(1)), width


def _cosines(a, b):
    """Of each pair of two _matrix results: (cosines, whether there is one)."""
    import numpy as np

    (x, nx, wx), (y, ny, wy) = a, b
    both = min(x.shape[1], y.shape[1])
    with np.errstate(all="ignore"):
        size = nx[:, None] * ny
        return (x[:, :both] @ y[:, :both].T) / size, (size != 0) & (wx[:, None] == wy) & (wy >= 0)


def _arrays(rows: DataFrame, made, schema: str) -> DataFrame:
    """rows -> made(batch), an Arrow table, of some thousand rows at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PASS):
                yield from made(batch.slice(at, PASS)).to_batches()

    return rows.mapInArrow(run, schema)


def _id_type(vectors: DataFrame) -> str:
    return vectors.schema["doc_id"].dataType.simpleString()


def _units(vectors: DataFrame) -> DataFrame:
    """doc_id, embedding, unit: of length 1, only those with a direction."""

    def made(batch):
        import numpy as np
        import pyarrow as pa

        v, length, width = _matrix(batch["embedding"])
        own = np.flatnonzero((width >= 0) & (length > 0) & (length < np.inf))
        unit = [v[i, : width[i]] / length[i] for i in own]
        rows = pa.array(own, "int64")
        return pa.table({"doc_id": batch["doc_id"].take(rows), "embedding": batch["embedding"].take(rows), "unit": pa.array(unit, pa.list_(pa.float64()))})

    return _arrays(vectors, made, f"doc_id {_id_type(vectors)}, embedding {vectors.schema['embedding'].dataType.simpleString()}, unit array<double>")


def _listed(vectors: DataFrame, centres: list[list[float]]) -> DataFrame:
    """list, doc_id, embedding: each vector with the centroid nearest to its direction; NOWHERE where it has none, or another width."""

    def made(batch):
        import numpy as np
        import pyarrow as pa

        v, length, width = _matrix(batch["embedding"])
        number = np.full(len(v), NOWHERE, "int32")
        if centres:
            c = np.array(centres)
            own = np.flatnonzero((width == c.shape[1]) & (length > 0) & (length < np.inf))
            unit = v[own, : c.shape[1]] / length[own, None]
            number[own] = np.argmin((c * c).sum(1) - 2 * (unit @ c.T), axis=1)
        return pa.table({"list": pa.array(number), "doc_id": batch["doc_id"], "embedding": batch["embedding"]})

    return _arrays(vectors.select("doc_id", "embedding"), made, f"list int, doc_id {_id_type(vectors)}, embedding {vectors.schema['embedding'].dataType.simpleString()}")


def _sizes(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """list, radius, n of the listed rows."""

    def made(batch):
        import numpy as np
        import pyarrow as pa

        number = batch["list"].to_numpy()
        v, length, _ = _matrix(batch["embedding"])
        c = np.array(centres)[number]
        size = np.sqrt((c * c).sum(1))
        with np.errstate(all="ignore"):  # centroids are no units any more; angles are taken to their directions
            angle = np.where(size > 0, np.arccos(np.clip((v[:, : c.shape[1]] * c).sum(1) / (size * length), -1.0, 1.0)), math.pi)
        return pa.table({"list": pa.array(number, "int32"), "radius": pa.array(angle)}).group_by("list", use_threads=False).aggregate([("radius", "max"), ("radius", "count")])

    met = _arrays(rows.filter(F.col("list") >= 0), made, "list int, radius_max double, radius_count long")
    return met.groupBy("list").agg(F.max("radius_max").alias("radius"), F.sum("radius_count").alias("n"))


def write_lists(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """vectors (doc_id, embedding), listed at path. lists: the square root of their number, if not given, and no more than MOST_LISTS."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = vectors.select("doc_id", "embedding")
    units = _units(rows)
    n = units.count()
    lists = max(1, min(MOST_LISTS, lists or math.isqrt(n)))
    units.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).write.parquet(f"{path}/sample")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = spark.read.parquet(f"{path}/sample")
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(taken.repartition(min(parts, 16), "doc_id").select(array_to_vector("unit").alias("features"))) if n else None
    centres = [[float(x) for x in c] for c in model.clusterCenters()] if n else []
    spark.createDataFrame(list(enumerate(centres)), "list int, centroid array<double>").write.parquet(f"{path}/learnt")
    _listed(rows, centres).repartitionByRange(parts, "list", "doc_id").sortWithinPartitions("list", "doc_id").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
    learnt = spark.read.parquet(f"{path}/learnt")
    learnt.join(_sizes(spark.read.parquet(f"{path}/rows"), centres), "list").write.parquet(f"{path}/centroids")
    _measured(_listed(taken, centres), spark.read.parquet(f"{path}/centroids")).write.parquet(f"{path}/recall")


def _order(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """query_id, q, list, place: the lists from the nearest, from 1."""
    near = queries.crossJoin(F.broadcast(centroids.select("list", "centroid"))).withColumn("near", _near(F.col("centroid"), F.col("q")))
    return near.select("query_id", "q", "list", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "list")).alias("place"))


def _measured(drawn: DataFrame, centroids: DataFrame) -> DataFrame:
    """probes, recall: the share of the NEIGHBOURS nearest in the sample, itself left out, that ASK of its vectors find in so many lists. Among all vectors neighbours are nearer, so recall is no less."""
    queries = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ASK).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    asks = queries.toArrow()  # ASK rows

    def made(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        score, able = _cosines(_matrix(asks["q"]), _matrix(batch["embedding"]))
        of, at = np.nonzero(able)
        met = pa.table({"query_id": asks["query_id"].take(pa.array(of)), "doc_id": batch["doc_id"].take(pa.array(at)), "list": batch["list"].take(pa.array(at)), "score": pa.array(score[of, at])})
        return met.filter(pc.not_equal(met["doc_id"], met["query_id"]))

    kind = _id_type(drawn)
    met = _arrays(drawn, made, f"query_id {kind}, doc_id {kind}, list int, score double")
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= NEIGHBOURS)
    placed = best.select("query_id", "list").join(_order(queries, centroids).select("query_id", "list", "place"), ["query_id", "list"])
    # a row for each list at most
    counts = centroids.select(F.row_number().over(Window.orderBy("list")).alias("place")).join(placed.groupBy("place").count(), "place", "left")
    found = F.sum(F.coalesce("count", F.lit(0)))
    return counts.select(F.col("place").alias("probes"), F.coalesce(F.try_divide(found.over(Window.orderBy("place")), found.over(Window.partitionBy())), F.lit(1.0)).alias("recall"))


def read_lists(spark: SparkSession, path: str) -> VectorLists:
    return VectorLists(*(spark.read.parquet(f"{path}/{part}") for part in ("rows", "centroids", "recall")))


def probes_for(index: VectorLists, recall: float = 0.92) -> int:
    """The fewest lists that had this recall at writing."""
    return index.recall.filter(F.col("recall") >= recall).agg(F.min("probes")).first()[0] or MOST_LISTS


def _near(v: Column, q: Column) -> Column:
    """Cosine, or -1 where a side has no direction."""
    size = norm(v) * norm(q)
    return F.when(size > 0, dot(v, q) / size).otherwise(-1.0)


def _scored(rows: DataFrame, query: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(query)).select("doc_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def read_for(index: VectorLists, query: DataFrame, k: int, probes: int, certain: bool = False, seen: DataFrame | None = None) -> list[int]:
    """The lists that a search reads, nearest first: `probes` of them, and, if it is to be certain, all that may hold a vector as good as the k-th of these."""
    near = index.centroids.crossJoin(F.broadcast(query)).select("list", "radius", _near(F.col("centroid"), F.col("q")).alias("near"))
    ranked = [(r.list, r.radius, r.near) for r in near.orderBy(F.desc("near"), "list").collect()]  # at most MOST_LISTS rows
    first = [i for i, _, _ in ranked[:probes]]
    if not certain or len(first) == len(ranked):
        return first
    rows = _only(index, first, seen)
    found = _scored(rows, query).orderBy(F.desc("score"), "doc_id").limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    if found.n < k:
        return [i for i, _, _ in ranked]
    bound = lambda radius, near: math.cos(max(0.0, math.acos(max(-1.0, min(1.0, near))) - radius)) + 1e-5  # noqa: E731  scores are rounded to 6 digits
    return first + [i for i, radius, near in ranked[probes:] if bound(radius, near) >= found.least]


def _only(index: VectorLists, lists: list[int], seen: DataFrame | None) -> DataFrame:
    rows = index.rows.filter(F.col("list").isin([*lists, NOWHERE]))
    return rows if seen is None else rows.join(seen.select("doc_id"), "doc_id", "left_semi")


def list_scores(index: VectorLists, query: DataFrame, k: int = 50, probes: int = 8, certain: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """doc_id, score (exact cosine) of the vectors in the lists that are read, for a query (one row, q); seen (doc_id): those that may be found.

    certain: the best k of these are the best k of all.
    """
    return _scored(_only(index, read_for(index, query, k, probes, certain, seen), seen), query)


def _placed(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(list, first slice, slices) of (list, vectors): neighbouring lists share a slice of at most SLICE vectors, a larger list is cut by a hash of its ids."""
    out, at, filled = [], 0, 0
    for i, n in counts:
        parts = max(1, -(-n // SLICE))
        if filled and (parts > 1 or filled + n > SLICE):
            at, filled = at + 1, 0
        out.append((i, at, parts))
        at, filled = at + parts - 1, filled + n if parts == 1 else SLICE
    return out


def nearest(index: VectorLists, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: for many queries (query_id, q) at once, the best k in each one's nearest lists, as many as had good recall at writing unless `probes` says how many.

    A slice of the lists meets a block of the queries in one task, as matrices; only the best k of each query leave it, so that what is shuffled after
    are k rows for each query and slice.
    """
    probes = probes or probes_for(index)
    spark = index.spark
    slices = _placed(sorted((r.list, r["count"]) for r in index.rows.groupBy("list").count().collect()))  # at most MOST_LISTS rows and one
    n_slices, n_blocks = max([1, *(at + parts for _, at, parts in slices)]), max(1, -(-queries.count() // BLOCK))
    learnt = sorted((r.list, r.centroid) for r in index.centroids.select("list", "centroid").collect())
    number = spark.createDataFrame(slices, "list int, first int, parts int")
    rows = index.rows.join(F.broadcast(number), "list").withColumn("slice", (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int"))
    rows = rows.select("slice", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "list", "doc_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), "query_id", "q")

    def met(rows, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.take(pc.sort_indices(rows["doc_id"], null_placement="at_start"))  # of equals the first id
        own, ask = _matrix(rows["embedding"]), _matrix(asked["q"])
        centres = _matrix(pa.array([c for _, c in learnt], pa.list_(pa.float64())))
        # a list's column among the probed ones; the last column is that of NOWHERE, which each query reads
        numbers = np.array([i for i, _ in learnt], "int64")
        lists = rows["list"].to_numpy()
        column = np.where(lists < 0, len(numbers), np.searchsorted(numbers, lists))
        found: list[tuple] = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0), np.empty(0, bool))]
        for start in range(0, asked.num_rows if rows.num_rows else 0, AT_ONCE):
            some = tuple(x[start : start + AT_ONCE] for x in ask)
            near, able = _cosines(some, centres)
            near = np.where(able, np.nan_to_num(near, nan=np.inf), -1.0)
            probed = np.zeros((len(near), len(numbers) + 1), bool)
            np.put_along_axis(probed, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            probed[:, -1] = True
            places = np.flatnonzero(probed.any(0)[column])
            if not len(places):
                continue
            score, able = _cosines(some, tuple(x[places] for x in own))
            # NaN stands before all numbers, null after them, as in Spark's order
            order = np.where(probed[:, column[places]], np.where(able, np.nan_to_num(np.round(score, 6), nan=2.0), -2.0), -9.0)
            least = np.partition(order, -k, axis=1)[:, -k] if len(places) > k else np.full(len(order), -2.0)
            for i, line in enumerate(order):
                best = np.flatnonzero(line >= max(least[i], -2.0))
                best = best[np.argsort(-line[best], kind="stable")][:k]
                found.append((np.full(len(best), start + i), places[best], score[i, best], able[i, best]))
        of, at, score, able = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": asked["query_id"].take(pa.array(of)), "doc_id": rows["doc_id"].take(pa.array(at)), "score": pa.array(score, pa.float64(), mask=~able, from_pandas=False)})

    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((queries, "query_id"), (index.rows, "doc_id"))]
    scored = rows.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block")).applyInArrow(met, f"{', '.join(kinds)}, score double").withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
