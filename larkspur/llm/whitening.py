"""Embedding whitening by hierarchical SVD merging.

Each partition of the distinct vectors becomes a factor: its count, sums, mean, singular values and right singular
vectors, all that the rows have. Two factors merge by stacking their rows S*V and a row for the difference of their means, and
decomposing these again, so nothing is lost at any level; a tree of such merges, each level written to the shared folder, ends in
one factor of at most width x width numbers whatever the input. Vectors are whole numbers floor(scale * entry), so sums are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, column

#: Vectors that are decomposed at once.
BLOCK = 4096
#: Bytes of factors that one merging task holds.
MERGE_BYTES = 64 << 20
SCALE = 256
EXACT = T.DecimalType(38, 0)
FACTOR = "part int, n long, sums array<decimal(38,0)>, mean array<double>, s array<double>, v array<double>"


@dataclass
class Factor:
    """n rows with this mean; v' diag(s^2) v is their centred sum of squares. sums: exact, where the rows are whole numbers."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    s: np.ndarray
    v: np.ndarray


def factor(block: np.ndarray) -> Factor:
    n, sums = len(block), None
    if block.dtype == np.int64:
        wide = block if np.abs(block, dtype=np.float64).max() * n < 2**62 else block.astype(object)
        sums = [int(x) for x in wide.sum(axis=0)]
        mean = np.array([x / n for x in sums])
    else:
        mean = block.mean(axis=0)
    return Factor(n, sums, mean, *_decomposed(block - mean))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def merged(a: Factor, b: Factor) -> Factor:
    n = a.n + b.n
    step = np.sqrt(a.n * (b.n / n)) * (a.mean - b.mean)
    sums = None if a.sums is None else [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    mean = a.mean * (a.n / n) + b.mean * (b.n / n) if sums is None else np.array([x / n for x in sums])
    return Factor(n, sums, mean, *_decomposed(np.vstack([a.s[:, None] * a.v, b.s[:, None] * b.v, step])))


def _packed(part: int, f: Factor) -> pa.RecordBatch:
    sums = None if f.sums is None else [Decimal(x) for x in f.sums]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    row = [part, f.n, sums, f.mean, f.s, f.v.ravel()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "n", "sums", "mean", "s", "v"])


def _unpacked(row) -> Factor:
    mean = np.array(row.mean, float)
    return Factor(int(row.n), None if row.sums is None else [int(x) for x in row.sums], mean, np.array(row.s, float), np.array(row.v, float).reshape(-1, len(mean)))


def encoded(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, each number in the fewest of 1, 2, 4 or 8 that its row needs; equal rows have equal bytes."""
    out = np.empty(len(x), object)
    most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
    width = np.select([most < 2**7, most < 2**15, most < 2**31], [1, 2, 4], 8)
    for w in np.unique(width):
        at, step = np.flatnonzero(width == w), int(w) * x.shape[1]
        raw = x[at].astype(f"<i{w}").tobytes()
        out[at] = [raw[i : i + step] for i in range(0, len(raw), step)]
    return pa.array(out, pa.binary())


def decoded(rows: pa.Array, width: int) -> np.ndarray:
    out, raw = np.empty((len(rows), width), np.int64), rows.to_pylist()
    sizes = np.array([len(r) for r in raw], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{size // width}").reshape(-1, width)
    return out


def usable(vectors: DataFrame, name: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """vectors without rows whose vector is null, empty, holds null or non-finite entries or ones beyond long's range, or has not the commonest width (of several the least); that width."""
    most = float(2**63) / scale
    c = column(name)
    sound = vectors.filter(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < most)))
    common = sound.groupBy(F.size(c).alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = common.width if common else 0
    return sound.filter(F.size(c) == width), width


def _numbers(batch: pa.RecordBatch, at: int, width: int, scale: int) -> np.ndarray:
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64).reshape(-1, width) * scale).astype(np.int64)


def factored(rows: DataFrame, width: int, scratch: Scratch, project=None) -> Factor | None:
    """The factor of all rows (x, as encoded); project makes other rows from a block of them. Only the last factor comes to the driver."""

    def blocks(batches):
        from pyspark import TaskContext

        whole, held, size = None, [], 0
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                x = decoded(batch.column(0).slice(start, BLOCK), width)
                held.append(project(x) if project else x)
                size += len(x)
                if size >= BLOCK:
                    f = factor(np.vstack(held))
                    whole, held, size = f if whole is None else merged(whole, f), [], 0
        if held:
            f = factor(np.vstack(held))
            whole = f if whole is None else merged(whole, f)
        if whole is not None:
            yield _packed(TaskContext.get().partitionId(), whole)

    def merge(key, rows):
        out = None
        for row in rows.sort_values("part").itertuples():
            f = _unpacked(row)
            out = f if out is None else merged(out, f)
        return _packed(int(key[0]), out).to_pandas()

    factors = scratch.stage(rows.select("x").mapInArrow(blocks, FACTOR), "factors")
    last = factors.agg(F.max("part")).first()[0]
    if last is None:
        return None
    fan = max(2, min(32, MERGE_BYTES // (8 * width * width)))
    while last:  # levels: the logarithm of the partitions
        group = F.floor(F.col("part") / fan).cast("int")
        factors = scratch.stage(factors.groupBy(group.alias("group")).applyInPandas(merge, FACTOR), "factors")
        last //= fan
    return _unpacked(factors.first())


@dataclass
class Whitening:
    """n distinct vectors, their exact sums, and unit eigenvectors of their covariance by falling eigenvalue; each one's largest entry is positive."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x along each component, over its deviation; 0 along one without variance."""
        mean, root = np.array([s / self.n for s in self.sums]), np.sqrt(self.values)
        return (x - mean) @ self.vectors.T / np.where(root > 0, root, np.inf)


def model_of(f: Factor, components: int) -> Whitening:
    values = f.s**2 / f.n
    tiny = (f.s[0] * np.finfo(float).eps * max(f.v.shape)) if len(f.s) else 0.0
    values = np.where(f.s > tiny, values, 0.0)
    k, width = min(components, f.v.shape[1]), f.v.shape[1]
    vectors, values = f.v[:k], values[:k]
    if len(vectors) < k:  # fewer rows than components: the others have no variance
        vectors, values = np.vstack([vectors, np.zeros((k - len(vectors), width))]), np.append(values, np.zeros(k - len(values)))
    sign = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return Whitening(f.n, f.sums, vectors * np.where(sign == 0, 1, sign)[:, None], values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum((n * x - sums)^2) of each row, exact; null beyond 38 digits."""
    far = n * max(1.0, float(np.abs(x.astype(float)).max(initial=0))) + max(map(abs, sums))
    if far * far * x.shape[1] < 2**62:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def fit(vectors: DataFrame, components: int = 4, name: str = "embedding", scale: int = SCALE) -> tuple[Whitening | None, float]:
    """The whitening of the distinct vectors, and the variance in all dimensions. None where no vector is usable."""
    scratch = Scratch(vectors.sparkSession)
    sound, width = usable(vectors, name, scale)
    if not width:
        return None, 0.0

    def numbers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([encoded(_numbers(batch, 0, width, scale))], names=["x"])

    # equal vectors meet before they are shuffled, so a common one is a row of each partition
    rows = scratch.stage(sound.select(column(name).alias("e")).mapInArrow(numbers, "x binary").distinct(), "distinct")
    whole = factored(rows, width, scratch)
    model = model_of(whole, components)
    again = factored(rows, width, scratch, model.whitened)
    spread = again.v.T @ (again.s[:, None] ** 2 * again.v) / again.n
    with_variance = model.values > 0
    wrong = np.abs(spread - np.eye(len(model.values)))[np.ix_(with_variance, with_variance)]
    model.identity_error = float(wrong.max(initial=0.0))
    scratch.drop()
    return model, float((whole.s**2).sum() / whole.n)


def whiten(vectors: DataFrame, components: int = 4, name: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors (vec_id of any type, a list of numbers; other columns are left out) -> vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Entries become floor(scale * entry). Left out are rows that usable() leaves out; rows of equal or null id, and repeated rows, have
    results of their own, but equal vectors count once in the fit. There are as many components as dimensions at most; one without
    variance (all vectors equal, or fewer vectors than components) has whitened 0 and explained 0 and does not count in identity_error.
    No usable rows, no result rows. The model, components x width numbers, goes to the tasks.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", EXACT), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    model, total = fit(vectors, components, name, scale)
    if model is None:
        return spark.createDataFrame([], schema)
    sound, width = usable(vectors, name, scale)
    k, share = len(model.values), model.values / total if total > 0 else model.values

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                own = batch.slice(start, BLOCK)
                x = _numbers(own, 1, width, scale)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                many = lambda a: pa.array(np.tile(a, len(x)))  # noqa: B023, E731
                size = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(at), many(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(size, model.n)), deviations(x, model.n, model.sums).take(at), pa.array(model.whitened(x).ravel()), many(share), pa.array(np.full(size, model.identity_error))],
                    names=schema.names,
                )

    return sound.select(column("vec_id").alias("vec_id"), column(name).alias("e")).mapInArrow(run, schema)
