"""Whitening against numpy over the whole table at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("larkspur.llm.queries")

from larkspur.llm import whitening  # noqa: E402


def brute(vectors, components=4):
    """id -> (deviation, whitened), and explained, of (id, vector) rows that are usable."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in vectors}
    distinct = np.array(sorted(set(map(tuple, x.values()))), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    mean = np.array([s / n for s in sums])
    centred = distinct.astype(float) - mean
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1].T[:components]
    return n, {i: (int(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))), (np.array(v) - mean) @ u.T / np.sqrt(e)) for i, v in x.items()}, e / np.trace(centred.T @ centred / n)


def check(rows, vectors, components=4):
    n, want, share = brute(vectors, components)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == want.keys()
    signs = None
    for i, (deviation, white) in want.items():
        own = np.array([got[i][k + 1].whitened for k in range(components)])
        assert all(r.deviation == deviation and r.n == n and r.identity_error < 1e-9 for r in got[i].values())
        assert np.allclose([got[i][k + 1].explained for k in range(components)], share, rtol=1e-9)
        signs = np.sign(own * white) if signs is None and (np.abs(own) > 1e-6).all() else signs
        assert np.allclose(np.abs(own), np.abs(white), atol=1e-8) and (signs is None or np.allclose(own, white * signs, atol=1e-8))
    assert sum(len(x) for x in got.values()) == components * len(want)


def test_query(spark):
    from larkspur.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_many_partitions_merge_without_loss(spark, monkeypatch):
    """A tree of several levels, blocks of few rows, a vector that is a third of all rows, offsets far from zero."""
    monkeypatch.setattr(whitening, "MERGE_BYTES", 1)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5] + 4000]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = whitening.whiten(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(got, rows)


def test_merge_of_factors_is_the_factor_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (50, 7))
    parts = [whitening.factor(x[a:b]) for a, b in [(0, 1), (1, 3), (3, 30), (30, 50)]]
    one = parts[0]
    for f in parts[1:]:
        one = whitening.merged(one, f)
    c = x - x.mean(axis=0)
    assert one.n == 50 and one.sums == x.sum(axis=0).tolist() and len(one.s) == 7
    assert np.allclose(one.v.T @ (one.s[:, None] ** 2 * one.v), c.T @ c, rtol=1e-12)


def test_encoding_is_lossless():
    x = np.array([[0, -128, 127], [128, 0, 0], [-32769, 1, 2], [2**40, -1, -(2**63)], [0, 0, 0]], np.int64)
    rows = whitening.encoded(x)
    assert [len(r.as_py()) for r in rows] == [3, 6, 12, 24, 3] and (whitening.decoded(rows, 3) == x).all()


def test_rows_that_are_left_out_and_degenerate_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [2.0, 1.0, 0.0, -1.0, 7.5]), (3, None), (4, [1.0, None, 2.0, 3.0, 4.0]), (5, [nan, 1.0, 2.0, 3.0, 4.0]), (6, [inf, 1.0, 2.0, 3.0, 4.0]), (7, []), (8, [1.0]), (9, [1e300, 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, [-0.001, 0.5, 0.25, 9.0, 1.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, e string, `a.b` string")
    got = whitening.whiten(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1"] * 8 + ["2"] * 4 + ["None"] * 4)
    assert {r.n for r in got} == {3} and all(r.whitened == 0 and r.explained == 0 for r in got if r.component > 2) and max(r.identity_error for r in got) < 1e-9
    assert not whitening.whiten(df.limit(0)).collect() and not whitening.whiten(df.filter("vec_id in (3, 4)")).collect()
    one = whitening.whiten(df.filter("vec_id = 1").withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))).collect()
    assert len(one) == 8 and all((r.vec_id, r.deviation, r.whitened, r.identity_error) == ("v1", 0, 0.0, 0.0) for r in one)


def test_deviation_is_exact_beyond_long():
    x = np.array([[2**50, -5], [3, 2**52]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert [int(v.as_py()) for v in whitening.deviations(x, 2, sums)] == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
