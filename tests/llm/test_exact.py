"""Exact deduplication against a plain grouping of whole texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("larkspur.llm.queries")

from larkspur.llm import exact  # noqa: E402

ROWS = [(3, "a b"), (1, "a b"), (7, "a  b"), (2, "A b"), (4, None), (5, ""), (None, "a b"), (None, "z"), (None, "z"), (6, "long " * 20_000), (8, "long " * 20_000), (9, "twin"), (9, "twin"), (9, "other")]
ROWS += [(100 + n, "hot text") for n in range(60)] + [(200 + n, f"single {n}") for n in range(30)]


def table(spark, kind="long"):
    df = spark.createDataFrame([(i, t, "x", "y", n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, hash string, `a.b` string, _n int").repartition(5)
    return df.withColumn("doc_id", F.col("doc_id").cast(kind))


def expected(largest):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        for k, i in enumerate(ids):
            out.append((i, best, len(ids), k == ids.index(best), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


SHORT = lambda t: F.substring(F.md5(t), 1, 1)  # noqa: E731  16 values: most collide


@pytest.mark.parametrize("digest", [exact.content_hash, SHORT], ids=["md5", "colliding"])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_report(spark, keep, digest):
    got = exact.exact_duplicates(table(spark), keep, digest)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(keep == "largest")


@pytest.mark.parametrize("digest", [exact.content_hash, SHORT], ids=["md5", "colliding"])
def test_keep_one(spark, digest):
    docs = table(spark)
    got = exact.keep_one(docs, "largest", digest)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted({(str(max((i for i, u in ROWS if (u or "") == (t or "") and i is not None), default=None)), t or "") for _, t in ROWS})
    assert all((r.hash, r["a.b"]) == ("x", "y") for r in rows)


def test_ids_of_any_type_and_empty_tables(spark):
    got = exact.exact_duplicates(table(spark, "string"), "largest").collect()
    assert len(got) == len(ROWS) and {r.keep_id for r in got if r.doc_id == "159"} == {"159"}
    assert not exact.exact_duplicates(table(spark).limit(0)).collect() and not exact.keep_one(table(spark).limit(0)).collect()
    with pytest.raises(ValueError):
        exact.exact_duplicates(table(spark), "first")


def test_no_python_and_no_window(spark):
    plan = exact.exact_duplicates(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Window", "Cartesian"))
