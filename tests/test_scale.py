"""Steps whose work has to grow with their input: what they shuffle, and that their rows stay the same."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import blocks as B
from larkspur.operators import search
from larkspur.operators import vector_lists as L
from larkspur.sources import index

TEXTS = ["a b a", None, "", "x-y x y X-Y", "café cafés v1.2 v1.2 1.2", "中文 中", "one " * 3000, "q_r/s q_r/s-t"]


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_terms_are_counted_in_their_document(spark, monkeypatch):
    monkeypatch.setattr(search, "COUNTED", 5)  # many slices
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("more", F.concat(F.lit("m"), "doc_id"))
    own = search.document_terms(docs)
    got = sorted((r.doc_id, r.tok, r.tf) for r in own.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*").collect())
    assert got == sorted((r.doc_id, r.tok, r.tf) for r in search.postings(docs).collect())
    assert {(r.doc_id, r.more, r.len) for r in own.collect()} == {(i, f"m{i}", sum(n for d, _, n in got if d == i)) for i in range(len(TEXTS))}
    assert exchanges(own) == 0


def test_blocks_from_terms_are_those_from_postings(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"word{n % 7} common {'long ' * (n % 5)}", "t0", ["g"], "public", False) for n in range(300)], "doc_id long, text string, acl_tenant string, acl_allow array<string>, acl_visibility string, acl_unset boolean")
    index.write_postings(docs, f"file://{tmp_path}/p")
    posts, lengths = index.read_postings(spark, f"file://{tmp_path}/p")
    B.write_blocks(docs, posts, lengths, f"{tmp_path}/joined", slot=2)
    B.write_blocks(docs, posts, lengths, f"{tmp_path}/direct", slot=2, terms=index.read_terms(spark, f"file://{tmp_path}/p"))
    one, two = (B.read_blocks(spark, f"{tmp_path}/{x}").rows for x in ("joined", "direct"))
    assert one.count() > 10 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_many_queries_meet_lists_as_matrices(spark, tmp_path, monkeypatch):
    """Slices, blocks and copies: the rows are those of all pairs, odd vectors and ties included; each query leaves a slice with its best only."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(90)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    L.write_lists(df.filter("doc_id < 404"), f"{tmp_path}/l", lists=5)
    index = L.read_lists(spark, f"{tmp_path}/l")
    asks = df.filter("doc_id % 7 = 0 or doc_id >= 400").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(L, "SLICE", 40)
    monkeypatch.setattr(L, "BLOCK", 9)
    monkeypatch.setattr(L, "AT_ONCE", 4)
    got = L.nearest(index, asks, 12, probes=5)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString() and "CoGroup" in got._jdf.queryExecution().executedPlan().toString()
    pairs = index.rows.crossJoin(F.broadcast(asks)).select("query_id", "doc_id", F.round(L.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 12")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_equal_boxes_meet_once(spark):
    """Copies of a box and of a region add to counts, not to pairs."""
    from larkspur.operators import evaluate as E

    boxes = spark.range(4000).select(F.lit(1).alias("doc"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), (F.col("id") % 2 + 4).cast("double").alias("y1"))
    regions = spark.range(300).select(F.col("id").alias("r"), F.lit(1).alias("doc"), F.lit(5.0).alias("a0"), F.lit(0.0).alias("b0"), F.lit(9.0).alias("a1"), F.lit(6.0).alias("b1"))
    out = E.overlaps(regions, boxes, ["doc"], "r", 25.0)
    assert {(r.n, r.total) for r in out.collect()} == {(4000, 2000 * 16.0 + 2000 * 20.0)} and out.count() == 300
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 4
    twice = E.overlaps(regions.unionByName(regions), boxes, ["doc"], "r", 25.0)
    assert {(r.n, r.total) for r in twice.collect()} == {(8000, 2 * (2000 * 16.0 + 2000 * 20.0))} and twice.count() == 300


def test_held_elements_against_all_places(spark):
    """Elements at any place of a chunk, at its end, in several chunks, in none; letters of two bytes; a chunk's letters leave its row only where they are asked for."""
    from larkspur.operators import evaluate as E

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    elements, chunks, want = [], [], {}
    for doc in range(12):
        own = [text(rng.choice([15, 25, 60, 61, 140])) for _ in range(6)]
        parts = [text(rng.randrange(30)) + x + text(rng.randrange(30)) for x in own[:4]] + [own[4][:70], "", text(5) + own[0] + own[0], own[1][-30:]]
        elements += [(doc, i, t) for i, t in enumerate(own)]
        chunks += [(doc, i, t) for i, t in enumerate(parts)]
        bare = lambda t: "".join(t.split())
        want |= {(doc, i): sum(bare(t)[:60] in bare(c) for c in parts) for i, t in enumerate(own) if len(bare(t)) >= 20}
    out = E.held_elements(spark.createDataFrame(elements, "doc_id long, idx int, text string"), spark.createDataFrame(chunks, "doc_id long, chunk_id int, text string"))
    assert {(r.doc_id, r.idx): r.n for r in out.collect()} == want
    assert "array_intersect" in out._jdf.queryExecution().optimizedPlan().toString()


def test_weights_shuffle_questions_once(spark):
    from larkspur.operators import quality as Q

    lists = lambda name: spark.createDataFrame([(q, f"i{(q * 7 + r) % 9}", r) for q in range(40) for r in range(1, 5)], f"q int, id string, {name} int")
    golden = spark.createDataFrame([(q, f"i{q % 9}") for q in range(0, 40, 2)] + [(2, "i2"), (99, "i0")], "q int, id string")
    out = Q.weight_quality(lists("sparse_rank"), lists("dense_rank").filter("q % 3 = 0"), golden, [0.0, 0.5, 1.0], at=2)
    assert {r.n for r in out.collect()} == {21}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1  # the asked one; planning adds that of the weights only
    rank = {q: next((r for r in range(1, 5) if (q * 7 + r) % 9 == q % 9), None) for q in range(0, 40, 2)}
    zero = next(r for r in out.collect() if r.w == 0.0)
    assert zero.mrr == round(sum(1 / r for r in rank.values() if r) / 21, 6)


def test_folds_see_few_documents_at_a_time(spark):
    from larkspur.operators.folds import AT_ONCE, in_slices

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "rows": [int(f["id"].sum())], "none": [None], "own": [[x["a"] for x in f["s"][0]]]})

    from pyspark.sql import functions as F

    rows = spark.range(0, 1000, 1, 1).withColumn("s", F.array(F.struct(F.col("id").alias("a"))))
    out = in_slices(rows, run, "n int, rows long, none int, own array<long>").collect()
    assert max(r.n for r in out) == AT_ONCE and sum(r.rows for r in out) == 499500 and out[1].own == [AT_ONCE]


def test_packing_passes_slices(spark):
    """chunks, big blocks and sheets hand Python few documents at a time."""
    from larkspur.plans.registry import QUERIES

    for name in ("pack_chunks", "sheet_chunks"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan or "PythonMapInArrow" in plan, name
