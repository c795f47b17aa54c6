"""Work that grows no faster than the input: evidence, contexts, sheets, outlines."""

import random

from pyspark.sql import functions as F

from larkspur.operators import evidence as V
from larkspur.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
BOXED = "doc_id long, page int, {0}, x0 double, y0 double, x1 double, y1 double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_preserved_as_verdicts_of_localized_regions(spark):
    """Equal boxes, an element with two boxes and in two chunks, chunks in several documents, questions over two documents, an answer over two texts."""
    rng = random.Random(6)

    def at():
        a, b = rng.randint(0, 9) * 20.0, rng.randint(0, 9) * 20.0
        return a, b, a + rng.randint(0, 5) * 10.0, b + rng.randint(0, 5) * 10.0

    el = [(d, rng.randint(0, 1), rng.randint(0, 60), *at()) for d in (1, 2, 3) for _ in range(80)]
    elements = spark.createDataFrame([*el, (None, 0, 1, 0.0, 0.0, 9.0, 9.0)], BOXED.format("idx long"))
    words = ["The", "ANSWER ", " the  answer", "no", "", None]
    chunks = spark.createDataFrame([(d, i, rng.choice(["a", "b", f"c{i // 9}", None]), rng.choice(["table", "text", "image", None]), rng.choice(words)) for d in (1, 2, 3) for i in range(60) for _ in range(1 + i % 2)], "doc_id long, idx long, chunk_id string, kind string, text string")
    own = [(q, 10 * q + n, 1 + (q + n * (q % 5 == 0)) % 3, rng.choice([0, 0, 1, 7]), *at()) for q in range(90) for n in range(2)]
    regions = spark.createDataFrame([*own, (99, 999, None, 0, 0.0, 0.0, 9.0, 9.0)], "question long, region long, doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    scales = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.5, 1.0), (3, None, None)], "doc_id long, sx double, sy double")
    asks = spark.createDataFrame([(q, ["Table", "Other"] if q % 2 else None, rng.choice([["the answer", "x"], ["answer the"], ["no the answer"], None])) for q in range(100)], "question long, channels array<string>, answers array<string>")
    pages = elements.select("doc_id", "page")
    # texts of one element stand in either order in the two, so its rows here have one text
    one = chunks.withColumn("text", F.when(F.col("idx") % 2 == 0, F.col("text")).otherwise("the answer"))
    want = sorted(map(str, V.verdicts(asks, V.localized(regions, pages, scales, elements), one).collect()))
    assert len({w.split("verdict=")[1].split(",")[0] for w in want}) >= 4 and any("answer_found=True" in w for w in want)
    assert sorted(map(str, V.preserved(asks, regions, pages, scales, elements, one).collect())) == want
    assert sorted(map(str, V.preserved(asks, regions, pages, scales, elements, one, most=200).collect())) == want  # a document in several tasks


def test_evidence_shuffles_no_hits(spark):
    """What is shuffled are the inputs' rows and one row for each question."""
    p = plan(QUERIES["evidence_preserved"](spark, SF))
    assert "FlatMapCoGroupsInArrow" in p and "explode(hits" not in p and "collect_set(CASE WHEN ((overlap" not in p


def filtered_before_cut(df) -> bool:
    """Documents that the user may not see are left out before their lines are made."""
    cuts = df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[1:]
    return bool(cuts) and all("Filter" in (below := c.split("Relation")[0]) and "% 17" in below for c in cuts)


def test_one_search_writes_no_index_and_cuts_its_documents_only(spark, monkeypatch):
    from larkspur.plans import base

    monkeypatch.setattr(base, "written", None)  # postings of all documents aren't made for one search
    out = QUERIES["search_with_context"](spark, SF)
    cuts = out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[1:]
    assert cuts and all("doc_id" in (below := c.split("Relation")[0]) and (" IN (" in below or " INSET " in below) for c in cuts)


def test_outline_filters_first(spark):
    assert filtered_before_cut(QUERIES["get_outline"](spark, SF))


def test_expand_filters_first(spark):
    assert filtered_before_cut(QUERIES["expand"](spark, SF))


def test_own_bodies_as_leveled(spark):
    """Bodies of elements with rights of their own, banners and furniture among them; no text is shuffled for them."""
    from larkspur.operators import structure as S
    from larkspur.plans.base import elements

    e = elements(spark, "/root/testdata/sf0.01").withColumn("kind", F.when(F.col("idx") % 11 == 3, "footer").otherwise(F.col("kind")))
    e = e.withColumn("text", F.when(F.col("idx") % 20 == 7, "  running  head").otherwise(F.col("text")))
    odd = (F.col("idx") + F.col("doc_id")) % 3 == 1
    want = S.in_section(S.leveled(e)).filter(odd).select("doc_id", "idx", "sec_head")
    got = S.own_bodies(e, odd)
    assert S.banner_keys(e).count() and want.count() and not got.exceptAll(want).count() and not want.exceptAll(got).count()
    shuffled = [line for line in plan(got).splitlines() if "Exchange" in line]
    assert shuffled and not any("text#" in line for line in shuffled)


def test_a_cell_is_read_as_text_once():
    """The fold asks whether cells hold something without making their texts again and again."""
    from unittest import mock

    from larkspur.operators import tables as T

    grid = [["order", "", "value"], ["key", "kind", "price"], *[[float(n), "x", n * 1.5] for n in range(10)]]
    with mock.patch.object(T, "cell_text", side_effect=T.cell_text) as made:
        assert T.sheet_chunks(grid, [(0, 0, 0, 1)], "s")
    assert made.call_count <= 3 * len(grid)
    odd = [None, float("nan"), "", " \n", " x ", "a\r\n b", 0, 0.0, False, True, 3, 2.5, "  "]
    assert [T.holds(v) for v in odd] == [T.cell_text(v) != "" for v in odd] and T.cell_text("a\r\n b ") == "a  b"
    assert T.widest([odd, [1, None]]) == 12 and T.widest([[], [None]]) == 0


def test_lists_of_structs_as_tuples():
    import pyarrow as pa

    from larkspur.operators.tables import _tuples

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string())]))
    lists = pa.array([[{"a": 9, "b": "z"}], [{"a": 1, "b": "x"}, {"a": 2, "b": None}], None, [], [{"a": 3, "b": "y"}]], kind)
    assert _tuples(lists.slice(1)) == [[(1, "x"), (2, None)], [], [], [(3, "y")]]


def test_words_are_looked_for_by_their_lengths(spark):
    """A dictionary of few lengths: other substrings are not looked up; paths are those of the joined look-up."""
    from larkspur.operators import segment

    words = spark.createDataFrame([("ab", 5), ("abcde", 2), ("cd", 3), ("e", 1), ("x", 4), ("yz", 0)], "word string, freq long")
    runs = spark.createDataFrame([("abcde",), ("xxabq",), ("q",), ("cdeabcdex",), ("",)], "run string")
    paths = [sorted(map(str, segment.segmented(runs, words, n).collect())) for n in (10, 0)]
    assert paths[0] == paths[1]

    class Slots(list):
        reads = 0

        def __iter__(self):
            Slots.reads += 1
            return super().__iter__()

    assert segment.best_path("qqab", [Slots(), Slots(), Slots([(4, -1.0)]), Slots()], -9.0) == ["q", "q", "ab"]
    assert Slots.reads <= 2  # places that open no word are passed over


def results(spark, requests, hits, session="long", doc="long"):
    from larkspur.operators import answering as A

    shape = f"call long, rank int, doc_id {doc}, chunk_id string, kind string, section_id string, score_kind string, context_status string, resolved_section string, anchor_start int, anchor_end int, text string, content_raw string, n_tokens int"
    rows = A.call_results(spark.createDataFrame(requests, f"call long, session {session}, at int, rerank boolean"), spark.createDataFrame(hits, shape), 60).collect()
    return {r.call: ([h.context_status for h in r.hits], r.section_folded_n, r.already_returned_n, r.budget_truncated, r.context_tokens) for r in rows}


def test_results_read_and_shuffle_hits_once(spark):
    """The two lists of a call's hits come from one shuffle; there is none between ranking and the lists, and no struct is compared within a lambda."""
    df = QUERIES["retrieve_results"](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert sum("FileScan" in line and "l_extendedprice" in line for line in final.splitlines()) == 1 and "ReusedExchange" in final
    assert "MapInArrow" in final and not any("Exchange" in line and "partial_collect" in line for line in final.splitlines())
    above = [line for line in final.splitlines() if "partial_collect_list" in line]
    assert above and all("struct" not in line for line in above)


def test_large_session_ids_beside_calls_of_no_session(spark):
    """Ids over 2 ** 53 stay apart where a batch has a null too."""
    big = 2**53
    hits = [(c, 1, 1, "c", "text", "s", "fused", "full_section", None, None, None, "x", None, 5) for c in range(5)]
    got = results(spark, [(0, None, 0, False), (1, big, 0, False), (2, big + 1, 0, False), (3, big + 1, 1, False), (4, None, 1, False)], hits)
    assert {c: r[0] for c, r in got.items()} == {0: ["full_section"], 1: ["full_section"], 2: ["full_section"], 3: ["already_returned"], 4: ["full_section"]}


def test_sections_of_documents_with_alike_names(spark):
    pairs = [("a", "b|section c"), ("a|section b", "c"), ("a", "c"), (None, "c"), ("", "c"), ("a", "b|section c"), (None, "c")]
    hits = [(1, n, doc, f"c{n}", "text", section, "fused", "full_section", None, None, None, "x", None, 1) for n, (doc, section) in enumerate(pairs)]
    hits += [(1, 7, "a", "c7", "table", "c", "fused", "full_section", None, None, None, "x", None, 1), (1, 8, "a", "c8", "text", "hit 7", "fused", "full_section", None, None, None, "x", None, 1)]
    got = results(spark, [(1, 1, 0, False)], hits, doc="string")
    assert (len(got[1][0]), got[1][1]) == (7, 2)


def test_a_session_over_several_batches(spark):
    """What a session was given is known in its next batch."""
    rng = random.Random(3)
    requests = [(c, rng.choice([None, 1, 1, 2]), rng.randrange(9), False) for c in range(60)]
    hits = [(c, n, rng.randrange(4), f"c{rng.randrange(9)}", rng.choice(["text", "table"]), rng.choice([None, "s", "t"]), "fused", "full_section", None, None, None, "x" * rng.randrange(99), None, None) for c in range(55) for n in range(rng.randrange(1, 9))]
    want = results(spark, requests, hits)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert results(spark, requests, hits) == want and any(r[2] for r in want.values()) and any(r[3] for r in want.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
