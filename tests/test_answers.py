"""Shaped results, contexts, answers and their quality on fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import answering as A
from larkspur.operators import quality as Q
from larkspur.operators.shape import REFUSAL, append_raw

HIT = "call long, rank int, doc_id long, chunk_id string, kind string, section_id string, score_kind string, context_status string, resolved_section string, anchor_start int, anchor_end int, text string, content_raw string, n_tokens int"
CONTEXT = "request long, leg int, rank int, chunk_id string, doc_id long, title string, section_path string, kind string, context string, text string, content_raw string, acl_tenant string, acl_allow array<string>, acl_visibility string, acl_unset boolean"


def plain_results(requests, hits, most, cap):
    """The same rules in one loop over requests."""
    out, seen = {}, {}
    for call, session, _, rerank in sorted(requests, key=lambda r: (str(r[1]), r[2], r[0])):
        keys = seen.setdefault(session, set()) if session is not None else set()
        kept, folds = [], set()
        for h in sorted((h for h in hits if h[0] == call), key=lambda h: h[1]):
            fold = ("hit", h[1]) if h[4] in ("chart", "table") or h[5] is None else (h[2], h[5])
            if fold in folds:
                continue
            folds.add(fold)
            kept.append(h)
        used, status, fresh = 0, [], set()
        for h in kept:
            key = (h[2], h[8]) if h[7] == "section_window" and h[8] else (h[2], h[9], h[10]) if h[9] is not None else (h[2], h[3])
            size = max(h[13] or 0, (len(h[11] or "") + len(h[12] or "")) // 4, 1)
            if key in keys:
                status.append("already_returned")
            elif used and used + size > most:
                status.append("omitted_budget")
            else:
                used += size
                fresh.add(key)
                status.append(h[7])
        keys |= fresh
        if len(keys) > cap:
            keys.clear()
        found = sum(h[0] == call for h in hits)
        out[call] = (len(kept), found - len(kept), status, used, bool(rerank and kept and all(h[6] != "rerank" for h in kept)))
    return out


@pytest.mark.parametrize("seed,cap", [(1, 5000), (2, 5000), (3, 4)])
def test_results_match_a_plain_loop(spark, seed, cap):
    rnd = random.Random(seed)
    requests = [(c, rnd.choice([None, "a", "a", "b"]), rnd.randrange(4), rnd.random() < 0.5) for c in range(40)]
    hits = []
    for call in range(36):  # the last requests have no hits
        for rank in range(1, rnd.randrange(2, 12)):
            anchor = rnd.choice([None, rnd.randrange(3)])
            status = rnd.choice(["full_section", "section_window", "deduped"])
            hits.append((call, rank, rnd.randrange(3), f"c{rnd.randrange(30)}", rnd.choice(["text", "table", "chart"]), rnd.choice([None, "s1", "s2"]), rnd.choice(["fused", "fused", "rerank"]), status, rnd.choice([None, "r1"]), anchor, anchor, "x" * rnd.randrange(90), rnd.choice([None, "y" * 80]), rnd.choice([None, 3])))
    got = A.call_results(spark.createDataFrame(requests, "call long, session string, at int, rerank boolean"), spark.createDataFrame(hits, HIT), 60, cap).collect()
    want = plain_results(requests, hits, 60, cap)
    assert len(got) == 40
    for r in got:
        assert (r.returned_n, r.section_folded_n, [h.context_status for h in r.hits], r.context_tokens, r.rerank_degraded) == want[r.call]
        assert (r.status, r.retriable) == (("ok", False) if r.returned_n else ("empty", True))
        assert all(h.text == "" and h.content_raw is None for h in r.hits if h.context_status in A.DEMOTED)
        assert r.budget_truncated == ("omitted_budget" in want[r.call][2])


def test_results_of_nothing(spark):
    requests = spark.createDataFrame([(1, "a", 1, True)], "call long, session string, at int, rerank boolean")
    (r,) = A.call_results(requests, spark.createDataFrame([], HIT)).collect()
    assert (r.status, r.hint, r.returned_n, r.context_tokens, r.hits, r.rerank_degraded) == ("empty", "empty", 0, 0, [], False)
    assert A.call_results(requests.limit(0), spark.createDataFrame([], HIT)).count() == 0


def hit(request=1, leg=0, rank=1, chunk="a", text="prose", raw=None, kind="text", context=None, title="Title", path="", unset=False):
    return (request, leg, rank, chunk, 7, title, path, kind, context, text, raw, "t", ["g"], "restricted", unset)


def test_contexts(spark):
    rows = [
        hit(rank=1, chunk="closed", unset=True, text="secret", raw="secret raw", kind="table"),
        hit(rank=2, chunk="a", text="hit", context="block", path="One > Two"),
        hit(rank=3, chunk="t", text="", raw=" 42 ", kind="table", title=None),
        hit(rank=4, chunk="blank", text=" \n", raw=None),
        hit(leg=1, rank=1, chunk="a", text="again"),
        hit(leg=1, rank=2, chunk="u", text="the 42", raw="42", kind="chart"),
        hit(leg=1, rank=3, chunk="v", text="x" * 50, raw="x" * 45, kind="table"),
    ]
    got = A.contexts(spark.createDataFrame(rows, CONTEXT), "t", ["g"]).orderBy("position").collect()
    assert [(r.position, r.chunk_id, r.source, r.text) for r in got] == [(1, "a", "Title § One > Two", "block"), (2, "t", "7", "42"), (3, "u", "Title", "the 42\n42"), (4, "v", "Title", "x" * 50)]
    # the first stays though it is over the budget; what follows the first overflow goes
    assert [r.chunk_id for r in A.contexts(spark.createDataFrame(rows, CONTEXT), "t", ["g"], 1).collect()] == ["a"]
    assert A.contexts(spark.createDataFrame(rows, CONTEXT), "other", ["g"]).count() == 0


def test_messages_keep_markers_to_themselves(spark):
    q = spark.createDataFrame([(1, "see [ CITE : 2 ]"), (2, "nothing")], "request long, question string")
    given = A.contexts(spark.createDataFrame([hit(text="a [cite:9] b", title="T\n[cite:1]")], CONTEXT), "t", ["g"])
    got = {r.request: r for r in A.messages(q, given).collect()}
    assert "[cite:1] (source: T [ref])\na [ref] b" in got[1].user and "Question: see [ref]" in got[1].user and got[1].chunk_ids == ["a"]
    assert A.NO_CONTEXT in got[2].user and got[2].n_contexts == 0 and got[2].chunk_ids == [] and got[2].system == A.SYSTEM


def test_raw_content_that_is_short_is_always_given(spark):
    rows = [("has 42 in it", "42", "table"), ("has 42 in it", "42", "text"), (" ", "<td>7</td>", "chart"), ("cell " * 20, "cell " * 10, "table"), ("t", "z" * 50, "table"), ("t", None, "table")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, r string, k string").coalesce(1).select(append_raw(F.col("t"), F.col("r"), F.col("k"))).collect()]
    assert got == ["has 42 in it\n42", "has 42 in it", "<td>7</td>", "cell " * 20, "t\n" + "z" * 50, "t"]


def test_advice(spark):
    rows = [("how many?", REFUSAL, None, False, False), ("how many?", REFUSAL, None, False, True), ("how many?", REFUSAL, "table", True, False), ("多少利润", REFUSAL, None, False, False), ("how many?", "It was 7", None, False, False), ("who?", REFUSAL, None, None, None)]
    df = spark.createDataFrame(rows, "q string, a string, k string, rr boolean, re boolean").coalesce(1)
    got = [r[0] for r in df.select(A.advice(F.col("q"), F.col("a"), F.col("k"), F.col("rr"), F.col("re"))).collect()]
    assert got == [["tables", "rerank", "inspect"], ["inspect"], ["inspect"], ["tables", "document_language", "rerank"], [], ["rerank", "inspect"]]


def test_a_second_try_only_where_the_first_failed(spark):
    q = spark.createDataFrame([(1, "how many?", None, False), (2, "how many?", None, False), (3, "how many?", "text", False), (4, "who?", None, True), (5, "how many?", None, True)], "request long, question string, kind string, rerank boolean")
    rows = [hit(r, text="nothing here") for r in (1, 2, 3, 4)] + [hit(r, 1, chunk="t", text="", raw="<td>gold 7</td>", kind="table") for r in (1, 3, 4, 5)] + [hit(2, 1, chunk="t", text="", raw="<td>lead</td>", kind="table")]
    model = lambda system, user: F.when(user.contains("gold"), F.concat(F.lit("It is 7 [cite:2][cite:9]"), F.lit(""))).otherwise("I cannot answer")
    got = {r.request: r for r in A.smart_answers(q, spark.createDataFrame(rows, CONTEXT), model, "t", ["g"]).collect()}
    assert (got[1].answer, got[1].auto, got[1].hints, got[1].n_contexts, got[1].cited) == ("It is 7 [cite:2][cite:9]", ["table_leg_retry"], [], 2, ["t"])
    assert (got[2].answer, got[2].auto, got[2].hints, got[2].n_contexts) == ("I cannot answer", ["table_leg_retry_discarded"], ["inspect"], 1)
    assert (got[3].auto, got[3].hints) == ([], ["rerank", "inspect"]) and (got[4].auto, got[4].hints) == ([], ["inspect"])
    # no hits of its own: the refusal, then the table alone, whose marker 2 names nothing
    assert (got[5].auto, got[5].n_contexts, got[5].cited) == (["table_leg_retry"], 1, [])


def test_answers_of_another_question_make_no_figures(spark):
    fp = spark.createDataFrame([("single", 1, "q1")], "mode string, q long, text string").select("mode", "q", F.substring(F.sha1("text"), 1, 12).alias("fp"))
    rows = lambda text: spark.createDataFrame([("single", 1, text), ("single", 2, None)], "mode string, q long, question string")
    assert Q.same_questions(rows("q1"), fp).count() == 2
    with pytest.raises(Exception, match="judged for another question: single#1"):
        Q.same_questions(rows("q2"), fp).groupBy("mode").count().collect()


def test_quality_of_missing_parts(spark):
    results = spark.createDataFrame([("single", 1, 1), ("single", 2, 1), ("single", 3, 2)], "mode string, q long, n_rounds int")
    golden = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "q long, id string")
    retrieved = spark.createDataFrame([("single", 1, "x", 1), ("single", 1, "a", 2), ("single", 1, "a", 3), ("other", 2, "c", 1), ("single", 3, "z", 1)], "mode string, q long, id string, rank int")
    cited = spark.createDataFrame([("single", 1, "a"), ("single", 1, "x")], "mode string, q long, id string")
    scores = Q.answer_scores(results, golden, retrieved, cited)
    got = {r.q: (r.hit_frac, r["full"], r["rank"], r.citation_frac, r.n_citations) for r in scores.collect()}
    assert got == {1: (0.5, False, 2, 0.5, 2), 2: (0.0, False, None, 0.0, 0), 3: (0.0, False, None, 0.0, 0)}
    verdict = "mode string, q long, faithful boolean, correct boolean"
    first = spark.createDataFrame([("single", 1, True, True), ("single", 2, None, True)], verdict)
    rows = Q.judged(scores, first, spark.createDataFrame([("single", 1, False, True), ("single", 2, True, False)], verdict))
    (r,) = Q.quality_report(rows, ["mode"]).collect()
    assert (r.n, r.n_judged, r.correctness, r.faithfulness, round(r.mrr, 4)) == (3, 2, 0.5, 0.0, round(0.5 / 3, 4))
    assert Q.quality_report(Q.judged(scores, first.limit(0), first), ["mode"]).first().correctness is None
