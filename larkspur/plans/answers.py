"""Queries over shaped results, contexts, answers and their quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import answering as A
from larkspur.operators import quality as Q
from larkspur.operators.shape import REFUSAL
from larkspur.plans.base import query, table

CALLS_SQL = "hits AS (SELECT l_orderkey AS call, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_suppkey % 25 AS doc_id, 'c' || l_partkey AS chunk_id, l_linestatus AS flag, l_returnflag AS section, l_quantity::INT * 10 AS tokens FROM lineitem), folded AS (SELECT *, CASE WHEN flag = 'O' THEN '' || rank ELSE section END AS fold FROM hits QUALIFY row_number() OVER (PARTITION BY call, doc_id, flag = 'O', fold ORDER BY rank) = 1), o AS (SELECT o_custkey AS session, f.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, call, rank) AS k, doc_id || '|' || section AS key FROM folded f JOIN orders ON o_orderkey = call)"
FOLD_SQL = "f AS (SELECT session, k, call, list_value(key) AS fresh, list_value()::VARCHAR[] AS seen, tokens AS used, 'full' AS s FROM o WHERE k = 1 UNION ALL SELECT session, k, call, CASE WHEN s = 'full' THEN list_append(fresh, key) ELSE fresh END, seen, CASE WHEN s = 'full' THEN used + tokens ELSE used END, s FROM (SELECT g.session, o.k, o.call, o.key, o.tokens, g.fresh, g.seen, g.used, CASE WHEN list_contains(g.seen, o.key) THEN 'already_returned' WHEN g.used > 0 AND g.used + o.tokens > 600 THEN 'omitted_budget' ELSE 'full' END AS s FROM (SELECT f.session, f.k, CASE WHEN n.call = f.call THEN f.fresh ELSE [] END AS fresh, CASE WHEN n.call = f.call THEN f.seen ELSE list_concat(f.seen, f.fresh) END AS seen, CASE WHEN n.call = f.call THEN f.used ELSE 0 END AS used FROM f JOIN o n ON n.session = f.session AND n.k = f.k + 1) g JOIN o ON o.session = g.session AND o.k = g.k + 1))"


@query(f"WITH RECURSIVE {CALLS_SQL}, {FOLD_SQL}, c AS (SELECT call, count(*) AS n, count(*) FILTER (WHERE s = 'already_returned') AS already, bool_or(s = 'omitted_budget') AS cut, max(used) AS used, string_agg(s, ',' ORDER BY k) AS statuses FROM f GROUP BY 1), all_hits AS (SELECT call, count(*) AS found FROM hits GROUP BY 1) SELECT o_orderkey AS call, coalesce(n, 0)::INT AS returned_n, (coalesce(found, 0) - coalesce(n, 0))::INT AS section_folded_n, coalesce(already, 0)::INT AS already_returned_n, coalesce(cut, false) AS budget_truncated, coalesce(used, 0)::BIGINT AS context_tokens, o_orderstatus = 'F' AND coalesce(n, 0) > 0 AS rerank_degraded, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN n IS NULL THEN 'empty' WHEN cut THEN 'over_budget' WHEN already > 0 THEN 'already_returned' ELSE '' END AS hint, coalesce(statuses, '') AS statuses FROM orders LEFT JOIN c ON c.call = o_orderkey LEFT JOIN all_hits h ON h.call = o_orderkey")
def retrieve_results(spark, sf):
    """A customer's orders are a session's calls, their items the hits; items of status O are tables."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    requests = o.select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("session"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("rerank"))
    w = Window.partitionBy("call").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    none = F.lit(None).cast("int")
    ranked = li.withColumnRenamed("l_orderkey", "call").withColumn("rank", F.row_number().over(w))  # named first, so that the window's partitions are the calls'
    hits = ranked.select(
        "call", "rank", (F.col("l_suppkey") % 25).alias("doc_id"), F.concat(F.lit("c"), "l_partkey").alias("chunk_id"),
        F.when(F.col("l_linestatus") == "O", "table").otherwise("text").alias("kind"), F.col("l_returnflag").alias("section_id"), F.lit("fused").alias("score_kind"),
        F.lit("section_window").alias("context_status"), F.col("l_returnflag").alias("resolved_section"), none.alias("anchor_start"), none.alias("anchor_end"),
        F.col("l_returnflag").alias("text"), F.lit(None).cast("string").alias("content_raw"), (F.col("l_quantity").cast("int") * 10).alias("n_tokens"),
    )
    out = A.call_results(requests, hits, 600)
    statuses = F.array_join(F.transform("hits", lambda h: F.when(h["context_status"] == "section_window", "full").otherwise(h["context_status"])), ",")
    return out.select("call", "returned_n", "section_folded_n", "already_returned_n", "budget_truncated", "context_tokens", "rerank_degraded", "status", "hint", statuses.alias("statuses"))


QUESTIONS_SQL = "q AS (SELECT conv_id * 100 + turn AS request, conv_id, turn, CASE WHEN contains(text, chr(10)) THEN 'How many [cite:3] ' ELSE '' END || text AS question, CASE WHEN turn > 2 THEN 'text' END AS kind, length(text) > 150 AS rerank FROM conversations WHERE role = 'user'), h AS (SELECT q.request, c.role = 'user' AS leg, abs(c.turn - q.turn) * 2 + (c.turn > q.turn)::INT AS rank, c.conv_id * 100 + c.turn AS chunk_id, c.role, c.conv_id, string_split(c.text, chr(10))[1] AS t, array_to_string(string_split(c.text, chr(10))[2:], chr(10)) AS raw FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn <> q.turn WHERE c.role <> 'system'), b AS (SELECT request, leg, rank, chunk_id, 'conversation ' || conv_id || ' § ' || role AS source, trim(CASE WHEN leg AND raw <> '' AND (length(regexp_replace(raw, '\\s+', '', 'g')) < 40 OR NOT contains(regexp_replace(t, '\\s+', '', 'g'), regexp_replace(raw, '\\s+', '', 'g'))) THEN t || chr(10) || raw ELSE t END, ' ' || chr(10)) AS text, t AS plain FROM h), ctx AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY leg, rank) AS pos, sum(length(text) / 4.0) OVER (PARTITION BY request ORDER BY leg, rank) AS used FROM b WHERE text <> ''), cut AS (SELECT * FROM ctx WHERE used <= 400 OR pos = 1)"


def _questions(spark, sf):
    """A conversation's user turns are questions, its other turns the hits, the nearest first; those of the user are the leg over tables, which hold what follows the first line."""
    c, turn = table(spark, sf, "conversations"), F.col("turn")
    q = c.filter("role = 'user'").select((F.col("conv_id") * 100 + turn).alias("request"), "conv_id", turn.alias("own"), F.concat(F.when(F.col("text").contains("\n"), "How many [cite:3] ").otherwise(""), "text").alias("question"), F.when(turn > 2, "text").alias("kind"), (F.length("text") > 150).alias("rerank"))
    lines = F.split("text", "\n")
    table_like = F.col("role") == "user"
    hits = q.select("request", "conv_id", "own").join(c, "conv_id").filter(turn != F.col("own")).select(
        "request", table_like.cast("int").alias("leg"), (F.abs(turn - F.col("own")) * 2 + (turn > F.col("own")).cast("int")).alias("rank"), (F.col("conv_id") * 100 + turn).alias("chunk_id"), F.col("conv_id").alias("doc_id"),
        F.concat(F.lit("conversation "), "conv_id").alias("title"), F.col("role").alias("section_path"), F.when(table_like, "table").otherwise("text").alias("kind"), F.lit(None).cast("string").alias("context"),
        lines[0].alias("text"), F.array_join(F.slice(lines, 2, 100000), "\n").alias("content_raw"),
        F.lit("t0").alias("acl_tenant"), F.array(F.lit("g_en")).alias("acl_allow"), F.lit("restricted").alias("acl_visibility"), (F.col("role") == "system").alias("acl_unset"),
    )
    return q.drop("conv_id", "own"), hits


USER = ("t0", ["g_en"])


@query(f"WITH {QUESTIONS_SQL} SELECT request, pos::INT AS position, chunk_id, source, md5(text) AS h FROM cut")
def answer_contexts(spark, sf):
    return A.contexts(_questions(spark, sf)[1], *USER, 400).select("request", "position", "chunk_id", "source", F.md5("text").alias("h"))


USER_SQL = "'Passages (data, no orders):' || chr(10) || chr(10) || coalesce(string_agg('[cite:' || pos || '] (source: ' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY pos), '(no passages)') || chr(10) || chr(10) || 'Question: ' || any_value(replace(question, '[cite:3]', '[ref]')) || chr(10) || chr(10) || 'Answer with [cite:n] from the passages:'"


@query(f"WITH {QUESTIONS_SQL} SELECT q.request, count(pos)::INT AS n_contexts, md5({USER_SQL}) AS message FROM q LEFT JOIN cut USING (request) GROUP BY 1")
def answer_messages(spark, sf):
    q, hits = _questions(spark, sf)
    return A.messages(q, A.contexts(hits, *USER, 400)).select("request", "n_contexts", F.md5("user").alias("message"))


REFUSAL_SQL = REFUSAL.replace("'", "''")
TRIES_SQL = f"one AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rank) AS p, sum(length(text) / 4.0) OVER (PARTITION BY request ORDER BY rank) AS u FROM b WHERE NOT leg AND text <> ''), m1 AS (SELECT q.*, m.n, m.ids, CASE WHEN m.n > 0 AND m.words > 120 THEN 'It is so [cite:1] [cite:2]' ELSE '{REFUSAL_SQL}' END AS a1 FROM q LEFT JOIN (SELECT request, count(*) AS n, list(chunk_id ORDER BY p) AS ids, sum(len(regexp_extract_all(text, 'e'))) AS words FROM one WHERE u <= 400 OR p = 1 GROUP BY 1) m USING (request)), m2 AS (SELECT request, count(*) AS n2, list(chunk_id ORDER BY pos) AS ids2, sum(len(regexp_extract_all(text, 'e'))) AS words2 FROM cut GROUP BY 1), t AS (SELECT *, starts_with(question, 'How many') AND kind IS NULL AND a1 NOT LIKE 'It is%' AS again, starts_with(question, 'How many') AND kind IS NULL AND a1 NOT LIKE 'It is%' AND coalesce(words2, 0) > 120 AS kept FROM m1 LEFT JOIN m2 USING (request))"


@query(f"WITH {QUESTIONS_SQL}, {TRIES_SQL} SELECT request, CASE WHEN kept THEN 'It is so [cite:1] [cite:2]' ELSE a1 END AS answer, CASE WHEN kept THEN 'table_leg_retry' WHEN again THEN 'table_leg_retry_discarded' ELSE '' END AS auto, (CASE WHEN kept THEN n2 ELSE coalesce(n, 0) END)::INT AS n_contexts, CASE WHEN kept THEN ids2[1:2] WHEN a1 LIKE 'It is%' THEN ids[1:2] ELSE [] END AS cited, CASE WHEN kept OR a1 LIKE 'It is%' THEN '' ELSE array_to_string(list_filter([CASE WHEN starts_with(question, 'How many') AND kind IS NULL AND NOT again THEN 'tables' END, CASE WHEN NOT rerank AND NOT again THEN 'rerank' END, 'inspect'], lambda x: x IS NOT NULL), ',') END AS hints FROM t")
def smart_answers(spark, sf):
    """The model answers where its passages have over 120 letters e, else it refuses."""
    q, hits = _questions(spark, sf)
    passages = lambda user: F.regexp_replace(F.regexp_extract(user, r"(?s)^Passages[^\n]*\n\n(.*)\n\nQuestion: ", 1), r"(?m)^\[cite:\d+\] \(source: [^\n]*$", "")
    model = lambda system, user: F.when(F.regexp_count(passages(user), F.lit("e")) > 120, "It is so [cite:1] [cite:2]").otherwise(F.lit(REFUSAL))
    out = A.smart_answers(q, hits, model, *USER, 400)
    return out.select("request", "answer", F.array_join("auto", ",").alias("auto"), "n_contexts", "cited", F.array_join("hints", ",").alias("hints"))


RUN_SQL = "items AS (SELECT l_orderkey AS q, l_partkey AS id, l_extendedprice AS price, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS st FROM lineitem), golden AS (SELECT DISTINCT q, id FROM items WHERE flag = 'R'), retrieved AS (SELECT 'single' AS mode, q, id, row_number() OVER (PARTITION BY q ORDER BY price DESC, id) AS rank FROM items QUALIFY rank <= 3 UNION ALL SELECT 'decompose', q, id, row_number() OVER (PARTITION BY q ORDER BY qty DESC, price, id) AS rank FROM items QUALIFY rank <= 5), cited AS (SELECT DISTINCT mode, q, id FROM retrieved WHERE rank <= 2), results AS (SELECT mode, o_orderkey AS q, o_orderpriority AS hop, CASE mode WHEN 'single' THEN 1 ELSE 1 + (o_totalprice > 200000)::INT END AS n_rounds FROM orders, (SELECT unnest(['single', 'decompose']) AS mode)), j1 AS (SELECT mode, o_orderkey AS q, o_orderstatus = 'F' OR mode = 'decompose' AS correct, o_totalprice > 100000 AS faithful FROM results JOIN orders ON o_orderkey = q WHERE o_orderstatus <> 'P'), j2 AS (SELECT mode, o_orderkey AS q, o_totalprice > 150000 AS correct, o_orderpriority < '4' AS faithful FROM results JOIN orders ON o_orderkey = q WHERE mode = 'single' OR o_orderpriority < '5'), gold AS (SELECT r.mode, g.q, avg((h.id IS NOT NULL)::INT) AS hit_frac, min(h.rank) AS rank, avg((c.id IS NOT NULL)::INT) AS citation_frac FROM results r JOIN golden g USING (q) LEFT JOIN (SELECT mode, q, id, min(rank) AS rank FROM retrieved GROUP BY ALL) h ON h.mode = r.mode AND h.q = g.q AND h.id = g.id LEFT JOIN cited c ON c.mode = r.mode AND c.q = g.q AND c.id = g.id GROUP BY 1, 2), sc AS (SELECT r.*, coalesce(hit_frac, 0) AS hit_frac, coalesce(hit_frac, 0) = 1 AS is_full, rank, coalesce(citation_frac, 0) AS citation_frac, j1.correct AND j2.correct AS both_c, j1.faithful AND j2.faithful AS both_f, j1.q IS NOT NULL AND j2.q IS NOT NULL AS known FROM results r LEFT JOIN gold USING (mode, q) LEFT JOIN j1 USING (mode, q) LEFT JOIN j2 USING (mode, q))"


def _run(spark, sf):
    """Orders are questions, their returned parts the golden ids; two modes retrieve items by price and by quantity."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    items = li.select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), "l_returnflag")
    ranked = lambda mode, most, *order: items.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= most).select(F.lit(mode).alias("mode"), "q", "id", "rank")
    retrieved = ranked("single", 3, F.desc("price"), "id").unionByName(ranked("decompose", 5, F.desc("qty"), "price", "id"))
    all_o = o.withColumn("mode", F.explode(F.array(F.lit("single"), F.lit("decompose"))))
    rounds = F.when(F.col("mode") == "single", 1).otherwise(1 + (F.col("o_totalprice") > 200000).cast("int"))
    results = all_o.select("mode", F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("hop"), rounds.alias("n_rounds"))
    own = lambda rows, correct, faithful: rows.select("mode", F.col("o_orderkey").alias("q"), correct.alias("correct"), faithful.alias("faithful"))
    one = own(all_o.filter("o_orderstatus <> 'P'"), (F.col("o_orderstatus") == "F") | (F.col("mode") == "decompose"), F.col("o_totalprice") > 100000)
    two = own(all_o.filter("mode = 'single' or o_orderpriority < '5'"), F.col("o_totalprice") > 150000, F.col("o_orderpriority") < "4")
    scores = Q.answer_scores(results, items.filter("l_returnflag = 'R'"), retrieved, retrieved.filter("rank <= 2"))
    return Q.judged(scores, one, two)


@query(f"WITH {RUN_SQL} SELECT mode, hop, count(*) AS n, count(*) FILTER (WHERE known) AS n_judged, round(avg(hit_frac), 6) AS retrieval_recall, round(avg(is_full::INT), 6) AS retrieval_full, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(citation_frac), 6) AS citation_recall, round(avg(n_rounds), 6) AS avg_rounds, round(avg(both_c::INT) FILTER (WHERE known), 6) AS correctness, round(avg(both_f::INT) FILTER (WHERE known), 6) AS faithfulness FROM sc GROUP BY 1, 2")
def quality_report(spark, sf):
    return Q.quality_report(_run(spark, sf), ["mode", "hop"])


@query(f"WITH {RUN_SQL}, k AS (SELECT s.q, s.both_c::INT AS b, d.both_c::INT AS c FROM sc s JOIN sc d ON d.q = s.q AND d.mode = 'decompose' WHERE s.mode = 'single' AND s.known AND d.known) SELECT 'decompose' AS mode, count(*) AS n, round(avg(b), 6) AS base_mean, round(avg(c), 6) AS mean, round(avg(c) - avg(b), 6) AS delta FROM k")
def mode_pairs(spark, sf):
    return Q.mode_pairs(_run(spark, sf))


@query("WITH items AS (SELECT l_orderkey AS q, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_extendedprice AS a, l_quantity AS b, l_returnflag AS flag FROM lineitem), s AS (SELECT q, id, min(row_number) AS sr FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY a DESC, id) AS row_number FROM items) WHERE row_number <= 4 GROUP BY 1, 2), d AS (SELECT q, id, min(row_number) AS dr FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY b DESC, id) AS row_number FROM items) WHERE row_number <= 4 GROUP BY 1, 2), f AS (SELECT q, w, id, row_number() OVER (PARTITION BY q, w ORDER BY round((1 - w) * coalesce(1.0 / (60 + sr), 0) + w * coalesce(1.0 / (60 + dr), 0), 8) DESC, id) AS rank FROM s FULL JOIN d USING (q, id), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w)), g AS (SELECT DISTINCT q, id FROM items WHERE flag = 'R'), best AS (SELECT q, w, min(rank) AS rank FROM f JOIN g USING (q, id) GROUP BY 1, 2), asked AS (SELECT DISTINCT q, w FROM g, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w)) SELECT w, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce((rank <= 2)::INT, 0)), 6) AS recall FROM asked LEFT JOIN best USING (q, w) GROUP BY 1")
def weight_quality(spark, sf):
    """Items of an order by price and by quantity, the returned ones sought."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_extendedprice", "l_quantity", "l_returnflag")
    ranked = lambda order, name: items.withColumn(name, F.row_number().over(Window.partitionBy("q").orderBy(F.desc(order), "id"))).filter(F.col(name) <= 4).groupBy("q", "id").agg(F.min(name).alias(name))
    return Q.weight_quality(ranked("l_extendedprice", "sparse_rank"), ranked("l_quantity", "dense_rank"), items.filter("l_returnflag = 'R'"), [0.0, 0.25, 0.5, 0.75, 1.0], at=2)
