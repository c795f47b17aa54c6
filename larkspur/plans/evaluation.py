"""Queries over retrieval and chunk quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import evaluate as E
from larkspur.plans.base import query, table

RANKS_SQL = "ranks AS (SELECT doc_id, lang AS kind, CASE WHEN doc_id % 4 = 0 THEN 'dense' ELSE 'sparse' END AS route, CASE WHEN n_chars % 12 > 0 THEN n_chars % 12 END AS rank FROM documents)"


def _ranks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("lang").alias("kind"), F.when(F.col("doc_id") % 4 == 0, "dense").otherwise("sparse").alias("route"), F.when(F.col("n_chars") % 12 > 0, F.col("n_chars") % 12).alias("rank"))


@query(f"WITH {RANKS_SQL} SELECT route, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce((rank <= 5)::INT::DOUBLE, 0)), 6) AS recall FROM ranks GROUP BY 1")
def eval_recall_mrr(spark, sf):
    return E.recall_mrr(_ranks(spark, sf), ["route"])


@query(f"WITH {RANKS_SQL} SELECT route, kind, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ranks GROUP BY GROUPING SETS ((route, kind), (route))")
def eval_by_kind(spark, sf):
    r = _ranks(spark, sf)
    return r.groupingSets([[F.col("route"), F.col("kind")], [F.col("route")]], "route", "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


HOP_SQL = "j AS (SELECT d.lang AS hop, d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality = 1 AND l.toxic = 0 END AS correct FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"WITH {HOP_SQL} SELECT hop, count(*) AS n, count(correct) AS judged, round(avg(correct::INT), 6) AS correctness FROM j GROUP BY 1")
def eval_by_hop(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left").select(F.col("lang").alias("hop"), E.verdict_and(F.col("quality") == 1, F.col("toxic") == 0).alias("correct"))
    return j.groupBy("hop").agg(F.count("*").alias("n"), F.count("correct").alias("judged"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("correctness"))


@query("WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 > 0), b AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) SELECT doc_id, CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN quality = 1 AND toxic = 1 END AS both_true FROM a FULL JOIN b USING (doc_id)")
def two_pass_and(spark, sf):
    """Two lists of verdicts that together name every label."""
    lab = table(spark, sf, "labels")
    a, b = lab.filter("doc_id % 3 > 0").select("doc_id", "quality"), lab.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", "toxic")
    return a.join(b, "doc_id", "full").select("doc_id", E.verdict_and(F.col("quality") == 1, F.col("toxic") == 1).alias("both_true"))


@query("SELECT count(*) AS n, sum(quality - toxic)::BIGINT AS delta, count(*) FILTER (WHERE quality > toxic) AS better, count(*) FILTER (WHERE quality < toxic) AS worse FROM labels")
def paired_delta(spark, sf):
    lab = table(spark, sf, "labels")
    one, two = lab.select("doc_id", F.col("quality").alias("a")), lab.select("doc_id", F.col("toxic").alias("b"))
    return one.join(two, "doc_id").agg(F.count("*").alias("n"), F.sum((F.col("a") - F.col("b")).cast("long")).alias("delta"), F.count_if(F.col("a") > F.col("b")).alias("better"), F.count_if(F.col("a") < F.col("b")).alias("worse"))


LISTS_SQL = "l AS (SELECT doc_id, [doc_id % 3, 3 + doc_id % 2, 7] AS a, [doc_id % 4, 3, 7] AS b FROM documents)"


@query(f"WITH {LISTS_SQL} SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard, CASE WHEN a[1] <> b[1] THEN 1 WHEN a[2] <> b[2] THEN 2 ELSE 0 END AS first_diff, a[1] = b[1] AS top1 FROM l")
def ranking_overlap(spark, sf):
    d = F.col("doc_id")
    seven = F.lit(7).cast("bigint")
    a, b = F.array(d % 3, 3 + d % 2, seven), F.array(d % 4, F.lit(3).cast("bigint"), seven)
    return table(spark, sf, "documents").select(d, F.round(E.jaccard(a, b), 6).alias("jaccard"), E.first_divergence(a, b).alias("first_diff"), (a[0] == b[0]).alias("top1"))


@query("WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM o WHERE n <= 4 OR pos IN (0, round_even((n - 1) / 3.0, 0), round_even(2 * (n - 1) / 3.0, 0), n - 1)")
def pick_evenly(spark, sf):
    return E.pick_evenly(table(spark, sf, "documents").select("source", "doc_id"), 4, "source", ["doc_id"]).select("source", "doc_id")


@query("WITH RECURSIVE o AS (SELECT source, sum(n_chars)::BIGINT AS s, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS k FROM documents GROUP BY 1), f AS (SELECT source AS item, 0 AS key, k, [s, 0, 0] AS load FROM o WHERE k = 1 UNION ALL SELECT o.source, list_position(load, list_min(load)) - 1, o.k, list_transform(load, lambda v, i: CASE WHEN i = list_position(load, list_min(load)) THEN v + o.s ELSE v END) FROM f JOIN o ON o.k = f.k + 1) SELECT item, key::INT AS key FROM f")
def assign_keys(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("item")).agg(F.sum("n_chars").alias("size"))
    return E.assign_keys(d)


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'out_of_range' WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 'unlocalized_threshold' WHEN doc_id % 4 = 0 THEN 'unlocalized_zero' WHEN n_chars % 3 = 0 THEN 'missing' WHEN n_chars % 3 = 1 THEN 'single' ELSE 'split' END AS verdict FROM documents")
def evidence_verdict(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(d, E.evidence_verdict(d % 9 != 0, d % 4 != 0, d % 8 == 0, F.col("n_chars") % 3).alias("verdict"))


BOX_SQL = "b AS (SELECT l_orderkey % 2000 AS doc, l_linenumber % 2 AS page, l_quantity AS x0, l_quantity + 10 AS x1, l_discount * 100 AS y0, l_discount * 100 + 5 AS y1 FROM lineitem), e AS (SELECT p_partkey, p_partkey % 2000 AS doc, p_size % 2 AS page, p_size AS x0, p_size + 8 AS x1, 2 AS y0, 6 AS y1 FROM part)"


@query(f"WITH {BOX_SQL}, o AS (SELECT p_partkey, greatest(0, least(b.x1, e.x1) - greatest(b.x0, e.x0)) * greatest(0, least(b.y1, e.y1) - greatest(b.y0, e.y0)) AS a FROM b JOIN e USING (doc, page)) SELECT p_partkey, count(*) AS n, round(sum(a), 3) AS total FROM o WHERE a >= 0.3 * 32 OR a >= 0.5 * 50 GROUP BY 1")
def evidence_overlap(spark, sf):
    """Boxes meet within a document's page. Equal boxes of a page meet once, with their number, so pairs don't grow with their copies."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    d = lambda c: F.col(c).cast("double")
    b = li.select((F.col("l_orderkey") % 2000).alias("doc"), (F.col("l_linenumber") % 2).alias("page"), d("l_quantity").alias("x0"), (d("l_quantity") + 10).alias("x1"), (d("l_discount") * 100).alias("y0"), (d("l_discount") * 100 + 5).alias("y1"))
    e = p.select("p_partkey", (F.col("p_partkey") % 2000).alias("doc"), (F.col("p_size") % 2).alias("page"), d("p_size").alias("a0"), (d("p_size") + 8).alias("a1"), F.lit(2.0).alias("b0"), F.lit(6.0).alias("b1"))
    return E.overlaps(e, b, ["doc", "page"], "p_partkey", 0.5 * 50)


@query("SELECT lang, round(sum(length(text)) / sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')))::DOUBLE, 6) AS ratio FROM documents GROUP BY 1")
def chars_per_token(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.round(F.sum(F.length("text")) / F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\x0b\f\r]+)"), F.lit(1)))), 6).alias("ratio"))


@query("SELECT source, doc_id FROM documents WHERE n_chars BETWEEN 150 AND 900 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text)::DOUBLE > 0.6 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4")
def semantic_candidates(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("n_chars").between(150, 900)).filter(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.length("text") > 0.6)
    return d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("k <= 4").select("source", "doc_id")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, left(sha1(text), 12) AS fp FROM documents) SELECT doc_id, fp, ((rn - 1) // 8)::BIGINT AS batch FROM r")
def judge_batches(spark, sf):
    d = E.numbered(table(spark, sf, "documents").select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("fp")), "doc_id", width=256)
    return d.select("doc_id", "fp", F.floor(F.col("no") / 8).alias("batch"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_lang, round(median(n_chars), 2) AS median_chars, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 1) AS pct_en FROM documents GROUP BY 1")
def verdict_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_lang"), F.round(F.median("n_chars"), 2).alias("median_chars"), F.round(100.0 * F.count_if(F.col("lang") == "en") / F.count("*"), 1).alias("pct_en"))


VERDICTS_SQL = "v AS (SELECT source AS strategy, lang = 'en' AS is_text, CASE n_chars % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'split' WHEN 2 THEN 'missing' WHEN 3 THEN 'out_of_range' ELSE 'single' END AS verdict FROM documents)"


@query(f"WITH {VERDICTS_SQL}, s AS (SELECT *, 'all' AS scope FROM v UNION ALL SELECT *, 'text_only' FROM v WHERE is_text) SELECT strategy, scope, count(*) FILTER (WHERE verdict <> 'out_of_range') AS localized, count(*) FILTER (WHERE verdict = 'out_of_range') AS excluded, round(100.0 * count(*) FILTER (WHERE verdict = 'single') / nullif(count(*) FILTER (WHERE verdict <> 'out_of_range'), 0), 1) AS single_pct, round(100.0 * count(*) FILTER (WHERE verdict = 'split') / nullif(count(*) FILTER (WHERE verdict <> 'out_of_range'), 0), 1) AS split_pct, round(100.0 * count(*) FILTER (WHERE verdict = 'missing') / nullif(count(*) FILTER (WHERE verdict <> 'out_of_range'), 0), 1) AS missing_pct FROM s GROUP BY 1, 2")
def strategy_comparison(spark, sf):
    k = F.col("n_chars") % 5
    verdict = F.when(k == 1, "split").when(k == 2, "missing").when(k == 3, "out_of_range").otherwise("single")
    return E.strategy_comparison(table(spark, sf, "documents").select(F.col("source").alias("strategy"), (F.col("lang") == "en").alias("is_text"), verdict.alias("verdict")))


@query("WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_no, unnest([l_linenumber, l_linenumber + 1]) AS idx FROM lineitem) SELECT doc_id, idx::INT AS idx, max(chunk_no)::VARCHAR AS chunk_id FROM c GROUP BY 1, 2")
def chunk_of_element(spark, sf):
    n = F.col("l_linenumber")
    return E.chunk_of_element(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("chunk_no"), n.cast("string").alias("chunk_id"), F.array(n, n + 1).alias("source_indices")))


@query("WITH c AS (SELECT label AS grp, list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: round(x, 2))) AS cos FROM embeddings) SELECT grp, round(min(cos), 6) AS low, round(avg(cos), 6) AS mean, round(min(cos), 6) >= 0.999 AND round(avg(cos), 6) >= 0.9999 AS passed FROM c GROUP BY 1")
def equivalence_gate(spark, sf):
    from larkspur.functions.vector import cosine

    near = F.transform("embedding", lambda x: F.round(x.cast("double"), 2))
    return E.equivalence_gate(table(spark, sf, "embeddings").select(F.col("label").alias("grp"), cosine(F.col("embedding"), near).alias("cos")))


@query("SELECT event_type AS route, count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, round(count(*) * 1e6 / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0), 6) AS per_second FROM events GROUP BY 1")
def request_throughput(spark, sf):
    return E.throughput(table(spark, sf, "events").select(F.col("event_type").alias("route"), "ts", (F.col("event_id") % 9 == 0).alias("is_error")))


@query("WITH n AS (SELECT 'k' || doc_id % 3 AS api_key, lang AS language, doc_id, row_number() OVER (PARTITION BY doc_id % 3, lang ORDER BY doc_id) - 1 AS no FROM documents) SELECT api_key, language, (no // 20)::BIGINT AS batch, list_sort(list(doc_id)) AS docs FROM n GROUP BY 1, 2, 3")
def upload_batches(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("k"), F.col("doc_id") % 3).alias("api_key"), F.col("lang").alias("language"), "doc_id")
    return E.upload_batches(d, 20)


@query("SELECT 'k' || user_id % 3 AS api_key, count(*) FILTER (WHERE event_id % 5 > 1) AS ok, count(*) FILTER (WHERE event_id % 5 = 0) AS failed, count(*) FILTER (WHERE event_id % 5 = 1) AS timeout FROM events GROUP BY 1")
def upload_outcome(spark, sf):
    k = F.col("event_id") % 5
    return E.upload_outcome(table(spark, sf, "events").select(F.concat(F.lit("k"), F.col("user_id") % 3).alias("api_key"), F.when(k == 0, "failed").when(k == 1, "timeout").otherwise("ok").alias("status")))


@query("WITH g AS (SELECT o_orderkey AS q, (o_orderkey * 7) % 200 + 1 AS id FROM orders), r AS (SELECT l_orderkey AS q, l_partkey % 200 + 1 AS id, l_linenumber AS rank FROM lineitem) SELECT g.q, min(rank)::INT AS rank FROM g LEFT JOIN r USING (q, id) GROUP BY 1")
def best_ranks(spark, sf):
    g = table(spark, sf, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_orderkey") * 7 % 200 + 1).alias("id"))
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 200 + 1).alias("id"), F.col("l_linenumber").cast("int").alias("rank"))
    return E.best_rank(r, g, "q")


@query("WITH r AS (SELECT l_orderkey AS q, list_distinct(list(l_returnflag)) AS found FROM lineitem GROUP BY 1) SELECT q, len(list_intersect(['A', 'R'], found)) = 2 AS covered FROM r")
def golden_covered(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_returnflag").alias("found"))
    return r.select("q", E.covers(F.array(F.lit("A"), F.lit("R")), F.col("found")).alias("covered"))


@query("WITH r AS (SELECT p_partkey AS key, p_size AS rank, 0 AS leg FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, p_size + 100, 1 FROM part WHERE p_size % 3 = 0), f AS (SELECT key, leg, rank FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY leg, rank) = 1) SELECT key, leg, rank::INT AS rank, row_number() OVER (ORDER BY leg, rank, key)::INT AS position FROM f ORDER BY leg, rank, key LIMIT 14")
def first_of_legs(spark, sf):
    p = table(spark, sf, "part")
    one, two = p.filter("p_size <= 10"), p.filter("p_size % 3 = 0")
    legs = [one.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("rank")), two.select(F.col("p_partkey").alias("key"), (F.col("p_size") + 100).alias("rank"))]
    return E.first_of_legs(legs, "key", 14).select("key", "leg", F.col("rank").cast("int").alias("rank"), "position")


@query("SELECT l_orderkey AS doc_id, count(*) AS n, CASE WHEN count(*) >= 4 THEN round(median(l_extendedprice / [1, 2, 4][l_linenumber % 3 + 1]), 6) END AS scale FROM lineitem GROUP BY 1")
def document_scale(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.pow(F.lit(2), F.col("l_linenumber") % 3).alias("a"), F.col("l_extendedprice").alias("b"))
    return E.document_scale(li).withColumn("scale", F.round("scale", 6))


@query("WITH b AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS b FROM documents WHERE n_chars < 2000), own AS (SELECT doc_id, left(b, 60) AS k FROM b WHERE length(b) >= 20), parts AS (SELECT doc_id, 0 AS chunk_id, b AS c FROM b UNION ALL SELECT doc_id, 1, substr(b, 5) FROM b) SELECT own.doc_id, 0 AS idx, count(DISTINCT chunk_id) FILTER (WHERE contains(c, k)) AS n FROM own LEFT JOIN parts USING (doc_id) GROUP BY 1".replace(" WHERE n_chars < 2000", ""))
def held_elements(spark, sf):
    """A document's beginning is looked for in the whole text and in the text from its fifth letter on."""
    d = table(spark, sf, "documents")
    bare = F.regexp_replace(F.lower("text"), r"\s+", "")
    chunks = d.select("doc_id", F.lit(0).alias("chunk_id"), "text").unionByName(d.select("doc_id", F.lit(1).alias("chunk_id"), F.substr(bare, F.lit(5)).alias("text")))
    return E.held_elements(d.select("doc_id", F.lit(0).alias("idx"), "text"), chunks)


@query("WITH c AS (SELECT l_orderkey AS doc_id, 'y' || l_orderkey % 5 AS doc_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS chunk_no, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), one AS (SELECT doc_id, chunk_no, 'single' AS unit FROM c WHERE n <= 4 OR chunk_no IN (0, round_even((n - 1) / 3.0, 0), round_even(2 * (n - 1) / 3.0, 0), n - 1)), intra AS (SELECT doc_id, chunk_no, 'intra' AS unit FROM c WHERE n >= 3 AND chunk_no < 3), types AS (SELECT DISTINCT doc_type, doc_id FROM c), chosen AS (SELECT doc_id FROM types QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY doc_id) <= 2), across AS (SELECT doc_id, chunk_no, 'cross' AS unit FROM c WHERE doc_id IN (SELECT doc_id FROM chosen) AND chunk_no < 3) SELECT * FROM one UNION ALL SELECT * FROM intra UNION ALL SELECT * FROM across")
def gold_units(spark, sf):
    li = table(spark, sf, "lineitem")
    li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // 500_000)), "l_orderkey")  # windows of an order's rows sort half a million at most; the rows are counted by footers
    c = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("y"), F.col("l_orderkey") % 5).alias("doc_type"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1).cast("long").alias("chunk_no"))
    return E.gold_units(c)


@query("WITH t AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS chunk_no, 'total ' || p_size AS answer, repeat('<td>' || p_name || '</td>', 12) || CASE WHEN p_partkey % 2 = 0 THEN '<td>' || p_size || '</td>' ELSE '' END AS body FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE length(body) >= 120), e AS (SELECT * FROM o WHERE n <= 4 OR pos IN (0, round_even((n - 1) / 3.0, 0), round_even(2 * (n - 1) / 3.0, 0), n - 1)) SELECT doc_id, chunk_no FROM e WHERE length(split_part(answer, ' ', 2)) >= 2 AND contains(replace(replace(body, ',', ''), ' ', ''), split_part(answer, ' ', 2)) ORDER BY 1, 2 LIMIT 16")
def table_questions(spark, sf):
    p = table(spark, sf, "part")
    cell = F.concat(F.lit("<td>"), "p_name", F.lit("</td>"))
    body = F.concat(F.repeat(cell, 12), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<td>"), "p_size", F.lit("</td>"))).otherwise(""))
    t = p.select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("chunk_no"), F.concat(F.lit("total "), "p_size").alias("answer"), body.alias("body"))
    return E.table_questions(t).select("doc_id", "chunk_no")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def eval_corpus(spark, sf):
    return E.first_of_each(table(spark, sf, "documents").select("source", "doc_id"), 3, "source", ["doc_id"])
