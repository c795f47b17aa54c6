"""Queries over budgets, deliveries, tables and request logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import shape as S
from larkspur.operators import tables as T
from larkspur.operators.evaluate import request_stats
from larkspur.plans.base import query, table
from larkspur.sources.readers import elements_from_json, merge_flags
from larkspur.sources.sinks import upsert

RANKED_SQL = "ranked AS (SELECT conv_id AS session, turn AS rank, greatest(length(text) // 4, 1) AS tokens FROM conversations)"


def _ranked(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("rank"), S.hit_tokens(F.lit(None), F.col("text"), F.lit(None)).alias("tokens"))


@query(f"WITH RECURSIVE {RANKED_SQL}, o AS (SELECT session, rank, tokens, row_number() OVER (PARTITION BY session ORDER BY rank, tokens) AS k FROM ranked), f AS (SELECT session, rank, tokens, k, true AS delivered, tokens AS used FROM o WHERE k = 1 UNION ALL SELECT o.session, o.rank, o.tokens, o.k, f.used + o.tokens <= 60, f.used + CASE WHEN f.used + o.tokens <= 60 THEN o.tokens ELSE 0 END FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1) SELECT session, rank::INT AS rank, tokens::BIGINT AS tokens, delivered FROM f")
def token_budget_fold(spark, sf):
    return S.skip_over_budget(_ranked(spark, sf), 60)


@query(f"WITH {RANKED_SQL}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY rank) AS used FROM ranked) SELECT session, rank::INT AS rank, tokens::BIGINT AS tokens FROM s WHERE used <= 60 OR rank = (SELECT min(rank) FROM ranked r WHERE r.session = s.session)")
def prefix_budget(spark, sf):
    return S.prefix_budget(_ranked(spark, sf), 60)


@query("SELECT event_id, coalesce(max((event_id % 3 > 0)::INT) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS already_returned FROM events")
def already_returned(spark, sf):
    """Every third event was not given."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.col("event_id").alias("at"), (F.col("event_id") % 3 > 0).alias("given"))
    return S.first_deliveries(e, delivered="given").select("event_id", "already_returned")


@query(f"WITH RECURSIVE r AS (SELECT conv_id AS session, turn AS rank, md5(text) AS key, greatest(length(text) // 4, 1) AS tokens FROM conversations), seen AS (SELECT DISTINCT session, key FROM r WHERE rank % 4 = 1), h AS (SELECT r.*, s.key IS NOT NULL AS again FROM r LEFT JOIN seen s USING (session, key)), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rank) AS k FROM h WHERE NOT again), f AS (SELECT session, rank, k, true AS given, tokens AS used FROM o WHERE k = 1 UNION ALL SELECT o.session, o.rank, o.k, f.used + o.tokens <= 60, f.used + CASE WHEN f.used + o.tokens <= 60 THEN o.tokens ELSE 0 END FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1) SELECT h.session, h.rank::INT AS rank, CASE WHEN h.again THEN 'already_returned' WHEN f.given THEN 'full' ELSE 'omitted_budget' END AS status FROM h LEFT JOIN f ON f.session = h.session AND f.rank = h.rank")
def delivered_hits(spark, sf):
    """A conversation's turns as hits; it was given those of every fourth turn before."""
    hits = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("rank"), F.md5("text").alias("key"), S.hit_tokens(F.lit(None), F.col("text"), F.lit(None)).alias("tokens"))
    return S.delivered(hits, hits.filter("rank % 4 = 1"), 60).select("session", "rank", "status")


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'no_identity' WHEN trim(props) = '' OR event_id % 5 = 0 THEN 'empty_query' WHEN event_id % 3 = 0 OR event_type = 'view' THEN 'bad_arg' END AS status FROM events")
def argument_errors(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    status = S.argument_error(F.when(F.col("user_id") % 7 > 0, "t"), F.when(n % 5 == 0, "  ").otherwise(F.col("props")), F.when(n % 3 > 0, 5).when(n % 2 > 0, 0).otherwise(-1), F.lit("full"), F.when(F.col("event_type") == "view", "guess").otherwise("hybrid"))
    return e.select("event_id", status.alias("status"))


@query("WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 4 > 0 THEN lang END AS doc_type FROM documents) SELECT coalesce(doc_type, 'unknown') AS doc_type, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM t GROUP BY 1")
def list_documents_coverage(spark, sf):
    d = table(spark, sf, "documents").withColumn("doc_type", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    return d.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("n_sources"))


@query("SELECT doc_id, list_filter([CASE WHEN n_chars > 1000 THEN 'narrow' END, CASE WHEN lang <> 'en' THEN 'translate' END, CASE WHEN doc_id % 2 = 0 THEN 'table' END, CASE WHEN doc_id % 3 = 0 THEN 'expand' END], lambda x: x IS NOT NULL)[1:3] AS hints FROM documents")
def hints(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(d, S.hints([(F.col("n_chars") > 1000, "narrow"), (F.col("lang") != "en", "translate"), (d % 2 == 0, "table"), (d % 3 == 0, "expand")]).alias("hints"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 > 0 AS retry FROM documents")
def smart_retry(spark, sf):
    d = F.col("doc_id")
    q, a = F.when(d % 2 == 0, "How much profit").otherwise("Who"), F.when(d % 3 == 0, "No relevant information here").otherwise("It is so")
    return table(spark, sf, "documents").select(d, S.wants_table_retry(q, a, F.when(d % 5 == 0, "table")).alias("retry"))


@query("SELECT page_id, md5(CASE WHEN page_id % 3 = 0 AND html <> '' THEN 'cap' || chr(10) || html ELSE 'cap' END) AS text FROM pages")
def raw_appended(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "table").otherwise("text")
    return table(spark, sf, "pages").select("page_id", F.md5(S.append_raw(F.lit("cap"), F.col("html"), kind)).alias("text"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'no_identity' WHEN 1 THEN 'redirected' WHEN 2 THEN 'bad_request' WHEN 3 THEN 'backend_unavailable' WHEN 4 THEN 'bad_response' ELSE 'ok' END AS status, event_id % 6 IN (0, 2, 3) AS is_error FROM events")
def http_mapping(spark, sf):
    k = F.col("event_id") % 6
    code = F.when(k == 0, 401).when(k == 1, 302).when(k == 2, 404).when(k == 3, 503).otherwise(200)
    return table(spark, sf, "events").select("event_id", S.http_status(code, k == 5).alias("status"), S.is_error(code, F.lit("ok")).alias("is_error"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events), v AS (SELECT event_type AS route, count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, list_sort(list(value) FILTER (WHERE rn <= 1000)) AS v FROM r GROUP BY 1) SELECT route, n, errors, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95, v[least(len(v) - 1, floor(0.95 * len(v)))::INT + 1] AS p95_floor, v[-1] AS max_ms FROM v")
def endpoint_percentiles(spark, sf):
    e = table(spark, sf, "events")
    return request_stats(e.select(F.col("event_type").alias("route"), "ts", F.col("event_id").alias("id"), F.col("value").alias("ms"), (F.col("event_id") % 9 == 0).alias("is_error")))


@query("SELECT p_partkey, CASE WHEN p_size <= 40 THEN 1 ELSE 2 END AS n, CASE WHEN p_size <= 40 THEN p_size ELSE p_size + 1 END AS cells FROM part")
def col_slices(spark, sf):
    s = T.column_slices(F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.size(s).alias("n"), F.size(F.flatten(s)).alias("cells"))


def _sheets(spark, sf):
    """Orders as sheets: a customer's orders are the rows, below a header of two rows of which some cells are merged."""
    o = table(spark, sf, "orders")
    names = {"o_orderkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "s", "o_orderpriority": "s"}
    parts = F.array(*[F.struct(F.col(c).cast("string").alias("value"), F.lit(t).alias("vtype")) for c, t in names.items()])
    body = o.select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1).alias("row"), F.posexplode(parts).alias("col", "x")).select("doc_id", "row", "col", "x.*")
    heads = F.array(F.array(*[F.lit(x) for x in ("order", "", "value", "", "when")]), F.array(*[F.lit(c) for c in names]))
    head = o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.posexplode(heads).alias("row", "h")).select("doc_id", "row", F.posexplode("h").alias("col", "value"), F.lit("s").alias("vtype"))
    merges = head.filter("row = 0 and col = 0").select("doc_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("r1", "c1", "r2", "c2"), m)]) for m in ((0, 0, 0, 1), (0, 2, 0, 3), (0, 4, 1, 4))])).alias("m")).select("doc_id", F.lit("orders").alias("sheet"), "m.*")
    return head.unionByName(body).withColumn("sheet", F.lit("orders")), merges


@query()
def sheet_chunks(spark, sf):
    return T.chunk_sheets(*_sheets(spark, sf)).select("doc_id", "sheet", "part", "kind", "row_start", "row_end", F.md5("text").alias("h"))


@query("SELECT o_custkey AS doc_id, o_custkey || '::sheet::orders' AS sec_id, 'orders' AS title, 0 AS idx FROM orders GROUP BY 1")
def sheet_sections(spark, sf):
    cells, merges = _sheets(spark, sf)
    return T.sheet_elements(T.chunk_sheets(cells, merges))[1].select("doc_id", "sec_id", "title", "idx")


@query("SELECT doc_id, idx, CASE WHEN idx = 0 THEN 'text' ELSE 'image' END AS kind, CASE WHEN idx = 0 THEN md5(text) END AS text, CASE WHEN idx = 1 THEN 'cap ' || lang ELSE '' END AS caption, idx AS page FROM documents, (SELECT unnest([0, 1])::INT AS idx)")
def content_list_elements(spark, sf):
    d = table(spark, sf, "documents")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text", F.lit(0).alias("page_idx"), F.lit(None).cast("array<string>").alias("image_caption")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("page_idx"), F.array(F.lit("cap"), F.col("lang")).alias("image_caption"))))
    return elements_from_json(d.select("doc_id", blocks.alias("json"))).select("doc_id", "idx", "kind", F.md5("text").alias("text"), F.coalesce("caption", F.lit("")).alias("caption"), "page")


@query("WITH k AS (SELECT doc_id, left(regexp_replace(lower(text), '\\s+', '', 'g'), 24) AS k, n_chars FROM documents) SELECT doc_id, length(k) >= 6 AND n_chars % 5 > 0 AND doc_id % 2 = 0 AS merge_prev FROM k")
def merge_lookup(spark, sf):
    """Tables (here some documents) never go on over a page."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("idx"), F.when(F.col("n_chars") % 5 == 0, "table").otherwise("list").alias("kind"), F.lit(0).alias("page"), "text")
    layout = d.select("doc_id", "page", F.lit(3).alias("pos"), "text", (F.col("doc_id") % 2 == 0).alias("merge_prev"))
    return merge_flags(d, layout.unionByName(layout.withColumn("pos", F.lit(5)).withColumn("merge_prev", F.lit(True)))).select("doc_id", "merge_prev")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 10 > 0 UNION ALL SELECT doc_id, source, -1 FROM documents WHERE doc_id % 10 = 0")
def upsert_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return upsert(d, d.filter("doc_id % 10 = 0").withColumn("n_chars", F.lit(-1).cast("long")), "doc_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """The same windows from a stream over all there is, which ends by itself."""
    from larkspur.session import shared_dir
    from larkspur.streaming.sessions import run_available, tumbling

    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"windows_{uuid.uuid4().hex}"
    out = run_available(tumbling(stream), name, "complete", f"{shared_dir(spark)}/larkspur-{name}")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
