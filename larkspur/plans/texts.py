"""Queries over text functions and access control."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import acl
from larkspur.operators.shape import MOCK, REFUSAL, mock_answer, prompt
from larkspur.plans.base import DOCS_SQL, TOKENS_SQL, USERS_SQL, documents, query, table, users


@query("SELECT doc_id, round(length(text) / (CASE WHEN lower(lang) LIKE 'ch%' OR lower(lang) LIKE 'zh%' THEN 1.7 ELSE 4.0 END), 4) AS tokens FROM documents")
def est_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.est_tokens(F.col("text"), F.col("lang")), 4).alias("tokens"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h, md5(left(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', '', 'g'), 24)) AS k FROM documents")
def norm_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.norm_text(t)).alias("h"), F.md5(X.squashed(t, 24)).alias("k"))


@query(f"WITH docs AS (SELECT * FROM documents), {TOKENS_SQL} SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS h FROM toks")
def tokenize(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("h"))


@query("SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), (i * 2 + 1)::INT, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h FROM pages")
def fnv1a(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.fnv1a32(F.col("url")).alias("h"))


@query()
def uuid5_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.uuid5_url(F.col("url")).alias("uuid"))


@query("SELECT doc_id, md5(regexp_replace('[cite:' || doc_id || '] and [ CITE : 7 ] in ' || text || ' [cite:2]', '(?i)\\[\\s*cite\\s*:\\s*(\\d+)\\s*\\]', '[ref]', 'g')) AS clean FROM documents")
def neutralize_citations(spark, sf):
    raw = F.concat(F.lit("[cite:"), "doc_id", F.lit("] and [ CITE : 7 ] in "), "text", F.lit(" [cite:2]"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.neutralize(raw)).alias("clean"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter([(doc_id % 7)::INT, 3, (doc_id % 5)::INT, 3], lambda n: n >= 1 AND n <= 4))) AS cites FROM documents")
def parse_citations(spark, sf):
    answer = F.concat(F.lit("a [cite:"), F.col("doc_id") % 7, F.lit("] b [Cite : 3] c [ cite:"), F.col("doc_id") % 5, F.lit("] d [cite:3]"))
    return table(spark, sf, "documents").select("doc_id", X.citations(answer, F.lit(4)).alias("cites"))


@query("SELECT conv_id, turn, regexp_matches(text, '(?i)[0-9]|how\\s+(?:much|many)|percent|revenue|income|profit|price|cost|amount|total') AS is_numeric, regexp_matches(text, '(?i)don''?t have enough|not contain|no (?:relevant )?information|unable to answer|cannot answer|not explicitly stated|not (?:directly )?provided') AS refusal FROM conversations")
def answer_signals(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.looks_numeric(F.col("text")).alias("is_numeric"), X.is_refusal(F.col("text")).alias("refusal"))


@query("SELECT conv_id, md5(string_agg('[cite:' || (turn + 1) || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY 1")
def build_prompt(spark, sf):
    """All turns of a conversation as contexts."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.md5(prompt(F.col("t.text"))).alias("prompt"))


@query(f"SELECT conv_id, CASE WHEN max(turn) % 4 = 0 THEN '{REFUSAL.replace(chr(39), chr(39) * 2)}' ELSE '{MOCK[0]}[cite:1]' || CASE WHEN count(*) > 1 THEN '[cite:2]' ELSE '' END || '{MOCK[1]}' END AS answer FROM conversations GROUP BY 1")
def mock_llm(spark, sf):
    """The answer to a conversation's turns as contexts; to none where the last turn's number is a multiple of four. Markers that a text writes otherwise don't count."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    message = F.when(F.col("last") % 4 == 0, "no contexts but [ CITE : 7 ]").otherwise(prompt(F.col("t.text")))
    return c.select("conv_id", mock_answer(message).alias("answer"))


@query("SELECT doc_id, left(regexp_replace(source || '/' || text, '[^A-Za-z0-9._-]', '_', 'g'), 120) AS slug, left(sha1(text), 12) AS qhash, length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(text)::DOUBLE > 0.2 AS zh FROM documents")
def slugs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.slug(F.concat("source", F.lit("/"), "text")).alias("slug"), X.query_hash(F.col("text")).alias("qhash"), (X.cjk_share(F.col("text")) > 0.2).alias("zh"))


@query(f"WITH {DOCS_SQL}, {USERS_SQL} SELECT u.name, d.doc_id FROM users u JOIN docs d ON NOT acl_unset AND acl_tenant <> '' AND acl_tenant = u.tenant AND (len(list_intersect(acl_allow, principals)) > 0 OR acl_visibility = 'public')")
def acl_matrix(spark, sf):
    d, u = documents(spark, sf), users(spark)
    cond = acl.admits(F.col("tenant"), F.col("principals"), *[F.col(c) for c in ("acl_tenant", "acl_allow", "acl_visibility", "acl_unset")])
    return d.join(F.broadcast(u), (F.col("tenant") == F.col("acl_tenant")) & cond).select("name", "doc_id")


@query(f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE NOT acl_unset AND acl_tenant = 't0' AND (acl_visibility = 'public' OR list_contains(acl_allow, 'g_en')) AND lang = 'en'")
def acl_visible_docs(spark, sf):
    return acl.visible(documents(spark, sf), "t0", ["g_en"], doc_ids=[]).filter("lang = 'en'").select("doc_id")


@query(f"WITH {DOCS_SQL}, {USERS_SQL}, got AS (SELECT u.name, d.doc_id, d.acl_tenant, d.acl_visibility, d.acl_allow, d.acl_unset, u.tenant, u.principals FROM users u JOIN docs d ON NOT acl_unset AND acl_tenant = u.tenant AND (list_has_any(acl_allow, principals) OR acl_visibility = 'public')) SELECT u.name, count(g.doc_id) AS n_seen, count(*) FILTER (WHERE g.doc_id IS NOT NULL AND (g.acl_unset OR g.acl_tenant <> g.tenant)) AS n_leaked FROM users u LEFT JOIN got g USING (name) GROUP BY 1")
def acl_leaks(spark, sf):
    got = acl_matrix(spark, sf)
    wrong = documents(spark, sf).select("doc_id", "acl_unset", "acl_tenant")
    seen = got.join(F.broadcast(users(spark)), "name").join(wrong, "doc_id")
    n = seen.groupBy("name").agg(F.count("*").alias("n_seen"), F.count_if(F.col("acl_unset") | (F.col("acl_tenant") != F.col("tenant"))).alias("n_leaked"))
    return users(spark).select("name").join(n, "name", "left").na.fill(0)


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 5 > 0 THEN 't' || doc_id % 2 ELSE '' END, ''), '') AS acl_tenant, [ 'g_' || lang ] AS acl_allow, CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE 'restricted' END AS acl_visibility, (doc_id % 17 = 0 OR doc_id % 5 = 0) AS acl_unset FROM documents")
def acl_split(spark, sf):
    d = table(spark, sf, "documents")
    own = F.struct(F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("t"), F.col("doc_id") % 2)).alias("tenant"), F.array(F.concat(F.lit("g_"), "lang")).alias("allow"), F.when(F.col("doc_id") % 3 == 0, "public").alias("visibility"), (F.col("doc_id") % 17 == 0).alias("unset"))
    return d.withColumn("acl", own).select("doc_id", *[c.alias(n) for n, c in acl.split(F.col("acl")).items()])


@query("WITH p AS (SELECT l_orderkey % 50 AS doc_id, l_partkey % 20 AS idx, l_linenumber AS chunk_no, CASE WHEN l_suppkey % 2 = 0 THEN 'public' ELSE 'restricted' END AS vis, l_suppkey % 3 > 0 AS is_set, (l_suppkey % 4)::INT AS n, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY (vis = 'public')::INT, is_set::INT, n, chunk_no DESC) AS k FROM p) SELECT doc_id, idx, vis AS acl_visibility, NOT is_set AS acl_unset, n AS allowed FROM r WHERE k = 1")
def acl_strictest(spark, sf):
    li = table(spark, sf, "lineitem")
    n = (F.col("l_suppkey") % 4).cast("int")
    pairs = li.select((F.col("l_orderkey") % 50).alias("doc_id"), (F.col("l_partkey") % 20).alias("idx"), F.col("l_linenumber").alias("chunk_no"), F.lit("t0").alias("acl_tenant"), F.when(n > 0, F.array_repeat(F.lit("g"), n)).otherwise(F.array().cast("array<string>")).alias("acl_allow"), F.when(F.col("l_suppkey") % 2 == 0, "public").otherwise("restricted").alias("acl_visibility"), (F.col("l_suppkey") % 3 == 0).alias("acl_unset"))
    return acl.strictest(pairs).select("doc_id", "idx", "acl_visibility", "acl_unset", F.size("acl_allow").alias("allowed"))


@query("SELECT page_id, array_to_string(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '')), '|') IS NOT NULL AS has_list, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1))::BIGINT AS n_items, len(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1))::BIGINT AS n_paragraphs FROM pages")
def page_elements(spark, sf):
    n = lambda tag: F.size(F.regexp_extract_all("html", F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))).cast("long")
    return table(spark, sf, "pages").select("page_id", F.lit(True).alias("has_list"), n("li").alias("n_items"), n("p").alias("n_paragraphs"))


_TABLE = "concat('<table><tr><th>name</th><th>qty</th></tr><tr><td>unit</td><td>', CAST(l_linenumber AS STRING), '</td></tr><tr><td>', l_returnflag, '</td><td>1</td></tr><tr><td> </td><td>', l_linestatus, '</td></tr></table>')"


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter(['name', 'qty', 'unit', l_linenumber::VARCHAR, l_returnflag, CASE WHEN l_linestatus <> l_returnflag THEN l_linestatus END], lambda x: x IS NOT NULL), ' | ') AS signal FROM lineitem")
def table_signal(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.table_signal(F.expr(_TABLE)).alias("signal"))


@query("SELECT doc_id, 'start step ' || doc_id || ' end' AS label FROM documents")
def asset_text(spark, sf):
    raw = F.concat(F.lit("```mermaid graph TD A[start] --> B[\"step "), "doc_id", F.lit("\"] --> C(end) ```"))
    return table(spark, sf, "documents").select("doc_id", X.asset_text(raw).alias("label"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'img/' || page_id || '.png' WHEN 2 THEN NULL ELSE 'a/c' END AS path FROM pages")
def safe_paths(spark, sf):
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("/etc/"), "page_id")).when(k == 1, F.concat(F.lit(" ./img//"), "page_id", F.lit(".png"))).when(k == 2, "a/../../b").otherwise("a\\b\\..\\c")
    return table(spark, sf, "pages").select("page_id", X.safe_path(raw).alias("path"))


@query("SELECT doc_id, lang, string_split_regex(regexp_replace(text, '([。！？.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents".replace("string_split_regex", "string_split"))
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", X.sentences(F.col("text")).alias("parts"))
