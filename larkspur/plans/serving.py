"""Queries over composite reads and file metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import serving as V
from larkspur.operators import structure
from larkspur.operators.acl import visible
from larkspur.operators.chunking import chunks
from larkspur.plans.base import DOCS_SQL, ELS_SQL, documents, elements, query, table
from larkspur.plans.structures import ALL_SQL, cap_sql
from larkspur.sources import office_meta as M
from larkspur.sources.readers import doc_type_of

USER = ("t0", ["g_en"])
ADMITTED_SQL = "adm AS (SELECT doc_id FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 2 = 0 AND (doc_id % 3 = 0 OR lang = 'en'))"


def _elements(spark, sf):
    """Elements with their document's acl, of documents that the user may see; others would give no row, as an element's acl is its document's."""
    return elements(spark, sf, visible(documents(spark, sf), *USER))


@query(f"{ALL_SQL}, {ADMITTED_SQL}, body AS (SELECT l.doc_id, (SELECT max(h.idx) FROM heads h WHERE h.doc_id = l.doc_id AND h.idx < l.idx) AS sec_head FROM lev l JOIN adm USING (doc_id) WHERE l.level IS NULL) SELECT t.doc_id, t.idx::INT AS idx, t.level, md5(t.title) AS title, t.end_idx::INT AS end_idx FROM tree t WHERE EXISTS (SELECT 1 FROM body b WHERE b.doc_id = t.doc_id AND b.sec_head = t.idx)")
def get_outline(spark, sf):
    return V.outline(_elements(spark, sf), *USER).withColumn("title", F.md5("title"))


@query(f"{ALL_SQL}, {ADMITTED_SQL}, body AS (SELECT l.doc_id, l.idx, l.text, (SELECT max(h.idx) FROM heads h WHERE h.doc_id = l.doc_id AND h.idx < l.idx) AS sec_head FROM lev l JOIN adm USING (doc_id) WHERE l.level IS NULL), seen AS (SELECT doc_id, idx, text FROM body UNION SELECT l.doc_id, l.idx, l.text FROM lev l JOIN body b ON b.doc_id = l.doc_id AND b.sec_head = l.idx), whole AS (SELECT doc_id, count(*) AS n_elements_visible, coalesce(string_agg(trim(text), chr(10) ORDER BY idx) FILTER (WHERE trim(text) <> ''), '') AS t FROM seen GROUP BY 1), {cap_sql('whole', 24000)} SELECT doc_id, n_elements_visible, md5(c) AS h, length(c) < length(t) AS truncated FROM whole JOIN capped USING (doc_id)")
def get_document(spark, sf):
    out = V.whole_documents(_elements(spark, sf), *USER)
    return out.select("doc_id", "n_elements_visible", F.md5("text").alias("h"), "truncated")


def _chunks(docs, own):
    """Chunks of a document's elements, with its acl."""
    return chunks(own.drop(*V.ACL)).join(docs.select("doc_id", *V.ACL), "doc_id")


@query()
def expand(spark, sf):
    """Every chunk that the user may see is asked for, through the operator. A chunk has its document's acl, so documents are filtered before they are cut."""
    d = visible(documents(spark, sf), *USER)
    own = elements(spark, sf, d)
    c = _chunks(d, own)
    out = V.expand(c, None, V.with_chunk_acls(own, c), *USER)
    return out.select("doc_id", "hit_no", "resolved_section", "n_tokens", "climbed", "windowed", F.md5("text").alias("h"))


@query()
def search_with_context(spark, sf):
    """All chunks of the twenty best documents as hits. Only these are cut, and their blocks gathered; the one search reads the visible texts, which no index would be written for."""
    from pyspark.sql import Window

    from larkspur.operators import search as S
    from larkspur.plans.search import WORDS, seen

    top = S.top(S.sparse_scores(seen(spark, sf), WORDS), 20).select("doc_id", F.col("rank").alias("doc_rank"), "score")
    rows = top.collect()  # twenty at most
    best = spark.createDataFrame(rows, top.schema)
    d = documents(spark, sf).filter(F.col("doc_id").isin([r.doc_id for r in rows]))
    own = elements(spark, sf, d)
    c = _chunks(d, own)
    hits = c.join(F.broadcast(best), "doc_id").withColumn("section_id", F.concat_ws("::s", "doc_id", "sec_head"))
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("doc_rank", "chunk_no")))  # chunks of twenty documents
    out = V.search_with_context(hits, V.with_chunk_acls(own, c), *USER)
    return out.select("rank", "doc_id", "chunk_id", "context_status", "resolved_section", F.md5(F.coalesce("context", F.lit(""))).alias("h"))


@query("WITH r AS (SELECT conv_id AS session, turn, greatest(length(text) // 4, 1) AS tokens, CASE WHEN turn % 4 = 0 THEN 'full_section' WHEN turn % 4 = 1 THEN 'already_returned' WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN 'omitted_budget' ELSE 'deduped' END AS s FROM conversations) SELECT session, count(*) AS returned_n, count(*) FILTER (WHERE s = 'deduped') AS deduped_n, count(*) FILTER (WHERE s = 'already_returned') AS already_returned_n, count(*) FILTER (WHERE s = 'omitted_budget') AS omitted_n, coalesce(sum(tokens) FILTER (WHERE s NOT IN ('already_returned', 'omitted_budget')), 0)::BIGINT AS context_tokens, CASE WHEN count(*) FILTER (WHERE s = 'omitted_budget') > 0 THEN 'over_budget' WHEN count(*) FILTER (WHERE s = 'already_returned') > 0 THEN 'already_returned' ELSE '' END AS hint FROM r GROUP BY 1")
def retrieve_meta(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("turn") % 4
    status = F.when(t == 0, "full_section").when(t == 1, "already_returned").when((t == 2) & (F.col("conv_id") % 2 == 0), "omitted_budget").otherwise("deduped")
    rows = c.select(F.col("conv_id").alias("session"), F.greatest(F.floor(F.length("text") / 4), F.lit(1)).alias("tokens"), status.alias("context_status"))
    return V.result_meta(rows)


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'omitted_budget' ELSE 'full' END AS context_status, CASE WHEN page_id % 2 = 0 THEN '' ELSE url END AS text, CASE WHEN page_id % 2 = 1 THEN md5(html) END AS content_raw FROM pages")
def demoted_hits(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.lit("full").alias("context_status"), F.col("url").alias("text"), F.col("html").alias("content_raw"))
    return V.demoted(p, F.col("page_id") % 2 == 0, "omitted_budget").withColumn("content_raw", F.md5("content_raw"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id || '|s' || (doc_id % 5) WHEN doc_id % 3 = 1 THEN doc_id || '|4-9' ELSE doc_id || '|c' || doc_id END AS key FROM documents")
def delivery_keys(spark, sf):
    d = F.col("doc_id")
    status = F.when(d % 3 == 0, "section_window").otherwise("full_section")
    key = V.dedup_key(d, status, F.concat(F.lit("s"), d % 5), F.when(d % 3 == 1, 4), F.lit(9), F.concat(F.lit("c"), d))
    return table(spark, sf, "documents").select(d, key.alias("key"))


@query(f"WITH {ELS_SQL}, mixed AS (SELECT doc_id, idx, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', '一二三四五') ELSE text END AS text FROM els), head AS (SELECT doc_id, left(string_agg(text, ' ' ORDER BY idx), 2000) AS t FROM mixed WHERE idx < 40 GROUP BY 1) SELECT doc_id, CASE WHEN length(t) > 0 AND length(regexp_replace(t, '[^一-鿿]', '', 'g')) / length(t)::DOUBLE > 0.12 THEN 'ch' ELSE 'en' END AS lang FROM head")
def detected_lang(spark, sf):
    """A third of the documents have Chinese numerals for vowels."""
    e = elements(spark, sf)
    return V.detected_lang(e.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiou", "一二三四五")).otherwise(F.col("text"))))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 1 AND length((l_quantity::INT)::VARCHAR) >= 2 AS ok FROM lineitem")
def grounded_answers(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("<td>"), q, F.lit("</td>"))).otherwise("<td>none</td>")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.answer_grounded(F.concat(F.lit("It was "), q, F.lit(" units")), raw).alias("ok"))


@query("WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS m FROM part) SELECT p_brand, p_partkey FROM o WHERE m <= 3 OR pos IN (0, round_even((m - 1) / 2.0, 0), m - 1)")
def spread_picks(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("item"), F.col("p_size").alias("size"))
    return V.spread_pick(p, 3, "p_brand").select("p_brand", F.col("item").alias("p_partkey"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'unknown' END AS doc_type FROM documents")
def doc_types(spark, sf):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("__"), "doc_id", F.lit("__x"))).otherwise(F.concat("lang", F.lit("_"), "doc_id"))
    return table(spark, sf, "documents").select("doc_id", doc_type_of(name).alias("doc_type"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Report ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'given' ELSE source END AS source, NULL::VARCHAR AS tenant FROM documents")
def doc_meta(spark, sf):
    d = F.col("doc_id")
    own = F.create_map(F.lit("title"), F.when(d % 4 == 0, " Untitled").otherwise(F.concat(F.lit("Report "), d)), F.lit("source"), F.col("source"))
    given = F.create_map(F.lit("source"), F.when(d % 3 == 0, "given").otherwise(""), F.lit("tenant"), F.lit("t9"))
    m = M.merged_meta(own, given)
    return table(spark, sf, "documents").select(d, *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("title", "source", "tenant")])


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'A chart of sales by year' WHEN 4 THEN 'Two people at work' ELSE '' END AS alt FROM documents")
def alt_texts(spark, sf):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, "A chart of  sales by year Description automatically generated").when(k == 1, "IMG_001.png").when(k == 2, "a picture containing text").when(k == 3, "logo").when(k == 4, "Two people at work").otherwise("C:/pics/one")
    return table(spark, sf, "documents").select("doc_id", M.authored_alt(raw).alias("alt"))


@query("SELECT doc_id, idx, CASE WHEN idx = 1 AND doc_id % 3 < 2 THEN 'alt' || doc_id ELSE '' END AS caption FROM documents, (SELECT unnest([0, 1])::INT AS idx)")
def alt_alignment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    e = d.withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("kind", F.when(F.col("idx") == 1, "image").otherwise("text")).withColumn("caption", F.lit(""))
    n = (F.col("doc_id") % 3 + 1).cast("int")  # one to three texts for one picture
    alts = d.select("doc_id", F.posexplode(F.array_repeat(F.concat(F.lit("alt"), "doc_id"), n)).alias("pos", "alt"))
    return M.attach_alts(e, alts).select("doc_id", "idx", "caption")


@query(f"WITH {DOCS_SQL}, e AS (SELECT doc_id, count(*) - (doc_id % 13 = 0)::INT AS kept FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1) SELECT doc_id, CASE WHEN doc_id % 19 = 0 AND doc_id % 3 > 0 OR doc_id % 13 = 0 AND kept > 0 THEN 'failed' ELSE 'indexed' END AS status FROM docs JOIN e USING (doc_id)")
def index_run(spark, sf):
    """Some documents allow nobody, some miss their first element."""
    from larkspur.sources.index import index_run as run

    d = documents(spark, sf).withColumn("acl_allow", F.when(F.col("doc_id") % 19 > 0, F.col("acl_allow")).otherwise(F.array().cast("array<string>")))
    e = elements(spark, sf).select("doc_id", "idx").filter((F.col("doc_id") % 13 > 0) | (F.col("idx") > 0))
    return run(d, e).select("doc_id", "status")


@query("SELECT lang, count(*) FILTER (WHERE doc_id % 4 = 0) AS images, count(*) FILTER (WHERE doc_id % 4 > 0 AND doc_id % 5 > 0) AS texts, count(*) FILTER (WHERE doc_id % 4 > 0 AND doc_id % 5 = 0) AS skipped, count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 5 > 0) AS indexed FROM documents GROUP BY 1")
def index_counts(spark, sf):
    from larkspur.sources.index import index_counts as counts

    n = F.col("doc_id")
    d = table(spark, sf, "documents").select("lang", F.when(n % 5 > 0, F.concat(F.lit("x"), "text")).alias("text"), F.when(n % 4 == 0, "img/a.png").alias("image_path"))
    return counts(d, "lang")


@query(f"{ALL_SQL} SELECT doc_id, count(*) AS n, min(idx)::INT AS first, max(level)::INT AS deepest FROM tree GROUP BY 1")
def sections_by_id(spark, sf):
    e = elements(spark, sf)
    m = structure.sections_by_id(structure.sections(structure.headings(e), e))
    own = F.map_values("sections")
    return m.select("doc_id", F.size(own).cast("long").alias("n"), F.array_min(F.transform(own, lambda s: s["idx"])).alias("first"), F.array_max(F.transform(own, lambda s: s["level"])).alias("deepest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['it''s', source] WHEN doc_id % 3 = 1 THEN [source] ELSE ['[broken'] END AS items, replace(replace(n_chars || ', 1,000', ',', ''), ' ', '') AS nums FROM documents")
def listish(spark, sf):
    from larkspur.functions import text as X

    n = F.col("doc_id") % 3
    raw = F.when(n == 0, F.concat(F.lit("[\"it's\", '"), "source", F.lit("']"))).when(n == 1, F.col("source")).otherwise("[broken")
    return documents(spark, sf).select("doc_id", X.listish(raw).alias("items"), X.bare_numbers(F.concat("n_chars", F.lit(", 1,000"))).alias("nums"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 > 0 THEN list_distinct([1, 2, (doc_id % 4)::INT]) ELSE [1, 2] END AS ids FROM documents".replace("list_distinct([1, 2, (doc_id % 4)::INT])", "CASE WHEN doc_id % 4 IN (1, 2) THEN [1, 2] ELSE [1, 2, (doc_id % 4)::INT] END"))
def retry_ids(spark, sf):
    """A numeric question that was refused is asked again over tables; what that found counts only where it was answered then."""
    from larkspur.operators import shape

    d = F.col("doc_id")
    q = F.when(d % 2 == 0, "How much profit").otherwise("Who")
    first, second = F.when(d % 3 == 0, "No relevant information here").otherwise("It is so"), F.when(d % 5 == 0, "I cannot answer").otherwise("It was 7")
    ids = shape.ids_after_retry(F.array(F.lit(1), F.lit(2)), F.array((d % 4).cast("int"), F.lit(1)), q, first, second)
    return documents(spark, sf).select("doc_id", ids.alias("ids"))


@query("SELECT doc_id, 'type' || doc_id % 4 AS doc_type FROM documents WHERE doc_id % 3 = 0")
def annotated_documents(spark, sf):
    from larkspur.sources.readers import annotated

    d = documents(spark, sf)
    m = d.select("doc_id", F.concat(F.lit("type"), F.col("doc_id") % 4).alias("doc_type"), F.concat(F.lit("a/b/doc"), "doc_id", F.lit(".x.pdf")).alias("src_path"))
    a = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("doc"), "doc_id", F.lit(".x.pdf")).alias("doc_name"))
    return annotated(m, a).select("doc_id", "doc_type")
