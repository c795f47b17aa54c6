"""Queries over structure, chunks and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import chunking as C
from larkspur.operators import context as X
from larkspur.operators import structure as S
from larkspur.plans.base import BANNERS_SQL, ELS_SQL, elements, query

KEPT_SQL = "kept AS (SELECT e.*, trim(e.text) AS tt, regexp_extract(trim(e.text), '^\\s*(\\d+(?:\\.\\d+)*)', 1) AS num FROM els2 e WHERE NOT EXISTS (SELECT 1 FROM banners b WHERE b.doc_id = e.doc_id AND b.norm = e.norm)), flagged AS (SELECT *, regexp_matches(tt, '(\\.{3,}|…)\\s*\\d+\\s*$') OR regexp_matches(tt, '^\\d+(?:\\.\\d+)*\\s+.+\\s+\\d{1,3}\\s*$') OR length(tt) > 120 OR regexp_matches(tt, '^\\s*[-–—•·●○▪◦]\\s') AS nohead, CASE WHEN num = '' OR regexp_matches(split_part(num, '.', 1), '^(19|20)\\d\\d$') THEN NULL WHEN contains(num, '.') THEN 'dotted' ELSE 'bare' END AS kind FROM kept), bare AS (SELECT doc_id, idx, TRY_CAST(num AS BIGINT) AS n FROM flagged WHERE kind = 'bare' AND text_level IS NOT NULL AND NOT nohead), promo AS (SELECT doc_id, bool_and(coalesce(n > p, true)) AS promote FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM bare) GROUP BY 1), lev AS (SELECT f.*, (CASE WHEN nohead THEN NULL WHEN doc_type = 'law' AND regexp_matches(tt, '(?i)^\\s*(SECTION|SEC\\.)\\s+\\d+') THEN 1 WHEN text_level IS NULL THEN NULL WHEN kind = 'dotted' THEN len(string_split(num, '.')) WHEN kind = 'bare' AND coalesce(promote, true) THEN 1 ELSE text_level END)::INT AS level FROM flagged f LEFT JOIN promo USING (doc_id))"
TREE_SQL = "ends AS (SELECT doc_id, max(idx) + 1 AS doc_end FROM els2 GROUP BY 1), heads AS (SELECT doc_id, idx, level, tt AS title FROM lev WHERE level IS NOT NULL), tree AS (SELECT h.doc_id, h.idx, h.level, h.title, coalesce((SELECT min(b.idx) FROM heads b WHERE b.doc_id = h.doc_id AND b.idx > h.idx AND b.level <= h.level), doc_end) AS end_idx, (SELECT max(b.idx) FROM heads b WHERE b.doc_id = h.doc_id AND b.idx < h.idx AND b.level < h.level) AS parent_idx FROM heads h JOIN ends USING (doc_id))"
ALL_SQL = f"WITH {ELS_SQL}, {BANNERS_SQL}, {KEPT_SQL}, {TREE_SQL}"


def cap_sql(source: str, room: int) -> str:
    """CTEs: of source (doc_id, t) the capped text c, at so many characters."""
    return f"capl AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM {source}), capu AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM capl), caph AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i = 1 OR used <= {room}) AS head FROM capu GROUP BY 1), capped AS (SELECT doc_id, CASE WHEN length(t) <= {room} THEN t WHEN length(head) <= {room} THEN head WHEN regexp_matches(left(head, {room}), '(?s)^.+ ') THEN regexp_replace(left(head, {room}), ' [^ ]*$', '') ELSE left(head, {room}) END AS c FROM {source} JOIN caph USING (doc_id))"


@query(f"WITH {ELS_SQL}, {BANNERS_SQL} SELECT doc_id, norm, freq, on_pages, pages::BIGINT AS pages FROM banners")
def banner_texts(spark, sf):
    return S.banners(elements(spark, sf)).withColumn("pages", F.col("pages").cast("long"))


NUMBERED_SQL = "els3 AS (SELECT * REPLACE (CASE WHEN text_level IS NOT NULL THEN (CASE WHEN doc_id % 2 = 0 THEN idx + 1 ELSE idx % 5 + 1 END) || ' ' || text ELSE text END AS text) FROM els2)"


@query(f"WITH {ELS_SQL}, {NUMBERED_SQL}, {BANNERS_SQL.replace('els2', 'els4')}, {KEPT_SQL.replace('els2', 'els4')} SELECT doc_id, promote FROM promo".replace("pages4 AS", "els4 AS (SELECT * REPLACE (trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS norm) FROM els3), pages4 AS", 1))
def promote_bare(spark, sf):
    """Headings with bare numbers, which rise in documents of even ids and start again in the others."""
    e = elements(spark, sf)
    number = F.when(F.col("doc_id") % 2 == 0, F.col("idx") + 1).otherwise(F.col("idx") % 5 + 1)
    e = e.withColumn("text", F.when(F.col("text_level").isNotNull(), F.concat(number, F.lit(" "), "text")).otherwise(F.col("text")))
    return S.promote_bare(S.without_noise(e))


@query(f"{ALL_SQL} SELECT doc_id, idx::INT AS idx, level FROM lev WHERE level IS NOT NULL")
def heading_levels(spark, sf):
    return S.leveled(elements(spark, sf)).filter("level is not null").select("doc_id", "idx", "level")


@query(f"{ALL_SQL} SELECT doc_id, idx::INT AS idx, level, md5(title) AS title, end_idx::INT AS end_idx, parent_idx::INT AS parent_idx FROM tree")
def section_ranges(spark, sf):
    e = elements(spark, sf)
    return S.sections(S.headings(e), e).select("doc_id", "idx", "level", F.md5("title").alias("title"), "end_idx", "parent_idx")


@query(f"{ALL_SQL} SELECT t.doc_id, t.idx::INT AS idx, md5(string_agg(a.title, ' > ' ORDER BY a.idx)) AS path FROM tree t JOIN tree a ON a.doc_id = t.doc_id AND a.idx <= t.idx AND t.idx < a.end_idx GROUP BY 1, 2")
def breadcrumbs(spark, sf):
    e = elements(spark, sf)
    return S.sections(S.headings(e), e).select("doc_id", "idx", F.md5(F.array_join("breadcrumb", " > ")).alias("path"))


@query(f"{ALL_SQL} SELECT l.doc_id, l.idx::INT AS idx, (SELECT max(h.idx) FROM heads h WHERE h.doc_id = l.doc_id AND h.idx < l.idx)::INT AS sec_head FROM lev l WHERE l.level IS NULL")
def element_section(spark, sf):
    return S.in_section(S.leveled(elements(spark, sf))).select("doc_id", "idx", "sec_head")


@query(f"{ALL_SQL}, body AS (SELECT l.*, (SELECT max(h.idx) FROM heads h WHERE h.doc_id = l.doc_id AND h.idx < l.idx) AS sec_head FROM lev l WHERE l.level IS NULL) SELECT doc_id, sec_head::INT AS sec_head, count(*) AS n FROM body WHERE trim(text) <> '' AND sec_head IS NOT NULL GROUP BY 1, 2")
def document_outline(spark, sf):
    """Sections with a body of their own."""
    rows = S.in_section(S.leveled(elements(spark, sf))).filter((F.trim("text") != "") & F.col("sec_head").isNotNull())
    return rows.groupBy("doc_id", "sec_head").agg(F.count("*").alias("n"))


@query(f"{ALL_SQL}, body AS (SELECT l.*, (SELECT max(h.idx) FROM heads h WHERE h.doc_id = l.doc_id AND h.idx < l.idx) AS sec_head FROM lev l WHERE l.level IS NULL AND trim(text) <> ''), marks AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND sec_head IS NOT DISTINCT FROM lag(sec_head) OVER w THEN 0 ELSE 1 END AS b FROM body WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, idx::INT AS idx, (sum(b) OVER (PARTITION BY doc_id ORDER BY idx))::INT AS run FROM marks")
def text_runs(spark, sf):
    return C.text_runs(elements(spark, sf)).select("doc_id", "idx", "run")


@query()
def pack_chunks(spark, sf):
    return C.chunks(elements(spark, sf)).select("doc_id", "chunk_id", "n_tokens", "page_start", "page_end", "source_indices", F.md5("text").alias("h"), "flags", "sec_head")


@query("SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'law' ELSE 'none' END AS doc_type, CASE WHEN doc_id % 2 = 0 THEN 300 ELSE 200 END AS least, CASE WHEN doc_id % 2 = 0 THEN 700 ELSE 800 END AS target, CASE WHEN doc_id % 2 = 0 THEN 1200 ELSE 1500 END AS most, count(*) AS n FROM documents GROUP BY ALL")
def budget_lookup(spark, sf):
    from larkspur.plans.base import table

    d = table(spark, sf, "documents").withColumn("doc_type", F.when(F.col("doc_id") % 2 == 0, "law").otherwise("none"))
    return d.groupBy("source", "doc_type", *[C.budget(F.col("doc_type"), i).alias(c) for i, c in enumerate(("least", "target", "most"))]).agg(F.count("*").alias("n"))


def _hits(spark, sf):
    """Each chunk stands for a hit."""
    return C.chunks(elements(spark, sf)).withColumn("hit_no", F.col("chunk_no"))


@query()
def big_block(spark, sf):
    e = elements(spark, sf)
    hits = _hits(spark, sf).select("hit_no", "doc_id", "source_indices", "sec_head", "page_start", "page_end")
    out = X.big_blocks(hits, e, S.sections(S.headings(e), e), S.banner_keys(e))
    return out.select("doc_id", "hit_no", "resolved_section", "n_tokens", "climbed", "anchor_start", "anchor_end", "windowed", "note", F.md5("text").alias("h"))


@query(f"WITH src AS (SELECT doc_id, text AS t FROM documents), {cap_sql('src', 800)} SELECT doc_id, length(c) AS n, md5(c) AS h FROM capped")
def cap_text(spark, sf):
    from larkspur.functions.text import capped, per_token
    from larkspur.plans.base import table

    d = table(spark, sf, "documents").select("doc_id", capped(F.col("text"), F.lit(200), per_token(F.col("lang"))).alias("c"))
    return d.select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("h"))


@query("SELECT doc_id, lang AS section_id, kind, rank FROM (SELECT doc_id % 10 AS doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'table' WHEN doc_id % 4 = 1 THEN 'image' ELSE 'text' END AS kind, doc_id AS rank FROM documents) QUALIFY kind = 'table' OR row_number() OVER (PARTITION BY doc_id, lang, kind = 'table' ORDER BY rank) = 1")
def section_fold(spark, sf):
    from larkspur.plans.base import table

    k = F.col("doc_id") % 4
    hits = table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("doc_id"), F.col("lang").alias("section_id"), F.when(k == 0, "table").when(k == 1, "image").otherwise("text").alias("kind"), F.col("doc_id").alias("rank"))
    return X.fold_by_section(hits)


@query("WITH r AS (SELECT doc_id % 10 AS doc_id, doc_id AS rank, n_chars % 3 AS a, lang AS s FROM documents) SELECT rank, row_number() OVER (PARTITION BY doc_id, a ORDER BY rank) > 1 OR row_number() OVER (PARTITION BY doc_id, s ORDER BY rank) > 1 AS deduped FROM r")
def bigblock_dedup(spark, sf):
    from larkspur.plans.base import table

    rows = table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("doc_id"), F.col("doc_id").alias("rank"), (F.col("n_chars") % 3).alias("anchor_start"), F.lit(9).alias("anchor_end"), F.col("lang").alias("resolved_section"), F.lit("x").alias("context"))
    return X.dedup_blocks(rows).select("rank", "deduped")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'concise' WHEN doc_id % 5 = 0 THEN 'single_chunk_degraded' WHEN doc_id % 3 = 0 THEN 'single_chunk_acl' WHEN doc_id % 11 = 0 THEN 'deduped' WHEN lang = 'fr' THEN 'asset_no_prose' WHEN lang = 'de' THEN 'section_window' WHEN n_chars % 3 > 0 THEN 'climbed_' || (n_chars % 3) ELSE 'full_section' END AS status FROM documents")
def context_status(spark, sf):
    from larkspur.plans.base import table

    d, m = F.col("doc_id"), lambda n: F.col("doc_id") % n == 0
    status = X.context_status(m(7), ~m(5), ~m(3), m(11), F.col("lang") == "fr", F.lit(False), F.col("lang") == "de", F.col("n_chars") % 3)
    return table(spark, sf, "documents").select(d, status.alias("status"))
