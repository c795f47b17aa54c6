"""Queries that read written indexes: vectors in lists, postings in blocks; and evidence by boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import blocks as B
from larkspur.operators import evidence as V
from larkspur.operators import search as S
from larkspur.operators import vector_lists as L
from larkspur.plans.base import documents, query, query_vector, table, terms, vectors, written
from larkspur.plans.search import ALL_SQL, WORDS, seen

K = 50


def vector_index(spark, sf):
    return L.read_lists(spark, written(spark, sf, "lists", lambda path: L.write_lists(vectors(spark, sf), path)))


def block_index(spark, sf):
    """Blocks come from documents' terms; postings by term are not written for them."""
    own, lengths = terms(spark, sf)
    return B.read_blocks(spark, written(spark, sf, "blocks", lambda path: B.write_blocks(documents(spark, sf), None, lengths, path, terms=own)))


@query(f"{ALL_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM dense ORDER BY score DESC, doc_id LIMIT 20")
def lists_topk(spark, sf):
    """The exact best vectors that the user may see, from the lists that may hold them."""
    return S.top(L.list_scores(vector_index(spark, sf), query_vector(spark, sf), 20, probes=4, certain=True, seen=seen(spark, sf)), 20)


def asked(spark, sf):
    """Each twentieth vector asks."""
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def lists_nearest(spark, sf):
    """The best 50 of all vectors for each that asks, from its nearest lists; recall is measured in the tests."""
    return L.nearest(vector_index(spark, sf), asked(spark, sf), K)


@query(f"{ALL_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sparse ORDER BY score DESC, doc_id LIMIT 20")
def blocks_topk(spark, sf):
    """The rows of sparse_topk, from blocks of postings that can matter."""
    return S.top(B.block_scores(block_index(spark, sf), WORDS, "t0", ["g_en"], 20), 20)


@query(f"{ALL_SQL} SELECT doc_id, sparse_rank::INT AS sparse_rank, dense_rank::INT AS dense_rank, round(coalesce(1.0 / (60 + sparse_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 8) AS score FROM sr FULL JOIN dr USING (doc_id) ORDER BY score DESC, doc_id LIMIT 8")
def hybrid_indexed(spark, sf):
    """hybrid_rrf over both indexes."""
    d = seen(spark, sf)
    sparse = S.top(B.block_scores(block_index(spark, sf), WORDS, "t0", ["g_en"], K), K, "sparse_rank").select("doc_id", "sparse_rank")
    dense = S.top(L.list_scores(vector_index(spark, sf), query_vector(spark, sf), K, probes=4, certain=True, seen=d), K, "dense_rank").select("doc_id", "dense_rank")
    return S.fuse(sparse, dense).orderBy(F.desc("score"), "doc_id").limit(8)


EVIDENCE_SQL = """WITH el AS (SELECT l_orderkey % 1000 AS doc_id, l_suppkey % 3 AS page, l_orderkey * 8 + l_linenumber AS idx, l_quantity::DOUBLE * 8 AS x0, l_quantity::DOUBLE * 8 + l_discount::DOUBLE * 900 AS x1, l_tax::DOUBLE * 5000 AS y0, l_tax::DOUBLE * 5000 + l_linenumber * 9 AS y1, l_orderkey // 32 AS chunk_id, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'R' THEN 'image' ELSE 'text' END AS kind, l_returnflag || ' ' || l_linestatus AS text FROM lineitem),
r AS (SELECT p_partkey // 2 AS question, p_partkey AS region, (p_partkey // 2) % 1000 AS doc_id, p_size % 4 AS page, p_size * 3.0::DOUBLE AS x0, p_size * 3.0::DOUBLE + length(p_type) * 2 AS x1, length(p_name) * 4.0::DOUBLE AS y0, length(p_name) * 4.0::DOUBLE + p_size AS y1 FROM part),
s AS (SELECT DISTINCT o_orderkey % 1000 AS doc_id FROM orders), sc AS (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN 2.0 END::DOUBLE AS sx, CASE WHEN doc_id % 11 > 0 THEN 1.5 END::DOUBLE AS sy FROM s),
pg AS (SELECT DISTINCT doc_id, page FROM el), g AS (SELECT r.*, pg.page IS NOT NULL AS in_range, x0 * sx AS a0, x1 * sx AS a1, y0 * sy AS b0, y1 * sy AS b1 FROM r LEFT JOIN sc USING (doc_id) LEFT JOIN pg USING (doc_id, page)),
o AS (SELECT question, g.doc_id, idx, greatest(0, least(a1, el.x1) - greatest(a0, el.x0)) * greatest(0, least(b1, el.y1) - greatest(b0, el.y0)) AS ov, (a1 - a0) * (b1 - b0) AS ga, (el.x1 - el.x0) * (el.y1 - el.y0) AS ea FROM g JOIN el USING (doc_id, page) WHERE a0 IS NOT NULL),
h AS (SELECT question, doc_id, idx, ov >= 0.3 * ga OR ov >= 0.5 * ea AS ok FROM o WHERE ov > 0),
q AS (SELECT question, bool_or(in_range) AS in_range FROM g GROUP BY 1), b AS (SELECT question, count(*) AS best, count(*) FILTER (WHERE ok) AS hits FROM h GROUP BY 1),
c AS (SELECT question, count(DISTINCT chunk_id) AS n_chunks, bool_or(kind IN ('table')) AS tab, bool_or(lower(text) LIKE '%a f%') AS said FROM (SELECT DISTINCT question, doc_id, idx FROM h WHERE ok) JOIN el USING (doc_id, idx) GROUP BY 1)
SELECT question, v AS verdict, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN v IN ('single', 'split') THEN tab END AS kind_match, CASE WHEN v IN ('single', 'split') THEN tab END AS kind_match_strict, CASE WHEN v IN ('single', 'split') THEN said END AS answer_found
FROM (SELECT *, CASE WHEN NOT in_range THEN 'out_of_range' WHEN coalesce(hits, 0) = 0 AND best > 0 THEN 'unlocalized_threshold' WHEN coalesce(hits, 0) = 0 THEN 'unlocalized_zero' WHEN coalesce(n_chunks, 0) = 0 THEN 'missing' WHEN n_chunks = 1 THEN 'single' ELSE 'split' END AS v FROM q LEFT JOIN b USING (question) LEFT JOIN c USING (question))"""


@query(EVIDENCE_SQL)
def evidence_preserved(spark, sf):
    """Verdicts from boxes: parts ask, order lines are the elements, ranges of orders their chunks."""
    li, p, o = (table(spark, sf, t) for t in ("lineitem", "part", "orders"))
    d = lambda c: F.col(c).cast("double")
    kind = F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in (("A", "table"), ("R", "image"))], F.lit("text"))
    x, y = d("l_quantity") * 8, d("l_tax") * 5000
    el = li.select(
        (F.col("l_orderkey") % 1000).alias("doc_id"), (F.col("l_suppkey") % 3).alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), x.alias("x0"), (x + d("l_discount") * 900).alias("x1"), y.alias("y0"), (y + d("l_linenumber") * 9).alias("y1"),
        F.floor(F.col("l_orderkey") / 32).alias("chunk_id"), kind.alias("kind"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"),
    )
    question, u, v = F.floor(F.col("p_partkey") / 2), d("p_size") * 3, F.length("p_name") * F.lit(4.0)
    regions = p.select(question.alias("question"), F.col("p_partkey").alias("region"), (question % 1000).alias("doc_id"), (F.col("p_size") % 4).alias("page"), u.alias("x0"), (u + F.length("p_type") * 2).alias("x1"), v.alias("y0"), (v + d("p_size")).alias("y1"))
    scaled = lambda s: F.when(F.col("doc_id") % 11 > 0, F.lit(s))
    scales = o.select((F.col("o_orderkey") % 1000).alias("doc_id")).distinct().withColumns({"sx": scaled(2.0), "sy": scaled(1.5)})
    asks = regions.select("question", F.array(F.lit("Table")).alias("channels"), F.array(F.lit("A  F"), F.lit("x")).alias("answers")).distinct()
    return V.preserved(asks, regions, el.select("doc_id", "page"), scales, el, el)
