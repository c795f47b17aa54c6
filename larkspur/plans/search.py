"""Queries over sparse, dense and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.vector import shortened
from larkspur.operators import search as S
from larkspur.operators.acl import visible
from larkspur.plans.base import DOCS_SQL, TOKENS_SQL, documents, postings, query, query_vector, table, vectors

WORDS = "the and tion"
SEEN_SQL = "seen AS (SELECT * FROM docs WHERE NOT acl_unset AND acl_tenant = 't0' AND (acl_visibility = 'public' OR list_contains(acl_allow, 'g_en')))"
SPARSE_SQL = "stoks AS (SELECT doc_id, list_concat(w, list_filter(r, lambda t: length(t) >= 2 AND NOT list_contains(w, t))) AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_./][a-z0-9]+)*') AS r FROM seen)), tf AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS tok FROM stoks) WHERE tok IN ('the', 'and', 'tion') GROUP BY 1, 2), idf AS (SELECT tok, ln(1 + ((SELECT count(*) FROM seen) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1), sparse AS (SELECT doc_id, round(sum(tf * idf), 6) AS score FROM tf JOIN idf USING (tok) GROUP BY 1)"
DENSE_SQL = "dense AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM seen))"
RANKS_SQL = "sr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS sparse_rank FROM sparse QUALIFY sparse_rank <= 50), dr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS dense_rank FROM dense QUALIFY dense_rank <= 50)"
ALL_SQL = f"WITH {DOCS_SQL}, {SEEN_SQL}, {SPARSE_SQL}, {DENSE_SQL}, {RANKS_SQL}"


def seen(spark, sf):
    return visible(documents(spark, sf), "t0", ["g_en"])


@query(f"{ALL_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sparse ORDER BY score DESC, doc_id LIMIT 20")
def sparse_topk(spark, sf):
    return S.top(S.sparse_scores(seen(spark, sf), WORDS, postings(spark, sf)[0]), 20)


@query(f"{ALL_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM dense ORDER BY score DESC, doc_id LIMIT 20")
def dense_topk(spark, sf):
    v = vectors(spark, sf).join(seen(spark, sf).select("doc_id"), "doc_id", "left_semi")
    return S.top(S.dense_scores(v, query_vector(spark, sf)), 20)


@query(f"{ALL_SQL} SELECT doc_id, sparse_rank::INT AS sparse_rank, dense_rank::INT AS dense_rank, round(coalesce(1.0 / (60 + sparse_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 8) AS score FROM sr FULL JOIN dr USING (doc_id) ORDER BY score DESC, doc_id LIMIT 8")
def hybrid_rrf(spark, sf):
    return S.hybrid(seen(spark, sf), vectors(spark, sf), query_vector(spark, sf), WORDS, posts=postings(spark, sf)[0])


@query(f"{ALL_SQL}, w AS (SELECT unnest([0.0, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0])::DOUBLE AS w), s AS (SELECT w, doc_id, round((1 - w) * coalesce(1.0 / (60 + sparse_rank), 0) + w * coalesce(1.0 / (60 + dense_rank), 0), 8) AS score FROM sr FULL JOIN dr USING (doc_id), w) SELECT w, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, doc_id) <= 5")
def weighted_rrf_sweep(spark, sf):
    from pyspark.sql import Window

    d = seen(spark, sf)
    v = vectors(spark, sf).join(d.select("doc_id"), "doc_id", "left_semi")
    sr = S.top(S.sparse_scores(d, WORDS, postings(spark, sf)[0]), 50, "sparse_rank").select("doc_id", "sparse_rank")
    dr = S.top(S.dense_scores(v, query_vector(spark, sf)), 50, "dense_rank").select("doc_id", "dense_rank")
    w = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0)], "w double")
    return S.fuse(sr, dr, 60, w).withColumn("k", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "doc_id"))).filter("k <= 5").select("w", "doc_id", "score")


@query(f"{ALL_SQL} SELECT s.doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, s.doc_id)::INT AS rank FROM sparse s JOIN documents USING (doc_id) QUALIFY rank <= 3")
def search_grouped(spark, sf):
    d = seen(spark, sf)
    return S.grouped(S.sparse_scores(d, WORDS, postings(spark, sf)[0]), d.select("doc_id", "source"), "source", 3)


@query(f"WITH docs AS (SELECT * FROM documents), {TOKENS_SQL}, one AS (SELECT doc_id, len(t) AS n, unnest(t) AS tok FROM toks), tf AS (SELECT doc_id, tok, any_value(n) AS n, count(*) AS tf FROM one WHERE tok IN ('the', 'and', 'tion') GROUP BY 1, 2), idf AS (SELECT tok, ln(1 + ((SELECT count(*) FROM docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1), s AS (SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(len(t)) FROM toks)))), 6) AS score FROM tf JOIN idf USING (tok) GROUP BY 1) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def okapi_topk(spark, sf):
    return S.okapi_scores(table(spark, sf, "documents").select("doc_id"), WORDS, posts=postings(spark, sf)[0], lengths=postings(spark, sf)[1]).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH docs AS (SELECT * FROM documents), {TOKENS_SQL}, p AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS tok FROM toks) GROUP BY 1, 2) SELECT tok, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY 1")
def term_frequencies(spark, sf):
    return postings(spark, sf)[0].groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("WITH v AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS h FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS s FROM v) SELECT vec_id, len(h)::BIGINT AS width, round(h[1] / s, 4) AS first, round(h[16] / s, 4) AS last, round(list_sum(h) / s, 3) AS total FROM n")
def shortened_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", shortened(F.col("embedding"), 16).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    at = lambda n: F.round(F.element_at("v", n).cast("double"), 4)
    return v.select("vec_id", F.size("v").cast("long").alias("width"), at(1).alias("first"), at(16).alias("last"), F.round(total, 3).alias("total"))


@query(f"{ALL_SQL}, hits AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sparse ORDER BY score DESC, doc_id LIMIT 50) SELECT doc_id, n_chars::DOUBLE AS score, row_number() OVER (ORDER BY n_chars DESC, rank)::INT AS new_rank FROM hits JOIN documents USING (doc_id) ORDER BY new_rank LIMIT 10")
def rerank_topk(spark, sf):
    d = seen(spark, sf)
    hits = S.top(S.sparse_scores(d, WORDS, postings(spark, sf)[0]), 50).join(d.select("doc_id", "n_chars"), "doc_id")
    return S.rerank(hits, F.col("n_chars").cast("double"), 10).select("doc_id", "score", "new_rank")


@query(f"WITH docs AS (SELECT * FROM documents), {TOKENS_SQL}, p AS (SELECT DISTINCT doc_id, unnest(t) AS tok FROM toks), rare AS (SELECT tok, min(doc_id) AS golden FROM p WHERE length(tok) >= 3 GROUP BY 1 HAVING count(*) = 1) SELECT golden, min(tok) AS query FROM rare GROUP BY 1 ORDER BY 1 LIMIT 80")
def mine_exact_queries(spark, sf):
    p = postings(spark, sf)[0].filter(F.length("tok") >= 3)
    rare = p.groupBy("tok").agg(F.count("*").alias("df"), F.min("doc_id").alias("golden")).filter("df = 1")
    return rare.groupBy("golden").agg(F.min("tok").alias("query")).orderBy("golden").limit(80)


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 = 3")
def chunks_by_id(spark, sf):
    """Chunks that are asked for by id, with their document's language; ids that are unknown give none."""
    from larkspur.sources.index import by_chunk_id, document_lang

    d = table(spark, sf, "documents").withColumn("chunk_id", F.concat("doc_id", F.lit("#0000")))
    asked = d.filter("doc_id % 7 = 3").select("chunk_id").unionByName(d.select(F.concat("doc_id", F.lit("#9999")).alias("chunk_id")))
    return document_lang(by_chunk_id(d, asked))


@query(f"{ALL_SQL} SELECT doc_id, round(1.0 / (60 + sparse_rank), 8) AS score FROM sr ORDER BY score DESC, doc_id LIMIT 8")
def sparse_strategy(spark, sf):
    out = S.hybrid(seen(spark, sf), vectors(spark, sf), query_vector(spark, sf), WORDS, posts=postings(spark, sf)[0], strategy="sparse")
    return out.select("doc_id", "score")
