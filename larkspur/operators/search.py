"""Sparse, dense and hybrid search. Every list is ordered by rounded score, then id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import query_tokens, tokenize, words_and_runs
from larkspur.functions.vector import cosine, reciprocal

PREFETCH = 50


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tok, word: a row per word (word 1) and per alphanumeric run (word 0)."""
    words, runs = words_and_runs(F.col("text"))
    tagged = lambda a, n: F.transform(a, lambda t: F.struct(t.alias("tok"), F.lit(n).alias("word")))
    return docs.select("doc_id", F.explode(F.concat(tagged(words, 1), tagged(runs, 0))).alias("t")).select("doc_id", "t.tok", "t.word")


def counted(rows: DataFrame) -> DataFrame:
    """doc_id, tok, tf: runs count only where their token is no word of the document."""
    n = rows.groupBy("doc_id", "tok").agg(F.sum("word").alias("w"), F.count("*").alias("n"))
    return n.select("doc_id", "tok", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("n")).alias("tf"))


def postings(docs: DataFrame) -> DataFrame:
    return counted(token_rows(docs))


#: Words and runs that a task counts at once, about.
COUNTED = 1 << 19


def document_terms(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> their other columns, len and terms (tok, tf): the rows of `counted`, as one array for each document. A document is counted where it is read; nothing is shuffled."""
    words, runs = words_and_runs(F.col("text"))
    kept = [c for c in docs.columns if c != "text"]

    def count(rows):
        """rows (words, runs) -> arrays len and terms; words carry a count of their own, as a run counts only where it is no word."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        of, toks, word = [], [], []
        for name, flag in (("words", 1), ("runs", 0)):
            flat = pc.list_flatten(rows[name])
            of.append(pc.list_parent_indices(rows[name]).cast("int64"))
            toks.append(flat.cast("string"))
            word.append(pa.array(np.full(len(flat), flag, "int64")))
        table = pa.table({"doc": pa.concat_arrays(of), "tok": pa.concat_arrays(toks), "word": pa.concat_arrays(word)})
        n = table.group_by(["doc", "tok"], use_threads=False).aggregate([("word", "sum"), ("word", "count")]).sort_by("doc")
        tf = pc.if_else(pc.greater(n["word_sum"], 0), n["word_sum"], n["word_count"]).combine_chunks().cast("int64")
        doc = n["doc"].to_numpy()
        ends = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        sums = np.concatenate([[0], np.cumsum(tf.to_numpy())])
        terms = pa.StructArray.from_arrays([n["tok"].combine_chunks(), tf], ["tok", "tf"])
        return pa.array(sums[ends[1:]] - sums[ends[:-1]], "int64"), pa.ListArray.from_arrays(pa.array(ends, "int32"), terms)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False) + pc.list_value_length(batch["runs"]).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, COUNTED + (size[at - 1] if at else 0), "right")))
                own = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(own[c] for c in kept), *count(own)], names=[*kept, "len", "terms"])
                at = end

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, words.alias("words"), runs.alias("runs")).mapInArrow(run, f"{types}, len bigint, terms array<struct<tok:string,tf:bigint>>")


def idf(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """tok, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = docs.agg(F.count("*").alias("n"))
    return posts.groupBy("tok").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("tok", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(spark, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "q string").select(F.explode(query_tokens(F.col("q"))).alias("tok"))


def _own(docs: DataFrame, text: str, posts: DataFrame | None) -> DataFrame:
    """doc_id, tok, tf (and len, from written postings) of the query's terms in docs. The few terms cut the postings before anything is counted."""
    terms = query_terms(docs.sparkSession, text)
    if posts is None:
        return counted(token_rows(docs).join(F.broadcast(terms), "tok", "left_semi"))
    asked = [r.tok for r in terms.collect()]  # a query's words
    return posts.filter(F.col("tok").isin(asked)).join(docs.select("doc_id"), "doc_id", "left_semi")


def sparse_scores(docs: DataFrame, text: str, posts: DataFrame | None = None) -> DataFrame:
    """doc_id, score = sum of tf * idf over the query's terms. posts: written postings (tok, doc_id, tf, len), of which only the terms' are read."""
    own = _own(docs, text, posts)
    return own.join(F.broadcast(idf(own, docs)), "tok").groupBy("doc_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"))


def okapi_scores(docs: DataFrame, text: str, k1: float = 1.2, b: float = 0.75, posts: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """True BM25 with saturation and length normalisation, under a name of its own. posts and lengths (doc_id, len) as written; else they are made from the texts."""
    if lengths is None:
        lengths = docs.select("doc_id", F.size(tokenize(F.col("text"))).alias("len"))
    mean = lengths.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("len").alias("mean"))
    own = _own(docs, text, posts)
    own = own if "len" in own.columns else own.join(lengths, "doc_id")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return own.join(F.broadcast(idf(own, docs)), "tok").crossJoin(F.broadcast(mean)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def dense_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vectors (doc_id, embedding), query (one row, q) -> doc_id, score."""
    return vectors.crossJoin(F.broadcast(query)).select("doc_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def top(scores: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """The best k with their rank from 1; the window stands over k rows, not over all."""
    best = scores.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def fuse(sparse: DataFrame, dense: DataFrame, k: int = 60, weights: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion of doc_id, sparse_rank and doc_id, dense_rank; with weights (w, a few rows) once for each share of the dense route."""
    both, ws, wd = sparse.join(dense, "doc_id", "full"), F.lit(1.0), F.lit(1.0)
    if weights is not None:
        both, ws, wd = both.crossJoin(F.broadcast(weights)), 1 - F.col("w"), F.col("w")
    return both.withColumn("score", F.round(ws * reciprocal(F.col("sparse_rank"), k) + wd * reciprocal(F.col("dense_rank"), k), 8))


def hybrid(docs: DataFrame, vectors: DataFrame, query: DataFrame, text: str, top_k: int = 8, k: int = 60, posts: DataFrame | None = None, strategy: str = "hybrid") -> DataFrame:
    """docs are those that the user may see; both routes rank within them only. strategy leaves a route out: dense or sparse; top_k is one at least."""
    seen = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    none = docs.select("doc_id").limit(0)
    s = none.withColumn("sparse_rank", F.lit(0)) if strategy == "dense" else top(sparse_scores(docs, text, posts), PREFETCH, "sparse_rank").select("doc_id", "sparse_rank")
    d = none.withColumn("dense_rank", F.lit(0)) if strategy == "sparse" else top(dense_scores(seen, query), PREFETCH, "dense_rank").select("doc_id", "dense_rank")
    return fuse(s, d, k).orderBy(F.desc("score"), "doc_id").limit(max(1, top_k))


def grouped(scores: DataFrame, groups: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The best k of each group."""
    w = Window.partitionBy(column).orderBy(F.desc("score"), "doc_id")
    return scores.join(groups, "doc_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, score, top_k: int | None = None) -> DataFrame:
    """Stable by the new score, earlier rank first among equals; top_k 0 gives none."""
    out = hits.withColumn("score", score).withColumn("score_kind", F.lit("rerank"))
    out = out.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank")))
    return out if top_k is None else out.filter(F.col("new_rank") <= top_k)
