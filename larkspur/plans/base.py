"""Registration of queries, and the inputs that they derive from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DOC_TYPES = ["law", "news", "form", "policy", "academic_paper"]
USERS = [("u_en", "t0", ["g_en"]), ("u_fr", "t1", ["g_fr"]), ("u_all", "t0", ["g_en", "g_fr", "g_de", "g_es"]), ("u_none", "t1", []), ("u_void", "", ["g_en"])]
USERS_SQL = "users(name, tenant, principals) AS (VALUES ('u_en','t0',['g_en']),('u_fr','t1',['g_fr']),('u_all','t0',['g_en','g_fr','g_de','g_es']),('u_none','t1',[]::VARCHAR[]),('u_void','',['g_en']))"
DOCS_SQL = "docs AS (SELECT *, 't' || (doc_id % 2) AS acl_tenant, ['g_' || lang] AS acl_allow, CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE 'restricted' END AS acl_visibility, doc_id % 17 = 0 AS acl_unset FROM documents)"
ELS_SQL = "els AS (SELECT doc_id, lang, ['law','news','form','policy','academic_paper'][(doc_id % 5 + 1)::INT] AS doc_type, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), els2 AS (SELECT *, CASE WHEN length(text) < 40 THEN length(text) % 3 + 1 END AS text_level, idx // 20 AS page, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS norm FROM els)"
BANNERS_SQL = "pages4 AS (SELECT doc_id, max(page) + 1 AS pages FROM els2 GROUP BY 1 HAVING max(page) + 1 >= 4), banners AS (SELECT doc_id, norm, count(*) AS freq, count(DISTINCT page) AS on_pages, pages FROM els2 JOIN pages4 USING (doc_id) WHERE norm <> '' AND NOT regexp_matches(norm, '[:：]$') GROUP BY 1, 2, 5 HAVING count(*) >= 3 AND count(DISTINCT page) >= pages * 0.5)"
TOKENS_SQL = "toks AS (SELECT doc_id, list_concat(w, list_filter(r, lambda t: length(t) >= 2 AND NOT list_contains(w, t))) AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_./][a-z0-9]+)*') AS r FROM docs))"


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with access columns derived from id and language."""
    d = table(spark, sf_dir, "documents")
    return d.withColumns({"acl_tenant": F.concat(F.lit("t"), F.col("doc_id") % 2), "acl_allow": F.array(F.concat(F.lit("g_"), "lang")), "acl_visibility": F.when(F.col("doc_id") % 3 == 0, "public").otherwise("restricted"), "acl_unset": F.col("doc_id") % 17 == 0})


def elements(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """A document's lines as elements: short ones carry a heading hint, twenty make a page. Of `docs` (as of `documents`) only, where they are given, with their access columns."""
    d = table(spark, sf_dir, "documents") if docs is None else docs
    acl = [] if docs is None else ["acl_tenant", "acl_allow", "acl_visibility", "acl_unset"]
    rows = d.select("doc_id", "lang", *acl, F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    kinds = F.array(*[F.lit(x) for x in DOC_TYPES])
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        "doc_id", "lang", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("doc_type"), "idx", F.lit("text").alias("kind"), "text",
        F.when(F.length("text") < 40, F.length("text") % 3 + 1).alias("text_level"), F.floor(F.col("idx") / 20).cast("int").alias("page"),
        none("array<string>").alias("list_items"), none("string").alias("caption"), F.lit(False).alias("merge_prev"), *acl,
    )


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Where an index of that name over the tables is. It is written once for each application and folder of tables, and searched many times."""
    from larkspur.session import shared_dir

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def drop_written(spark: SparkSession) -> None:
    """Deletes the indexes that this application's queries have written; later ones write them anew."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        where = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(key))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _terms_path(spark: SparkSession, sf_dir: str) -> str:
    from larkspur.sources.index import write_terms

    return written(spark, sf_dir, "terms", lambda path: write_terms(documents(spark, sf_dir).select("doc_id", "text", "acl_tenant", "acl_allow", "acl_visibility", "acl_unset"), path))


def terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written terms of each document, with its access columns; and lengths of documents."""
    from larkspur.sources.index import read_lengths, read_terms

    path = _terms_path(spark, sf_dir)
    return read_terms(spark, path), read_lengths(spark, path)


def postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written postings and lengths of documents."""
    from larkspur.sources.index import write_posts

    made = _terms_path(spark, sf_dir)
    path = written(spark, sf_dir, "postings", lambda path: write_posts(spark, made, path))
    return spark.read.parquet(f"{path}/postings"), terms(spark, sf_dir)[1]


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USERS, "name string, tenant string, principals array<string>")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))
