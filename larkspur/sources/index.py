"""The chunk index: immutable batches and a manifest, and postings that a search reads only in part.

A batch is a folder of chunks and one of the documents that it replaces; a document's chunks are those of
the last batch that names it. Each change is a new numbered manifest, put in place by a rename, so readers see all of it or nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.search import document_terms

VERSION = 1
#: Batches from which a write merges them all.
MOST_BATCHES = 16


class VersionError(ValueError):
    """The index was written by another version and has to be made anew."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest; an empty one where there is no index."""
    fs, folder = _files(spark, f"{path}/_manifest")
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return {"version": VERSION, "number": 0, "batches": []}
    state = json.loads(spark.read.text(f"{path}/_manifest/{names[-1]}", wholetext=True).first()[0])
    if state.get("version") != VERSION:
        raise VersionError(f"the index at {path} has version {state.get('version')}, not {VERSION}")
    return state


def _commit(spark: SparkSession, path: str, state: dict, batches: list[dict]) -> None:
    """Puts the next manifest in place, or fails if another writer was faster."""
    number = state["number"] + 1
    text = json.dumps({"version": VERSION, "number": number, "batches": batches})
    fs, temp = _files(spark, f"{path}/_manifest/.tmp-{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    if not fs.rename(temp, _files(spark, f"{path}/_manifest/{number:012d}.json")[1]):
        fs.delete(temp, False)
        raise RuntimeError(f"another writer changed the index at {path}")


def write_index(chunks: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Adds chunks (doc_id, ...) as a batch that replaces the chunks of its documents, or of `documents` (doc_id), which may have none."""
    spark = chunks.sparkSession
    state, name = manifest(spark, path), uuid.uuid4().hex
    chunks.write.parquet(f"{path}/chunks-{name}")
    written = spark.read.schema(chunks.schema).parquet(f"{path}/chunks-{name}").select("doc_id")
    (written if documents is None else written.unionByName(documents.select("doc_id"))).distinct().write.parquet(f"{path}/documents-{name}")
    _commit(spark, path, state, [*state["batches"], {"name": name, "schema": chunks.schema.json()}])
    if len(state["batches"]) + 1 >= MOST_BATCHES:
        merge_index(spark, path)


def delete_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Takes the chunks of documents (doc_id) out of the index."""
    state = manifest(spark, path)
    if state["batches"]:
        write_index(read_index(spark, path).limit(0), path, documents)


def read_index(spark: SparkSession, path: str, doc_id=None) -> DataFrame:
    """The chunks as they are now, of one document if it is named. No index is an error."""
    from pyspark.sql.types import StructType

    batches = manifest(spark, path)["batches"]
    if not batches:
        raise FileNotFoundError(f"no index at {path}")
    rows = named = None
    for n, b in enumerate(batches):
        schema = StructType.fromJson(json.loads(b["schema"]))
        one = lambda df, n=n: (df if doc_id is None else df.filter(F.col("doc_id") == doc_id)).withColumn("_batch", F.lit(n))
        own, docs = one(spark.read.schema(schema).parquet(f"{path}/chunks-{b['name']}")), one(spark.read.schema(StructType([schema["doc_id"]])).parquet(f"{path}/documents-{b['name']}"))
        rows, named = (own, docs) if rows is None else (rows.unionByName(own, allowMissingColumns=True), named.unionByName(docs))
    if len(batches) == 1:
        return rows.drop("_batch")
    last = named.groupBy("doc_id").agg(F.max("_batch").alias("_batch"))
    return rows.join(last, ["doc_id", "_batch"], "left_semi").drop("_batch")


def merge_index(spark: SparkSession, path: str) -> None:
    """All batches as one; the old ones' folders are deleted after the manifest changed."""
    state, name = manifest(spark, path), uuid.uuid4().hex
    rows = read_index(spark, path)
    rows.write.parquet(f"{path}/chunks-{name}")
    spark.read.schema(rows.schema).parquet(f"{path}/chunks-{name}").select("doc_id").distinct().write.parquet(f"{path}/documents-{name}")
    _commit(spark, path, state, [{"name": name, "schema": rows.schema.json()}])
    for b in state["batches"]:
        for kind in ("chunks", "documents"):
            fs, where = _files(spark, f"{path}/{kind}-{b['name']}")
            fs.delete(where, True)


def refused(documents: DataFrame) -> DataFrame:
    """doc_id, error: documents that may not be indexed, as nobody could see them: restricted ones that allow nobody."""
    closed = (F.col("acl_visibility") == "restricted") & (F.size(F.coalesce("acl_allow", F.array().cast("array<string>"))) == 0)
    return documents.filter(closed).select("doc_id", F.lit("restricted without anybody allowed").alias("error"))


def dense_elements(elements: DataFrame) -> DataFrame:
    """doc_id, ok: whether a document's elements are numbered from 0 without gaps or repeats."""
    n = F.count("*")
    return elements.groupBy("doc_id").agg(((F.min("idx") == 0) & (F.max("idx") + 1 == n) & (F.count_distinct("idx") == n)).alias("ok"))


def index_run(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, status (indexed or failed), error: what a run over documents does. One failure does not stop the others; the driver exits non-zero if there is any."""
    gaps = dense_elements(elements).filter(~F.col("ok")).select("doc_id", F.lit("elements are not dense").alias("error"))
    faults = refused(documents).unionByName(gaps).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("error"))
    return documents.select("doc_id").join(faults, "doc_id", "left").select("doc_id", F.when(F.col("error").isNull(), "indexed").otherwise("failed").alias("status"), "error")


def index_counts(chunks: DataFrame, by: str) -> DataFrame:
    """images, texts, skipped (nothing to encode) and indexed chunks."""
    empty = (F.trim(F.coalesce("text", F.lit(""))) == "") & F.col("image_path").isNull()
    image = F.col("image_path").isNotNull()
    return chunks.groupBy(by).agg(F.count_if(image).alias("images"), F.count_if(~image & ~empty).alias("texts"), F.count_if(empty).alias("skipped"), F.count_if(~empty).alias("indexed"))


def write_counted(chunks: DataFrame, path: str) -> dict[str, int]:
    """Writes chunks to a new folder and returns images, texts, skipped and indexed, counted in the writing pass itself; what was skipped is not written.

    The files are then counted by their footers: a count that disagrees (a task that ran twice is observed twice) refuses the folder.
    """
    from pyspark.sql import Observation

    image = F.col("image_path").isNotNull()
    empty = (F.trim(F.coalesce("text", F.lit(""))) == "") & ~image
    seen = Observation()
    counts = [F.count_if(image).alias("images"), F.count_if(~image & ~empty).alias("texts"), F.count_if(empty).alias("skipped"), F.count_if(~empty).alias("indexed")]
    chunks.observe(seen, *counts).filter(~empty).write.parquet(path)
    told = {k: int(v) for k, v in seen.get.items()}
    check_counts(told, chunks.sparkSession.read.parquet(path).count())
    return told


class CountError(RuntimeError):
    """What was written is not what was counted."""


def check_counts(told: dict[str, int], written: int) -> None:
    if told["indexed"] != written or told["images"] + told["texts"] != told["indexed"]:
        raise CountError(f"{written} chunks were written, but {told} counted")


def by_chunk_id(chunks: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Those chunks (chunk_id); unknown ids give no row."""
    return chunks.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def document_lang(chunks: DataFrame) -> DataFrame:
    """doc_id, lang: the language of a document's chunks; of several the smallest."""
    return chunks.groupBy("doc_id").agg(F.min("lang").alias("lang"))


def checked_vectors(vectors: DataFrame, width: int, model: str | None = None, written_by: str | None = None) -> DataFrame:
    """vectors whose embedding has that width; another width, or another model where both are known, is an error."""
    if model and written_by and model != written_by:
        raise ValueError(f"vectors of {written_by}, not of {model}")
    wrong = F.raise_error(F.concat(F.lit(f"a vector has not width {width} but "), F.size("embedding")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(wrong))


#: Partitions that a term's postings are spread over, at most: a word of every document is no single task's work.
SPREAD = 16
#: Tokens whose postings are one partition, about.
PART_TOKENS = 1 << 22


def partitions_for(lengths: DataFrame) -> int:
    """Of postings: the session's, or more where these would be large."""
    tokens = lengths.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    return max(1, int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))


def write_terms(docs: DataFrame, path: str) -> None:
    """docs (doc_id, text, ...) -> terms (their other columns, len, and tok and tf of each term) and lengths. Texts are read once, and nothing is shuffled."""
    document_terms(docs).write.mode("overwrite").parquet(f"{path}/terms")
    docs.sparkSession.read.parquet(f"{path}/terms").select("doc_id", "len").write.mode("overwrite").parquet(f"{path}/lengths")


def write_posts(spark: SparkSession, terms_path: str, path: str) -> None:
    """What write_terms wrote -> postings (tok, doc_id, tf, len), in order of tok within a file, so that a search reads the row groups of its terms only.

    They are shuffled once, by a hash of the term. A hash needs no sample of the rows, which would have them made twice.
    """
    posts = read_terms(spark, terms_path).select("doc_id", "len", F.explode("terms").alias("t")).select("t.tok", "doc_id", "t.tf", "len")
    n = partitions_for(read_lengths(spark, terms_path))
    out = posts.repartition(n, "tok", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("tok", "doc_id")
    out.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")


def write_postings(docs: DataFrame, path: str) -> None:
    """docs (doc_id, text, ...) -> terms, lengths and postings at one path."""
    write_terms(docs, path)
    write_posts(docs.sparkSession, path, path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/lengths")


def read_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tok, doc_id, tf, len) and (doc_id, len)."""
    return spark.read.parquet(f"{path}/postings"), read_lengths(spark, path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, the other columns that were given, len and terms (tok, tf): a row for each document."""
    return spark.read.parquet(f"{path}/terms")
