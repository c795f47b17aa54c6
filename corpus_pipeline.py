"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again.

All stages but the last return the columns of documents, whatever else these hold; they take null, empty and very long
texts, null and equal doc_ids, repeated rows and empty tables, as the operator that each names says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import dropped, fresh_path, kept, sweep
from larkspur.llm.decontaminate import keep_uncontaminated
from larkspur.llm.queries import packed_digest
from larkspur.llm.simhash import keep_one
from larkspur.llm.substring import strip_repeats
from larkspur.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from this stage's input and the labels, rejects go.

    Null and empty texts have the score of no words and stay; equal texts go or stay together; no rows give no rows.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays, as op10 links them: three-word shingles, three bits.

    Null ids come last, of equal ids the text decides, of equal rows one stays; null and empty texts are one component; no rows give no rows.
    """
    return keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go from the texts, and n_chars follows; a document of which nothing is left goes.

    A text without repeats stays as it is, null and empty ones too; repeated rows lose each other's windows; no rows give no rows.
    """
    return strip_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing; equal rows go or stay together; no items or no rows change nothing.
    """
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as op4's query returns them.

    A null or empty text is its end id alone, a very long one many pieces; repeated rows are packed each; no rows, no pieces.
    """
    return packed_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learnt model and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's temporary tables, and its input, are deleted when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        mark, path = kept(spark), fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, mark)
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
