"""Postings in blocks with their greatest frequency, and a search that skips blocks that can't matter.

A slot holds documents of like length, and a block is one term's postings in one slot under one access rule. The heads of
blocks (their count and greatest frequency) give exact document frequencies within what a user may see, and a bound for each
slot's best score, without a posting being read. A search reads the most promising slots, and then the slots whose bound reaches the
k-th score so far. Long documents have the high frequencies, so the slots that are read are few and lie side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.acl import visible
from larkspur.operators.search import query_terms

ACL = ["acl_tenant", "acl_allow", "acl_visibility", "acl_unset"]
#: Levels of length; a level is cut by the ids' hash into parts, so that a slot has about SLOT documents.
LEVELS, SLOT = 256, 128
#: Slots that are read first.
SEEDS = 16


@dataclass
class Blocks:
    rows: DataFrame  # tok, slot, acl columns, n, most, entries (doc_id, tf)
    rules: DataFrame  # acl columns, n: documents under each access rule


def write_blocks(docs: DataFrame, posts: DataFrame | None, lengths: DataFrame, path: str, slot: int = SLOT, terms: DataFrame | None = None) -> None:
    """docs (doc_id, acl columns), posts (tok, doc_id, tf) and lengths (doc_id, len), as blocks at path. A block has LEVELS x slot postings at most, even if all lengths are equal.

    terms: a row for each document (doc_id, acl columns, len, terms), where there are such; its slot is then told before its terms are parted, and postings
    needn't meet their documents in a join, nor be there. Either way they are shuffled by term and slot once for the blocks.
    """
    from larkspur.sources.index import partitions_for

    spark = docs.sparkSession
    steps = [i / LEVELS for i in range(1, LEVELS)]
    n = lengths.count()
    bounds = lengths.select(F.percentile_approx("len", steps, 1 << 14).alias("b")).first().b or []
    level = F.aggregate(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<long>"), F.lit(0), lambda s, b: s + (b >= F.col("len")).cast("int"))  # 0: the longest
    parts = max(1, -(-n // (LEVELS * slot)))
    slots = (docs.select("doc_id", *ACL).join(lengths, "doc_id") if terms is None else terms).withColumn("slot", level.cast("long") * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    if terms is None:
        own = posts.select("tok", "doc_id", "tf").join(slots.select("doc_id", *ACL, "slot"), "doc_id")
    else:
        own = slots.select("doc_id", *ACL, "slot", F.explode("terms").alias("t")).select("t.tok", "doc_id", "t.tf", *ACL, "slot")
    entry = F.struct("doc_id", "tf")
    # a group lies within the partition of its term and slot, so it takes no further shuffle
    met = own.repartition(partitions_for(lengths), "tok", "slot").groupBy("tok", "slot", *ACL)
    blocks = met.agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.array_sort(F.collect_list(entry)).alias("entries"))
    blocks.sortWithinPartitions("tok", "slot").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    docs.groupBy(*ACL).agg(F.count("*").alias("n")).write.parquet(f"{path}/rules")


def read_blocks(spark: SparkSession, path: str) -> Blocks:
    return Blocks(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/rules"))


@dataclass
class Reading:
    """slots (slot, bound) that a search reads, and how many there are of them and of all that hold a term."""

    rows: DataFrame  # blocks of the terms, with idf
    slots: DataFrame
    bottom: float | None
    n_read: int
    n_slots: int
    low: int
    high: int

    def scores(self) -> DataFrame:
        return _scores(self.rows.filter(F.col("slot").between(self.low, self.high)), self.slots)


def _scores(rows: DataFrame, slots: DataFrame) -> DataFrame:
    few = rows.join(slots.select("slot"), "slot", "left_semi").select("idf", F.explode("entries").alias("e"))
    return few.groupBy(F.col("e.doc_id").alias("doc_id")).agg(F.round(F.sum(F.col("e.tf") * F.col("idf")), 6).alias("score"))


def planned(blocks: Blocks, text: str, tenant: str, principals: list[str], k: int) -> Reading:
    """What a search for the best k has to read."""
    spark = blocks.rows.sparkSession
    terms = [r.tok for r in query_terms(spark, text).collect()]  # a query's words
    own = visible(blocks.rows, tenant, principals).filter(F.col("tok").isin(terms))
    heads = own.select("tok", "slot", "n", "most")
    total = visible(blocks.rules, tenant, principals).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    df = heads.groupBy("tok").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))
    idf = df.select("tok", F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = {r.tok: r.idf for r in idf.collect()}  # a query's words
    weight: Column = F.coalesce(*[F.when(F.col("tok") == t, F.lit(w)) for t, w in sorted(weights.items())], F.lit(0.0))
    bounds = heads.groupBy("slot", "tok").agg(F.max("most").alias("most")).groupBy("slot").agg(F.sum(F.col("most") * weight).alias("bound"))
    rows = own.select("slot", "entries", weight.alias("idf"))
    first = bounds.orderBy(F.desc("bound"), "slot").limit(SEEDS)
    found = _scores(rows, first).orderBy(F.desc("score"), "doc_id").limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    bottom = found.least if found.n >= k else None
    slots = bounds if bottom is None else bounds.filter(F.col("bound") + 1e-6 >= bottom)
    facts = bounds.agg(F.count("*").alias("all"), *((f(F.when(F.lit(True) if bottom is None else F.col("bound") + 1e-6 >= bottom, F.col("slot")))).alias(a) for a, f in (("read", F.count), ("low", F.min), ("high", F.max)))).first()
    return Reading(rows, slots, bottom, facts.read, facts["all"], facts.low or 0, facts.high or 0)


def block_scores(blocks: Blocks, text: str, tenant: str, principals: list[str], k: int = 50) -> DataFrame:
    """doc_id, score = sum of tf * idf, whose best k are those of all documents that the user may see, with frequencies among these."""
    return planned(blocks, text, tenant, principals, k).scores()
