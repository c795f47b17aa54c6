"""Quality of answers from data: golden chunks against what was retrieved and cited, verdicts of two judges, modes in pairs, weights of a fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import reciprocal
from larkspur.operators.evaluate import verdict_and


def answer_scores(results: DataFrame, golden: DataFrame, retrieved: DataFrame, cited: DataFrame) -> DataFrame:
    """results (mode, q, ...), golden (q, id), retrieved (mode, q, id, rank), cited (mode, q, id) -> and hit_frac, full, rank, citation_frac, n_citations.

    Shares are of a question's distinct golden ids, 0 where it has none; rank is the best of a golden id, null where none was found.
    """
    gold = golden.select("q", "id").distinct()
    asked = results.select("mode", "q").distinct().join(gold, "q")
    hits = retrieved.groupBy("mode", "q", "id").agg(F.min("rank").alias("rank"))
    marks = cited.select("mode", "q", "id").distinct()
    met = asked.join(hits, ["mode", "q", "id"], "left").join(marks.withColumn("marked", F.lit(1)), ["mode", "q", "id"], "left")
    own = met.groupBy("mode", "q").agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("hit_frac"), F.min("rank").alias("rank"), F.avg(F.coalesce("marked", F.lit(0))).alias("citation_frac"))
    out = results.join(own, ["mode", "q"], "left").join(marks.groupBy("mode", "q").agg(F.count("*").alias("n_citations")), ["mode", "q"], "left")
    return out.na.fill(0, ["hit_frac", "citation_frac", "n_citations"]).withColumn("full", F.col("hit_frac") == 1)


def judged(scores: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """scores (mode, q, ...), the lists of two judges (mode, q, faithful, correct) -> and correct, faithful: both say so; null where one says nothing."""
    one = first.select("mode", "q", F.col("correct").alias("c1"), F.col("faithful").alias("f1"))
    two = second.select("mode", "q", F.col("correct").alias("c2"), F.col("faithful").alias("f2"))
    both = scores.join(one, ["mode", "q"], "left").join(two, ["mode", "q"], "left")
    return both.withColumn("correct", verdict_and(F.col("c1"), F.col("c2"))).withColumn("faithful", verdict_and(F.col("f1"), F.col("f2"))).drop("c1", "c2", "f1", "f2")


def same_questions(results: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """results (mode, q, question), fingerprints (mode, q, fp) of the questions that were judged -> results. The job fails where a question isn't the one that was judged: verdicts of other questions make no figures."""
    own = F.substring(F.sha1(F.coalesce("question", F.lit(""))), 1, 12)
    both = results.join(fingerprints.select("mode", "q", "fp"), ["mode", "q"], "left")
    text = F.concat(F.lit("judged for another question: "), F.col("mode"), F.lit("#"), F.col("q").cast("string"))
    # the error stands in a filter, which no pruning of columns takes away
    return both.filter(F.when(F.col("fp").isNull() | (F.col("fp") == own), True).otherwise(F.raise_error(text).cast("boolean"))).drop("fp")


def quality_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (as of `judged`, and n_rounds) -> for each group the means; those of verdicts over judged answers only (correct is not null), null where there is none."""
    mean = lambda c: F.round(F.avg(c), 6)
    known = F.when(F.col("correct").isNotNull(), F.col("faithful").cast("int"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("correct").alias("n_judged"), mean("hit_frac").alias("retrieval_recall"), mean(F.col("full").cast("int")).alias("retrieval_full"),
        mean(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), mean("citation_frac").alias("citation_recall"), mean("n_rounds").alias("avg_rounds"),
        mean(F.col("correct").cast("int")).alias("correctness"), mean(known).alias("faithfulness"),
    )


def mode_pairs(rows: DataFrame, base: str = "single") -> DataFrame:
    """rows (mode, q, correct) -> for each other mode: n, base_mean, mean, delta over the questions that were judged in both. The base's verdict comes by a window over a question's modes."""
    known = rows.filter(F.col("correct").isNotNull()).select("mode", "q", F.col("correct").cast("int").alias("c"))
    both = known.withColumn("b", F.max(F.when(F.col("mode") == base, F.col("c"))).over(Window.partitionBy("q"))).filter((F.col("mode") != base) & F.col("b").isNotNull())
    mean = lambda c: F.round(F.avg(c), 6)
    return both.groupBy("mode").agg(F.count("*").alias("n"), mean("b").alias("base_mean"), mean("c").alias("mean"), F.round(F.avg("c") - F.avg("b"), 6).alias("delta"))


def weight_quality(sparse: DataFrame, dense: DataFrame, golden: DataFrame, weights: list[float], k: int = 60, at: int = 5) -> DataFrame:
    """Lists of many questions, (q, id, sparse_rank) and (q, id, dense_rank), and golden (q, id) -> for each share w of the dense route: n, mrr, recall at `at` of the best golden id in the fused list.

    Lists are short (prefetched rows of a question); ranks are windows over one question and weight. Questions without golden ids don't count.
    All three are shuffled by question once; ids meet, are weighted and ranked where their question is.
    """
    column = lambda name: F.lit(None).cast("int") if name is None else F.col(name).cast("int")
    part = lambda df, s, d, g: df.select("q", "id", column(s).alias("sparse_rank"), column(d).alias("dense_rank"), F.lit(g).alias("gold"))
    rows = part(sparse, "sparse_rank", None, False).unionByName(part(dense, None, "dense_rank", False)).unionByName(part(golden, None, None, True))
    listed = F.col("sparse_rank").isNotNull() | F.col("dense_rank").isNotNull()
    both = rows.repartition("q").groupBy("q", "id").agg(F.min("sparse_rank").alias("sparse_rank"), F.min("dense_rank").alias("dense_rank"), F.max("gold").alias("gold")).withColumn("listed", listed)
    weighted = both.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    score = F.round((1 - F.col("w")) * reciprocal(F.col("sparse_rank"), k) + F.col("w") * reciprocal(F.col("dense_rank"), k), 8)
    # golden ids of no list come last and have no rank
    ranked = weighted.withColumn("rank", F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("listed"), score.desc(), "id")))
    out = ranked.groupBy("q", "w").agg(F.min(F.when(F.col("gold") & F.col("listed"), F.col("rank"))).alias("rank"), F.max("gold").alias("asked")).filter("asked")
    return out.groupBy("w").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce((F.col("rank") <= at).cast("int"), F.lit(0))), 6).alias("recall"))
