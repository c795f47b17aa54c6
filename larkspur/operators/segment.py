"""Words of text that is written without spaces: the likeliest path through a lattice of dictionary words.

A dictionary is a table (word, freq). Runs of unspaced script are made distinct first, so a run that stands in many documents
is segmented once. Up to TASK_WORDS words the dictionary goes to the tasks; a larger one is joined with the runs'
substrings instead, so neither its size nor the texts' is bounded by a task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import ALNUM_RUN

#: Words of a dictionary that go to each task, at most.
TASK_WORDS = 500_000
#: Scripts without spaces between words, and words of all others.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
SPACED_WORD = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+"


def best_path(run: str, starts: list[list[tuple[int, float]]], unknown: float) -> list[str]:
    """The words of the greatest sum of logarithms; starts[i] has (end, logarithm) of the dictionary's words at i. A sign that opens no word stands alone, at `unknown`. Of equal paths the one whose words are longer from the left."""
    n = len(run)
    best, after = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if not starts[i]:  # most places open no word
            best[i], after[i] = unknown + best[i + 1], i + 1
            continue
        ways = starts[i] if any(e == i + 1 for e, _ in starts[i]) else [*starts[i], (i + 1, unknown)]
        best[i], after[i] = max((weight + best[end], end) for end, weight in ways)
    words, i = [], 0
    while i < n:
        words.append(run[i : after[i]])
        i = after[i]
    return words


def segmented(runs: DataFrame, dictionary: DataFrame, task_words: int = TASK_WORDS) -> DataFrame:
    """runs (run, each once) -> run, words. dictionary (word, freq of 1 at least): words without one are left out; a repeated word counts its sum."""
    words = dictionary.filter((F.col("freq") >= 1) & (F.length("word") > 0)).groupBy("word").agg(F.sum("freq").alias("freq"))
    facts = words.agg(F.count("*").alias("n"), F.sum("freq").alias("total"), F.max(F.length("word")).alias("longest")).first()
    if not facts.n:
        return runs.select("run", F.filter(F.split("run", ""), lambda c: c != "").alias("words"))
    unknown, longest = -math.log(facts.total), facts.longest
    weight = F.log(F.col("freq") / F.lit(float(facts.total)))
    if facts.n <= task_words:
        held = runs.sparkSession.sparkContext.broadcast({r.word: r.weight for r in words.select("word", weight.alias("weight")).collect()})  # at most task_words rows

        def look_up(batches):
            import pandas as pd

            known = held.value
            lengths = sorted({len(w) for w in known})  # words of other lengths are not looked for
            for pdf in batches:
                out = []
                for run in pdf["run"]:
                    starts = [[(i + n, known[w]) for n in lengths if (w := run[i : i + n]) in known and len(w) == n] for i in range(len(run))]
                    out.append(best_path(run, starts, unknown))
                yield pd.DataFrame({"run": pdf["run"], "words": out})

        return runs.select("run").mapInPandas(look_up, "run string, words array<string>")

    # a row for each place and length; the lattice's edges are those that are words
    place = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    spans = place.select("run", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1))).alias("n")).select("run", "i", "n", F.substr("run", F.col("i"), F.col("n")).alias("word"))
    edges = spans.join(words.select("word", weight.alias("weight")), "word").groupBy("run").agg(F.collect_list(F.struct("i", "n", "weight")).alias("edges"))

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for run, own in zip(pdf["run"], pdf["edges"], strict=True):
                starts: list[list[tuple[int, float]]] = [[] for _ in run]
                for e in own if own is not None else []:
                    starts[e["i"] - 1].append((e["i"] - 1 + e["n"], e["weight"]))
                out.append(best_path(run, starts, unknown))
            yield pd.DataFrame({"run": pdf["run"], "words": out})

    return runs.join(edges, "run", "left").select("run", "edges").mapInPandas(walk, "run string, words array<string>")


def unspaced_rows(docs: DataFrame, dictionary: DataFrame, task_words: int = TASK_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, tok, word, as search.token_rows has them, with runs of unspaced script in words of the dictionary."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = lambda pattern: F.regexp_extract_all(low, F.lit(f"({pattern})"), F.lit(1))
    exact = F.filter(found(ALNUM_RUN), lambda t: F.length(t) >= 2)
    tagged = lambda a, n: F.transform(a, lambda t: F.struct(t.alias("tok"), F.lit(n).alias("word")))
    rows = docs.select("doc_id", F.explode(F.concat(tagged(found(SPACED_WORD), 1), tagged(exact, 0))).alias("t")).select("doc_id", "t.tok", "t.word")
    runs = docs.select("doc_id", F.explode(found(f"[{UNSPACED}]+")).alias("run")).groupBy("doc_id", "run").agg(F.count("*").alias("times"))
    words = segmented(runs.select("run").distinct(), dictionary, task_words)
    parts = runs.join(words, "run").select("doc_id", "times", F.explode("words").alias("tok"))
    return rows.unionByName(parts.select("doc_id", "tok", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("word")))


