"""Exact deduplication: rows are grouped by a 128-bit hash of their text, a stable id of each group stays, bytes are compared inside groups.

A text travels once, in an aggregation by hash and text, which compares bytes; copies meet before they travel. A hash
with several texts has collided, and its rows are grouped by hash and text; as good as always there is none, and
everything else works on ids and hashes. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, column, free_names, joined


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _best(keep: str) -> Column:
    """Of rows (id, row): the one with the smallest or largest id, null ids last, of equal ids the first row."""
    if keep == "largest":
        return F.max(F.struct(F.col("id").isNotNull(), F.col("id"), (-F.col("row")).alias("row")))
    return F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))


def _groups(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """by, n, keep_id, keep_row of the groups of at least two rows."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), _best(keep).alias("best")).filter("n > 1")
    return found.select(*by, "n", F.col("best.id").alias("keep_id"), F.abs("best.row").alias("keep_row"))


def collisions(texts: DataFrame) -> DataFrame:
    """texts (hash, text) -> hash, n (their rows) of the hashes that texts of different bytes share. Grouping by hash and text compares bytes."""
    classes = texts.groupBy("hash", "text").agg(F.count("*").alias("rows"))
    return classes.groupBy("hash").agg(F.sum("rows").alias("n"), F.count("*").alias("texts")).filter("texts > 1").select("hash", "n")


def _parts(scratch: Scratch, docs: DataFrame, keep: str, digest: Callable[[Column], Column]) -> list[tuple[DataFrame, DataFrame, list[str]]]:
    """(rows, groups, by) of the rows whose hash is that of one text, and of those whose hash has collided, if there are any."""
    text = F.coalesce(column("text"), F.lit(""))
    keyed = docs.select(column("doc_id").alias("id"), digest(text).alias("hash"), text.alias("text"))
    facts = ["id", "hash", F.unhex(F.sha2("text", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")]
    rows = scratch.stage(keyed.select(*facts), "rows")
    collided = scratch.stage(collisions(keyed), "collided")
    if collided.isEmpty():  # as good as always with 128 bits
        return [(rows, scratch.stage(_groups(rows, ["hash"], keep), "groups"), ["hash"])]
    apart = scratch.stage(joined(keyed, collided, ["hash"], "n", "left_semi").select(*facts, "text"), "apart")
    rows = rows.join(collided, "hash", "left_anti")
    return [(rows, scratch.stage(_groups(rows, ["hash"], keep), "groups"), ["hash"]), (apart, scratch.stage(_groups(apart, ["hash", "text"], keep), "classes"), ["hash", "text"])]


def _report(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    out = joined(rows, groups.withColumn("group_size", F.col("n")), by, "n", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """docs (doc_id of any type, text; other columns are left out) -> doc_id, keep_id, group_size, kept, text_sha256; a row for each row.

    Null texts are empty ones; upper and lower case, white space and normal forms differ. Of equal texts the row with the smallest
    (or largest) id stays, a null id only if all are null; of rows with that id and text exactly one stays. A very long text is
    a text like others. No rows, no result rows. digest may be any hash: texts that collide are told apart by their bytes.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    scratch = Scratch(docs.sparkSession)
    parts = [_report(*p) for p in _parts(scratch, docs, keep, digest)]
    scratch.drop(*scratch.paths)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def keep_one(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """docs, of equal texts only a row with the id that exact_duplicates keeps, with all its columns; of rows with that id and text any one.

    Null and empty texts are equal, null ids come last, no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    own = dict(zip(("hash", "text", "best", "n"), free_names(docs, "hash", "text", "best", "n"), strict=True))
    text = F.coalesce(column("text"), F.lit(""))
    tagged = docs.withColumns({own["hash"]: digest(text), own["text"]: text})
    few, parts, taken = [column(c) for c in docs.columns], _parts(scratch, docs, keep, digest), None
    for _, groups, by in reversed(parts):
        on = [own[c] for c in by]
        named = groups.select(*(F.col(c).alias(own[c]) for c in by), F.struct("keep_id").alias(own["best"]), F.col("n").alias(own["n"]))
        mine = tagged
        if len(parts) > 1:
            apart = parts[1][0].select(F.col("hash").alias(own["hash"])).distinct()
            mine = tagged.join(apart, own["hash"], "left_semi" if len(by) > 1 else "left_anti")
        found, best = joined(mine, named, on, own["n"], "left"), F.col(own["best"])
        alone, several = found.filter(best.isNull()), found.filter(best.isNotNull() & best["keep_id"].eqNullSafe(column("doc_id")))
        kept = alone.select(*few).unionByName(several.dropDuplicates(on).select(*few))
        taken = kept if taken is None else taken.unionByName(kept)
    scratch.drop(*scratch.paths)
    return taken
