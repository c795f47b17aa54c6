"""Sinks: keyed overwrite, request logs, copies. The chunk index is sources.index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def log_row(query: str = "query", keep_query: bool = True):
    """A log's query column: cut to 120 characters, or left out."""
    return F.substring(F.col(query), 1, 120) if keep_query else F.lit(None).cast("string")


def migrate(source: DataFrame, path: str) -> int:
    """Copies a collection; an empty source and unequal counts are errors."""
    n = source.count()
    if not n:
        raise ValueError("the source is empty")
    source.write.mode("errorifexists").parquet(path)
    if (m := source.sparkSession.read.parquet(path).count()) != n:
        raise ValueError(f"{m} rows arrived of {n}")
    return n


def append_identity(identities: DataFrame, new: DataFrame) -> DataFrame:
    """identities and new ones (key, name, ...); a name that is taken, or comes twice, is an error."""
    both = identities.unionByName(new, allowMissingColumns=True)
    twice = [r.name for r in both.groupBy("name").count().filter("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"names are taken: {', '.join(map(str, twice))}")
    return both
