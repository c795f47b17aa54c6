"""Shaping of ranked hits and answers: budgets, hints, prompts, the deterministic answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import CITE, is_refusal, looks_numeric, neutralize

#: The deterministic answer's words, and the markers that a prompt's contexts carry.
REFUSAL = "I don't have enough information in the provided context to answer."
MOCK = ("Based on the retrieved context ", ", here is a grounded mock answer citing the provided sources.")
MARKER = r"\[cite:(\d+)\]"
MOST_RETURNED = 5000


def hit_tokens(n_tokens: Column, text: Column, raw: Column) -> Column:
    size = F.length(F.coalesce(text, F.lit(""))) + F.length(F.coalesce(raw, F.lit("")))
    return F.greatest(F.coalesce(n_tokens, F.lit(0)).cast("bigint"), F.floor(size / 4), F.lit(1).cast("bigint"))


def budget_setting(value: Column) -> Column:
    return F.greatest(F.lit(500), F.coalesce(value.try_cast("int"), F.lit(12000)))


def skip_over_budget(ranked: DataFrame, most: int, key: str = "session") -> DataFrame:
    """session, rank, tokens -> and delivered: in rank order, the first always, a later one if it still fits. One over the budget is passed over, and smaller ones after it may fit.
    A session's list is short (a query's top hits), so it is folded as an array."""
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("l"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<rank:int,tokens:bigint,delivered:boolean>>").alias("out"))

    def step(acc, x):
        ok = (F.size(acc["out"]) == 0) | (acc["used"] + x["tokens"] <= most)
        row = F.struct(x["rank"].cast("int").alias("rank"), x["tokens"].cast("bigint").alias("tokens"), ok.alias("delivered"))
        return F.struct((acc["used"] + F.when(ok, x["tokens"]).otherwise(0)).cast("bigint").alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    return lists.select(key, F.explode(F.aggregate("l", zero, step)["out"]).alias("r")).select(key, "r.*")


def prefix_budget(ranked: DataFrame, most: int, key: str = "session") -> DataFrame:
    """Only hits before the first that overflows; the first always."""
    w = Window.partitionBy(key).orderBy("rank")
    sums = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("rn", F.row_number().over(w)).withColumn("over", F.max(((sums > most) & (F.col("rn") > 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("over = 0").drop("rn", "over")


def first_deliveries(hits: DataFrame, session: str = "session", key: str = "key", order: str = "at", delivered: str | None = None) -> DataFrame:
    """hits and already_returned: whether the session was given the key before. A hit whose `delivered` is false was not given."""
    before = Window.partitionBy(session, key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    given = F.col(delivered).cast("int") if delivered else F.lit(1)
    return hits.withColumn("already_returned", F.coalesce(F.max(given).over(before) == 1, F.lit(False)))


def delivered(hits: DataFrame, seen: DataFrame, most: int, session: str = "session") -> DataFrame:
    """hits (session, rank, key, tokens), seen (session, key) -> and status: already_returned, omitted_budget or full.

    What the session has is set aside first; of the rest, in rank order, those within the budget are given. Only rows of status full are to be added to seen.
    """
    flagged = hits.join(seen.select(session, "key").distinct().withColumn("again", F.lit(True)), [session, "key"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    given = skip_over_budget(flagged.filter(~F.col("again")), most, session).select(session, "rank", "delivered")
    status = F.when(F.col("again"), "already_returned").when(F.col("delivered"), "full").otherwise("omitted_budget")
    return flagged.join(given, [session, "rank"], "left").withColumn("status", status).drop("again", "delivered")


def argument_error(tenant: Column, query: Column, top_k: Column, mode: Column, strategy: Column) -> Column:
    """The first fault of a request's arguments, null if there is none."""
    return (
        F.when(F.coalesce(tenant, F.lit("")) == "", "no_identity")
        .when(F.trim(F.coalesce(query, F.lit(""))) == "", "empty_query")
        .when((top_k < 1) | ~mode.isin("full", "concise") | ~strategy.isin("hybrid", "dense", "sparse"), "bad_arg")
    )


def prompt(texts: Column) -> Column:
    """Numbered context blocks with cite markers inside the texts made harmless."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[cite:"), (i + 1).cast("string"), F.lit("] "), neutralize(t))), "\n\n")


def mock_answer(message: Column) -> Column:
    """Cites the two smallest markers of the message, refuses where there are none."""
    marks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(message, F.lit(MARKER), F.lit(1)), lambda x: x.try_cast("int"))))
    cited = F.array_join(F.transform(F.slice(marks, 1, 2), lambda n: F.concat(F.lit("[cite:"), n.cast("string"), F.lit("]"))), "")
    return F.when(F.size(marks) > 0, F.concat(F.lit(MOCK[0]), cited, F.lit(MOCK[1]))).otherwise(F.lit(REFUSAL))


def hints(conditions: list[tuple[Column, str]], most: int = 3) -> Column:
    return F.slice(F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in conditions]), lambda x: x.isNotNull()), 1, most)


def wants_table_retry(query: Column, answer: Column, kind: Column) -> Column:
    """A numeric question that was refused and didn't ask for a kind."""
    return looks_numeric(query) & is_refusal(answer) & kind.isNull()


def ids_after_retry(ids: Column, leg: Column, query: Column, first: Column, second: Column) -> Column:
    """What was retrieved: the leg's ids join the others where a refused numeric question was answered at the second try."""
    kept = looks_numeric(query) & is_refusal(first) & ~is_refusal(second)
    return F.when(kept, F.array_union(ids, leg)).otherwise(F.array_distinct(ids))


def append_raw(text: Column, raw: Column, kind: Column, least: int = 40) -> Column:
    """A chart's or table's raw content after its text, unless the text holds it; raw content under `least` letters always, as a text may hold a short one by chance."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    own = trimmed(F.coalesce(raw, F.lit("")))
    need = kind.isin("chart", "table") & (own != "") & ((F.length(bare(own)) < least) | ~bare(text).contains(bare(own)))
    return F.when(need, trimmed(F.concat(text, F.lit("\n"), own))).otherwise(text)


def http_status(code: Column, is_json: Column) -> Column:
    return F.when(code == 401, "no_identity").when(code.between(300, 399), "redirected").when(code.between(400, 499), "bad_request").when(code >= 500, "backend_unavailable").when(~is_json, "bad_response").otherwise("ok")


def is_error(code: Column, status: Column) -> Column:
    return (code >= 400) | ~F.coalesce(status, F.lit("ok")).isin("ok", "empty")
