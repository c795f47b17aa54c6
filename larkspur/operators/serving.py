"""Composite reads: search with context, whole documents, outlines, larger context, the shaped result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import capped, cjk_share, per_token
from larkspur.operators import context, structure
from larkspur.operators.acl import admits, strictest

ACL = ("acl_tenant", "acl_allow", "acl_visibility", "acl_unset")


def acl_key():
    """An acl as one comparable value; null where there is none."""
    own = F.to_json(F.struct(*[F.sort_array(c) if c == "acl_allow" else F.col(c) for c in ACL]))
    return F.when(F.col("acl_tenant").isNotNull(), own)


def may_see(tenant: str, principals: list[str]):
    return admits(F.lit(tenant), F.array(*[F.lit(p) for p in principals]).cast("array<string>"), *[F.col(c) for c in ACL])


def visible_elements(elements: DataFrame, tenant: str, principals: list[str]) -> DataFrame:
    """Bodies that the user may see, and the headings of sections that have such a body of their own; a section's own body is what has it as its nearest heading."""
    levels = structure.leveled(elements)
    bodies = structure.in_section(levels).filter(may_see(tenant, principals))
    heads = bodies.select("doc_id", F.col("sec_head").alias("idx")).distinct()
    return bodies.drop("sec_head").unionByName(levels.filter("level is not null").join(heads, ["doc_id", "idx"], "left_semi"), allowMissingColumns=True)


def with_chunk_acls(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """elements with the strictest acl of the chunks (doc_id, chunk_no, source_indices, acl columns) that hold them; one that no chunk holds has none and is closed."""
    held = chunks.select("doc_id", "chunk_no", F.explode("source_indices").alias("idx"), *ACL)
    return elements.drop(*ACL).join(strictest(held), ["doc_id", "idx"], "left")


def outline(elements: DataFrame, tenant: str, principals: list[str]) -> DataFrame:
    """doc_id, idx, level, title, end_idx of the sections with a visible body of their own; no breadcrumb, which might name a closed parent."""
    seen = structure.own_bodies(elements, may_see(tenant, principals)).select("doc_id", F.col("sec_head").alias("idx")).distinct()
    return structure.sections(structure.headings(elements), elements).join(seen, ["doc_id", "idx"], "left_semi").select("doc_id", "idx", "level", "title", "end_idx")


def whole_documents(elements: DataFrame, tenant: str, principals: list[str], most: int = 6000) -> DataFrame:
    """doc_id, text, n_tokens, n_elements_visible, truncated."""
    own = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).when(F.size("list_items") > 0, F.array_join("list_items", " ")).otherwise(F.coalesce("caption", F.lit("")))
    rows = visible_elements(elements, tenant, principals).groupBy("doc_id").agg(F.first("lang").alias("lang"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", F.trim(own).alias("t")))).alias("l"))
    joined = rows.select("doc_id", "lang", "n", F.array_join(F.filter("l.t", lambda t: t != ""), "\n").alias("whole"))
    cut = joined.withColumn("text", capped(F.col("whole"), F.lit(most), per_token(F.col("lang"))))
    tokens = F.bround(F.length("text") / per_token(F.col("lang")), 0).cast("int")
    return cut.select("doc_id", "text", tokens.alias("n_tokens"), F.col("n").alias("n_elements_visible"), (F.length("text") < F.length("whole")).alias("truncated"))


def expand(chunks: DataFrame, chunk_ids: list[str] | None, elements: DataFrame, tenant: str, principals: list[str], target: int = 1500) -> DataFrame:
    """Larger blocks around chunks (all, unless told) that the user may see; unknown and closed ids both give no row."""
    asked = chunks if chunk_ids is None else chunks.filter(F.col("chunk_id").isin(chunk_ids))
    hits = asked.filter(may_see(tenant, principals)).withColumn("hit_no", F.col("chunk_no")).withColumn("acl_key", acl_key())
    tree = structure.sections(structure.headings(elements), elements)
    limits = (max(target // 4, 1), target, max(2 * target, 1500))
    return context.big_blocks(hits, elements.withColumn("acl_key", acl_key()), tree, structure.banner_keys(elements), limits)


def search_with_context(hits: DataFrame, elements: DataFrame, tenant: str, principals: list[str], concise: bool = False) -> DataFrame:
    """hits (rank, chunk columns, acl columns, section_id) in rank order -> a row per kept hit with context and context_status.

    Sections are folded first; blocks are gathered from elements of the hit's acl only; the exit checks
    the user's rights again; of equal blocks the first keeps its text.
    """
    kept = context.fold_by_section(hits.filter(may_see(tenant, principals))).withColumn("hit_no", F.col("rank"))
    if concise:
        return kept.withColumn("context", F.lit(None).cast("string")).withColumn("context_status", F.lit("concise"))
    tree = structure.sections(structure.headings(elements), elements)
    blocks = context.big_blocks(kept.withColumn("acl_key", acl_key()), elements.withColumn("acl_key", acl_key()), tree, structure.banner_keys(elements))
    blocks = blocks.select("hit_no", F.col("text").alias("context"), "resolved_section", "anchor_start", "anchor_end", "climbed", "windowed", F.lit(True).alias("found"))
    rows = context.dedup_blocks(kept.join(blocks, "hit_no", "left"))
    status = context.context_status(F.lit(False), F.coalesce("found", F.lit(False)), may_see(tenant, principals), F.col("deduped"), F.col("kind").isin("table", "chart", "image"), F.coalesce("context", F.lit("")) != "", F.coalesce("windowed", F.lit(False)), F.coalesce("climbed", F.lit(0)))
    return rows.withColumn("context_status", status)


def result_meta(rows: DataFrame, session: str = "session") -> DataFrame:
    """A result's counters: returned, deduped, already returned, over budget, tokens, and the hint's kind in its order."""
    is_ = lambda s: F.count_if(F.col("context_status") == s)
    out = rows.groupBy(session).agg(F.count("*").alias("returned_n"), is_("deduped").alias("deduped_n"), is_("already_returned").alias("already_returned_n"), is_("omitted_budget").alias("omitted_n"), F.sum(F.when(~F.col("context_status").isin("already_returned", "omitted_budget"), F.col("tokens")).otherwise(0)).alias("context_tokens"))
    return out.withColumn("hint", F.when(F.col("returned_n") == 0, "empty").when(F.col("omitted_n") > 0, "over_budget").when(F.col("already_returned_n") > 0, "already_returned").otherwise(""))


def demoted(rows: DataFrame, when, status: str) -> DataFrame:
    """Rows for which `when` holds become pointers: no text, no raw content, no image path."""
    out = rows.withColumn("context_status", F.when(when, F.lit(status)).otherwise(F.col("context_status")))
    for c in ("content_raw", "image_path"):
        if c in rows.columns:
            out = out.withColumn(c, F.when(~when, F.col(c)))
    return out.withColumn("text", F.when(when, F.lit("")).otherwise(F.col("text")))


def dedup_key(doc_id, status, resolved_section, anchor_start, anchor_end, chunk_id):
    """A delivered block's key: a window by its section, as its anchor drifts; else the anchor, else the chunk."""
    anchor = F.when(anchor_start.isNotNull(), F.concat_ws("-", anchor_start, anchor_end))
    return F.concat_ws("|", doc_id, F.coalesce(F.when(status == "section_window", resolved_section), anchor, chunk_id))


def detected_lang(elements: DataFrame) -> DataFrame:
    """doc_id, lang: ch if over 0.12 of the first 2,000 characters of the first 40 elements are CJK."""
    head = elements.filter("idx < 40").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    text = F.substring(F.array_join("l.t", " "), 1, 2000)
    return head.select("doc_id", F.when(cjk_share(text) > 0.12, "ch").otherwise("en").alias("lang"))


def answer_grounded(answer, raw):
    """Some number of two digits or more of the answer stands in the table."""
    bare = lambda c: F.translate(F.coalesce(c, F.lit("")), ", ", "")
    numbers = F.filter(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(\d[\d,\.]*\d|\d)"), F.lit(1)), lambda n: bare(n)), lambda n: F.length(n) >= 2)
    return F.exists(numbers, lambda n: F.contains(bare(raw), n))


def spread_pick(items: DataFrame, n: int, by: str) -> DataFrame:
    """items (by, item, size): n of each group at even places of the order by size; a place that is taken moves on. Places rise by one at least, so the next free one is the larger of the even place and the last plus one."""
    w = Window.partitionBy(by)
    rows = items.filter(F.col("size").between(1, 200)).withColumn("pos", F.row_number().over(w.orderBy("size", "item")) - 1).withColumn("m", F.count("*").over(w))
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("m") - 1) / F.lit(max(1, n - 1)), 0).cast("int"))
    bumped = F.aggregate(even, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.greatest(p, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + 1))))
    return rows.filter((F.col("m") <= n) | F.array_contains(bumped, F.col("pos"))).drop("pos", "m")
