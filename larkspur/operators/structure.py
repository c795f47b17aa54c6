"""Elements, running banners, heading levels, the section tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import norm_text

#: Kinds that are page furniture, and the patterns of lines that are no headings.
NOISE = ["header", "footer", "page_number", "aside_text"]
TOC_LEADER = r"(\.{3,}|…)\s*\d+\s*$"
TOC_TAIL = r"^\d+(?:\.\d+)*\s+.+\s+\d{1,3}\s*$"
BULLET = r"^\s*[-–—•·●○▪◦]\s"
LAW_SECTION = r"(?i)^\s*(SECTION|SEC\.)\s+\d+"
MAX_HEADING = 120


def banners(elements: DataFrame) -> DataFrame:
    """doc_id, norm: texts that stand at least three times and on half of a document's pages, where it has four or more, and don't end in a colon."""
    pages = elements.groupBy("doc_id").agg((F.max("page") + 1).alias("pages")).filter("pages >= 4")
    texts = elements.filter(~F.col("kind").isin(NOISE)).withColumn("norm", norm_text(F.col("text"))).filter((F.col("norm") != "") & ~F.col("norm").rlike("[:：]$"))
    counted = texts.groupBy("doc_id", "norm").agg(F.count("*").alias("freq"), F.count_distinct("page").alias("on_pages")).filter("freq >= 3")
    return counted.join(pages, "doc_id").filter("on_pages >= pages * 0.5").select("doc_id", "norm", "freq", "on_pages", "pages")


def norm_key() -> Column:
    """128 bits of an element's plain text, which travel in its place."""
    norm = norm_text(F.col("text"))
    return F.struct(F.xxhash64(norm).alias("a"), F.xxhash64(F.lit(1), norm).alias("b"))


def banner_keys(elements: DataFrame) -> DataFrame:
    """doc_id, banner_keys of documents that have banners, of one pass over keys and pages; no text is shuffled."""
    norm = norm_text(F.col("text"))
    able = ~F.col("kind").isin(NOISE) & (norm != "") & ~norm.rlike("[:：]$")
    spots = elements.select("doc_id", "page", F.when(able, norm_key()).alias("key")).groupBy("doc_id", "key", "page").agg(F.count("*").alias("n"))
    texts = spots.groupBy("doc_id", "key").agg(F.sum("n").alias("freq"), F.count("page").alias("on_pages"), F.max("page").alias("last"))
    often = F.when(F.col("key").isNotNull() & (F.col("freq") >= 3), F.struct("key", "on_pages"))
    docs = texts.groupBy("doc_id").agg((F.max("last") + 1).alias("pages"), F.collect_list(often).alias("often")).filter("pages >= 4")
    keys = F.transform(F.filter("often", lambda t: t["on_pages"] >= F.col("pages") * 0.5), lambda t: t["key"])
    return docs.select("doc_id", keys.alias("banner_keys")).filter(F.size("banner_keys") > 0)


def without_noise(elements: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """elements without page furniture and banners; where they are but some of a document's elements, `of` are all, from which banners are told."""
    kept = elements.filter(~F.col("kind").isin(NOISE)).join(banner_keys(elements if of is None else of), "doc_id", "left")
    return kept.filter(F.col("banner_keys").isNull() | ~F.array_contains("banner_keys", norm_key())).drop("banner_keys")


def no_heading(text: Column) -> Column:
    return text.rlike(TOC_LEADER) | text.rlike(TOC_TAIL) | (F.length(text) > MAX_HEADING) | text.rlike(BULLET)


def leading_number(text: Column) -> tuple[Column, Column]:
    """(kind, value): dotted with its depth, bare with its number, null without a number or with a year."""
    token = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    none = (token == "") | F.substring_index(token, ".", 1).rlike(r"^(19|20)\d\d$")
    dotted = token.contains(".")
    return F.when(~none, F.when(dotted, "dotted").otherwise("bare")), F.when(~none, F.when(dotted, F.size(F.split(token, r"\.")).cast("bigint")).otherwise(token.try_cast("bigint")))


def promote_bare(elements: DataFrame) -> DataFrame:
    """doc_id, promote: whether the bare heading numbers only rise."""
    text = F.trim("text")
    kind, value = leading_number(text)
    bare = elements.filter((F.coalesce("text_level", F.lit(0)) != 0) & ~no_heading(text)).select("doc_id", "idx", kind.alias("k"), value.alias("n")).filter("k = 'bare'")
    step = F.lag("n").over(Window.partitionBy("doc_id").orderBy("idx"))
    return bare.withColumn("up", F.coalesce(F.col("n") > step, F.lit(True))).groupBy("doc_id").agg(F.bool_and("up").alias("promote"))


def heading_level(text: Column, text_level: Column, doc_type: Column, promote: Column) -> Column:
    text = F.trim(text)
    kind, value = leading_number(text)
    return (
        F.when(no_heading(text), None)
        .when((doc_type == "law") & text.rlike(LAW_SECTION), 1)
        .when(F.coalesce(text_level, F.lit(0)) == 0, None)
        .when(kind == "dotted", value)
        .when((kind == "bare") & promote, 1)
        .otherwise(text_level)
        .cast("int")
    )


def may_head(text: Column, text_level: Column, doc_type: Column) -> Column:
    """Whether heading_level is not null, which no other element has a say in."""
    text, no = F.trim(text), F.lit(False)
    return ~F.coalesce(no_heading(text), no) & (F.coalesce((doc_type == "law") & text.rlike(LAW_SECTION), no) | (F.coalesce(text_level, F.lit(0)) != 0))


def _with_level(kept: DataFrame) -> DataFrame:
    return kept.join(promote_bare(kept), "doc_id", "left").withColumn("level", heading_level(F.col("text"), F.col("text_level"), F.col("doc_type"), F.coalesce("promote", F.lit(True)))).drop("promote")


def leveled(elements: DataFrame) -> DataFrame:
    """elements without noise, and level (null for bodies)."""
    return _with_level(without_noise(elements))


def headings(elements: DataFrame) -> DataFrame:
    """The headings among `leveled`; bodies are left out before anything is shuffled."""
    own = elements.filter(may_head(F.col("text"), F.col("text_level"), F.col("doc_type")))
    return _with_level(without_noise(own, elements)).filter("level is not null")


def sections(levels: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, idx, level, title, end_idx, parent_idx, breadcrumb: one pass of each document's headings with a stack.

    The end is the next heading of the same or a higher rank, the parent the nearest one before of a
    higher rank; a document's headings are folded in order, which needs no self-join.
    """
    ends = elements.groupBy("doc_id").agg((F.max("idx") + 1).alias("doc_end"))
    heads = levels.filter("level is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "level", F.trim("text").alias("title")))).alias("h")).join(ends, "doc_id")

    def run(batches):
        for pdf in batches:
            out: list[tuple] = []
            for doc, heads, doc_end in zip(pdf["doc_id"], pdf["h"], pdf["doc_end"], strict=True):
                rows, stack = [], []
                for h in heads:
                    while stack and stack[-1]["level"] >= h["level"]:
                        stack.pop()["end_idx"] = h["idx"]
                    parent = stack[-1]["idx"] if stack else None
                    row = {"idx": h["idx"], "level": h["level"], "title": h["title"], "end_idx": doc_end, "parent_idx": parent, "breadcrumb": [*(s["title"] for s in stack), h["title"]]}
                    stack.append(row)
                    rows.append(row)
                out += [(doc, *r.values()) for r in rows]
            import pandas as pd

            frame = pd.DataFrame(out, columns=["doc_id", "idx", "level", "title", "end_idx", "parent_idx", "breadcrumb"])
            frame["parent_idx"] = frame["parent_idx"].astype("Int64")
            yield frame

    kind = elements.schema["doc_id"].dataType.simpleString()
    return heads.mapInPandas(run, f"doc_id {kind}, idx int, level int, title string, end_idx int, parent_idx int, breadcrumb array<string>")


def section_of(levels: DataFrame) -> DataFrame:
    """levels with sec_head, the nearest heading before (as-of), for a heading itself."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn("sec_head", F.last(F.when(F.col("level").isNotNull(), F.col("idx")), ignorenulls=True).over(w))


def own_bodies(elements: DataFrame, which: Column) -> DataFrame:
    """doc_id, idx, sec_head of the bodies for which `which` holds; the rows of in_section(leveled(elements)), but texts stay where they are read: a key and two flags of each element are shuffled."""
    slim = elements.filter(~F.col("kind").isin(NOISE)).select("doc_id", "idx", may_head(F.col("text"), F.col("text_level"), F.col("doc_type")).alias("head"), norm_key().alias("key"), which.alias("which"))
    kept = slim.join(banner_keys(elements), "doc_id", "left").filter(F.col("banner_keys").isNull() | ~F.array_contains("banner_keys", F.col("key"))).select("doc_id", "idx", "head", "which")
    return section_of(kept.withColumn("level", F.when(F.col("head"), 1))).filter("which and not head").select("doc_id", "idx", "sec_head")


def in_section(levels: DataFrame) -> DataFrame:
    """Bodies with sec_head."""
    return section_of(levels).filter("level is null")


def sections_by_id(sections: DataFrame) -> DataFrame:
    """doc_id, sections: a map of a document's sections by their heading's id."""
    entry = F.struct(F.concat_ws("::s", "doc_id", "idx").alias("key"), F.struct("idx", "level", "title", "end_idx", "parent_idx").alias("value"))
    return sections.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("sections"))
