"""Small-to-big: from a hit's section to a block of text within a token budget."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby, zip_longest

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import capped
from larkspur.functions.text import per_token as text_per_token
from larkspur.operators.chunking import BUDGETS, DEFAULT_BUDGET, per_token
from larkspur.operators.folds import in_slices
from larkspur.operators.structure import NOISE, norm_key

BLOCK = "hit_no int, doc_id {id}, text string, resolved_section string, n_tokens int, climbed int, anchor_start int, anchor_end int, windowed boolean, note string"


#: Notes of a block that is no whole section.
NO_SECTION_PAGE, NO_SECTION, TOO_LARGE, OVERSHOT, TOO_SMALL = "no section -> page window", "no section -> doc window", "section>max -> window", "climb overshoot -> sibling window within parent", "top-too-small -> doc window"


def capped_length(lines: list[str], most: float, ratio: float) -> int:
    """How many characters functions.text.capped keeps of these lines."""
    room, whole = most * ratio, sum(map(len, lines)) + len(lines) - 1
    if whole <= room:
        return whole
    kept = max(1, bisect_right(list(accumulate(map(len, lines))), room))
    head = "\n".join(lines[:kept])
    if len(head) <= room:
        return len(head)
    end = head[: int(room)].rfind(" ") if ratio >= 2 else -1
    return end if end > 0 else int(room)


class Document:
    """A document's elements by position and its sections by heading. What a stretch of elements amounts to follows from sums of their lengths."""

    def __init__(self, doc_id, texts: list[str], counts: list[bool], pages: list[int], sections: dict[int, dict], ratio: float, limits: tuple[int, int, int]):
        self.doc_id, self.texts, self.counts, self.pages, self.sections, self.ratio, self.limits = doc_id, texts, counts, pages, sections, ratio, limits
        self.admit([])

    def admit(self, admitted: list[bool]) -> None:
        """Only those elements may be gathered; an empty list admits all."""
        self.lines = [t.strip() if c and ok else "" for t, c, ok in zip(self.texts, self.counts, admitted or [True] * len(self.texts), strict=True)]
        # a blank element still costs its place when a window grows over it
        self.growth = [(len(t) + 1) / self.ratio if c and ok else 0.0 for t, c, ok in zip(self.texts, self.counts, admitted or [True] * len(self.texts), strict=True)]
        self.sums = [0, *accumulate(len(x) + 1 if x else 0 for x in self.lines)]

    def size(self, a: int, b: int) -> float:
        """Tokens of the elements from a to b - 1, joined by line ends."""
        a, b = max(0, a), min(b, len(self.texts))
        return max(0, self.sums[max(a, b)] - self.sums[a] - 1) / self.ratio

    def _result(self, section: str, a: int, b: int, climbed: int, note: str, windowed: bool) -> dict:
        """The text is whole here; big_blocks cuts it to the budget."""
        lines = [x for x in self.lines[max(0, a) : max(0, b)] if x]
        kept = capped_length("\n".join(lines).split("\n"), self.limits[2], self.ratio)
        return {"text": "\n".join(lines), "resolved_section": section, "n_tokens": round(kept / self.ratio), "climbed": climbed, "anchor_start": a, "anchor_end": b, "windowed": windowed, "note": note}

    def window(self, hits: list[int], name: str, start: int, end: int, note: str) -> dict:
        """From the hits outwards, to the right and left in turn, within the bounds, up to the target."""
        low, high = max(min(hits, default=start), start), min(max(hits, default=start), end - 1)
        outwards = [i for pair in zip_longest(range(high + 1, end), range(low - 1, start - 1, -1)) for i in pair if i is not None]
        sizes = list(accumulate((self.growth[i] for i in outwards), initial=self.size(low, high + 1)))
        taken = outwards[: bisect_left(sizes, self.limits[1])]
        return self._result(f"{name}#window", min([low, *taken]), max([high, *taken]) + 1, 0, note, True)

    def above(self, head: int) -> list[int]:
        """A section and what it lies in, from within; a circle ends where it closes."""
        chain: dict[int, None] = {}
        at: int | None = head
        while at in self.sections and at not in chain:
            chain[at] = None
            at = self.sections[at]["parent"]
        return list(chain)

    def big_block(self, hits: list[int], head: int | None, page_start: int, page_end: int) -> dict:
        """The innermost section around the hits that reaches the target, or the outermost; a window where there is none, or that is too large or too small."""
        least, target, most = self.limits
        whole = (f"{self.doc_id}::root", 0, len(self.texts))
        chain = self.above(head) if head is not None else []
        if not chain:
            own = [i for i, p in enumerate(self.pages) if page_start <= p <= page_end]
            return self.window(hits, f"{self.doc_id}::p{page_start}", own[0], own[-1] + 1, NO_SECTION_PAGE) if own else self.window(hits, *whole, NO_SECTION)
        spans = [(self.sections[h]["start"], self.sections[h]["end"]) for h in chain]
        sizes = [self.size(*s) for s in spans]
        climbed = next((n for n, s in enumerate(sizes) if s >= target or s > most), len(chain) - 1)
        name = f"{self.doc_id}::s{chain[climbed]}"
        if sizes[climbed] > most:
            return self.window(hits, name, *spans[climbed], OVERSHOT if climbed else TOO_LARGE)
        block = self._result(name, *spans[climbed], climbed, "", False)
        return self.window(hits, *whole, TOO_SMALL) if sizes[climbed] < least else block


def big_blocks(hits: DataFrame, elements: DataFrame, sections: DataFrame, banners: DataFrame | None = None, limits: tuple[int, int, int] | None = None) -> DataFrame:
    """hits (hit_no, doc_id, source_indices, sec_head, page_start, page_end) -> BLOCK.

    limits (least, target, most) replace the document type's, banners are those of `structure.banner_keys`. Only documents with hits are gathered, each once: elements,
    sections and hits meet in one group per document, hits of one acl one after another. Where elements have acl columns and hits too, only elements of the hit's acl are gathered.
    """
    gated = "acl_key" in elements.columns and "acl_key" in hits.columns
    wanted = hits.select("doc_id").distinct()
    noise = F.col("kind").isin(NOISE)
    rows = elements.join(wanted, "doc_id", "left_semi")
    if banners is not None:
        rows = rows.join(banners.select("doc_id", "banner_keys"), "doc_id", "left")
        noise = noise | F.coalesce(F.array_contains("banner_keys", norm_key()), F.lit(False))
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).when(F.size("list_items") > 0, F.array_join("list_items", " ")).otherwise(F.coalesce("caption", F.lit("")))
    key = F.col("acl_key") if gated else F.lit(None).cast("string")
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", text.alias("text"), (~noise).alias("counts"), "page", key.alias("acl")))).alias("els"), F.first("lang").alias("lang"), F.first("doc_type").alias("doc_type"))
    tree = sections.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("idx", "end_idx", "parent_idx")).alias("tree"))
    asked = hits.groupBy("doc_id").agg(F.collect_list(F.struct("hit_no", "source_indices", "sec_head", "page_start", "page_end", key.alias("acl"))).alias("asked"))
    joined = asked.join(own, "doc_id").join(tree, "doc_id", "left")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                sec = {s["idx"]: {"start": s["idx"], "end": s["end_idx"], "parent": s["parent_idx"]} for s in (r["tree"] if r["tree"] is not None else [])}
                els = list(r["els"])
                if [e["idx"] for e in els] != list(range(len(els))):
                    raise ValueError(f"elements of {r['doc_id']} are not dense")
                own = limits or BUDGETS.get(r["doc_type"], DEFAULT_BUDGET)
                doc = Document(r["doc_id"], [e["text"] or "" for e in els], [e["counts"] for e in els], [e["page"] for e in els], sec, per_token(r["lang"]), own)
                for acl, same in groupby(sorted(r["asked"], key=lambda h: h["acl"] or ""), key=lambda h: h["acl"]):
                    if gated:  # an element of no known acl is closed
                        doc.admit([e["acl"] is not None and e["acl"] == acl for e in els])
                    for h in same:
                        head = h["sec_head"]
                        block = doc.big_block(list(h["source_indices"]), None if head is None else int(head), h["page_start"], h["page_end"])
                        out.append((h["hit_no"], r["doc_id"], *(block[c] for c in names), own[2], r["lang"]))
            yield pd.DataFrame(out, columns=["hit_no", "doc_id", *names, "most", "lang"])

    names = ["text", "resolved_section", "n_tokens", "climbed", "anchor_start", "anchor_end", "windowed", "note"]
    blocks = in_slices(joined, run, BLOCK.format(id=elements.schema["doc_id"].dataType.simpleString()) + ", most double, lang string")
    return blocks.withColumn("text", capped(F.col("text"), F.col("most"), text_per_token(F.col("lang")))).drop("most", "lang")


def fold_by_section(hits: DataFrame) -> DataFrame:
    """The first hit of each section; charts and tables are never folded, images are."""
    exempt = F.col("kind").isin("chart", "table")
    key = F.when(exempt, F.concat(F.lit("hit:"), F.col("rank"))).otherwise(F.coalesce(F.concat(F.lit("sec:"), F.col("section_id")), F.concat(F.lit("hit:"), F.col("rank"))))
    w = Window.partitionBy("doc_id", key).orderBy("rank")
    return hits.withColumn("fold", F.row_number().over(w)).filter("fold = 1").drop("fold")


def dedup_blocks(rows: DataFrame) -> DataFrame:
    """Of the rows whose blocks share an anchor or a resolved section only the first keeps its context."""
    anchor = F.struct("doc_id", "anchor_start", "anchor_end")
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    again = (first(anchor) > 1) | (first(F.struct("doc_id", "resolved_section")) > 1)
    return rows.withColumn("deduped", again & F.col("context").isNotNull()).withColumn("context", F.when(~F.col("deduped"), F.col("context")))


def context_status(concise, has_sidecar, acl_ok, deduped, is_asset, prose, windowed, climbed):
    """The status's order: concise, degraded, ACL, deduped, asset, window, climbed, whole section."""
    return (
        F.when(concise, "concise")
        .when(~has_sidecar, "single_chunk_degraded")
        .when(~acl_ok, "single_chunk_acl")
        .when(deduped, "deduped")
        .when(is_asset & ~prose, "asset_no_prose")
        .when(windowed, "section_window")
        .when(climbed > 0, F.concat(F.lit("climbed_"), climbed))
        .otherwise("full_section")
    )
