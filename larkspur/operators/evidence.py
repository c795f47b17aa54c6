"""Evidence regions against parsed elements: a grid join of boxes, and verdicts on whether chunks preserve the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import area, overlap_area
from larkspur.operators.evaluate import evidence_verdict

BOX = ["x0", "y0", "x1", "y1"]
# fixed values: an element counts if it covers this share of the evidence, or lies in it with that share of its own
OF_EVIDENCE, OF_ELEMENT = 0.3, 0.5
# fixed values: the kind of chunk that a question's channel asks for
CHANNELS = {"Table": "table", "Chart": "chart", "Figure": "image", "Pure-text (Plain-text)": "text", "Generalized-text (Layout)": "text"}
ASSETS = ("table", "chart", "image")
#: Questions x elements of a document that one task looks up, at most.
MOST_PAIRS = 2_000_000_000


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def _cells(boxes: DataFrame, cell: float, prefix: str) -> DataFrame:
    """A row for each cell of the grid that a box touches; boxes of no area touch none."""
    x0, y0, x1, y1 = box(prefix)
    at = lambda v: F.floor(v / cell)
    full = boxes.filter((x1 > x0) & (y1 > y0))
    wide = full.withColumn(f"{prefix}cx", F.explode(F.sequence(at(x0), at(x1))))
    return wide.withColumn(f"{prefix}cy", F.explode(F.sequence(at(y0), at(y1)))).withColumns({f"{prefix}cx0": at(x0), f"{prefix}cy0": at(y0)})


def grid_pairs(regions: DataFrame, elements: DataFrame, cell: float) -> DataFrame:
    """regions (doc_id, page, g-prefixed box, ...), elements (doc_id, page, box, ...) -> their columns and overlap, for pairs of one page that share an area.

    Boxes meet in the cells of a grid; a pair that shares several cells is reported in the first of them only, so nothing
    has to be made distinct. cell: about the size of a usual box, in the boxes' unit. A crowded page is as many keys as it has cells.
    """
    a, b = _cells(regions, cell, "g"), _cells(elements, cell, "").withColumnsRenamed({"doc_id": "edoc", "page": "epage"})
    same = lambda x, y: F.col(x) == F.col(y)
    met = a.join(b, same("doc_id", "edoc") & same("page", "epage") & same("gcx", "cx") & same("gcy", "cy"))
    first = (F.col("gcx") == F.greatest("gcx0", "cx0")) & (F.col("gcy") == F.greatest("gcy0", "cy0"))
    out = met.filter(first).withColumn("overlap", overlap_area(box("g"), box())).filter("overlap > 0")
    return out.drop("gcx", "gcy", "gcx0", "gcy0", "cx", "cy", "cx0", "cy0", "edoc", "epage")


def _scaled(regions: DataFrame, pages: DataFrame, scales: DataFrame) -> DataFrame:
    """regions in the elements' unit (g-prefixed box), and in_range."""
    scaled = regions.join(scales, "doc_id", "left").join(pages.select("doc_id", "page", F.lit(True).alias("parsed")).distinct(), ["doc_id", "page"], "left")
    return scaled.select("question", "region", "doc_id", "page", F.coalesce("parsed", F.lit(False)).alias("in_range"), *((F.col(c) * F.col("sx" if c[0] == "x" else "sy")).alias("g" + c) for c in BOX))


def localized(regions: DataFrame, pages: DataFrame, scales: DataFrame, elements: DataFrame, cell: float = 64.0) -> DataFrame:
    """Per region (question, region, doc_id, page, box in points): in_range (its page was parsed), hits (idx of elements that count), best (idx of the element with the greatest share, the first of equals, counting or not).

    scales (doc_id, sx, sy) take points to the elements' unit; without a scale nothing is localized.
    """
    scaled = _scaled(regions, pages, scales)
    pairs = grid_pairs(scaled.filter("in_range"), elements.select("doc_id", "page", "idx", *BOX), cell)
    of_region, of_element = F.col("overlap") / area(box("g")), F.col("overlap") / area(box())
    share = F.greatest(of_region, of_element)
    met = pairs.groupBy("question", "region").agg(
        F.collect_set(F.when((of_region >= OF_EVIDENCE) | (of_element >= OF_ELEMENT), F.col("idx"))).alias("hits"), F.max_by("idx", F.struct(share, -F.col("idx"))).alias("best")
    )
    return scaled.select("question", "region", "doc_id", "in_range").join(met, ["question", "region"], "left")


def verdicts(questions: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (question, doc_id, channels, answers), localized regions, chunks (doc_id, idx, chunk_id, kind, text: a row for each element of a chunk) -> question, verdict, n_chunks, kind_match, kind_match_strict, answer_found.

    The last three are null where they don't apply: no localized evidence, no known channel, no asset asked for.
    A question without regions has no row.
    """
    seen = found.groupBy("question").agg(F.max("in_range").alias("in_range"), F.count("best").alias("best"), F.count_if(F.size("hits") > 0).alias("hit"))
    idx = found.select("question", "doc_id", F.explode("hits").alias("idx")).distinct()
    own = idx.join(chunks, ["doc_id", "idx"]).groupBy("question").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("parts"))
    blob = _flat(F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    all_ = questions.join(seen, "question").join(own, "question", "left").withColumns({"answers": _answers(), "blob": blob})
    return _told(all_.withColumns({"localized": F.col("hit") > 0, "any": F.col("best") > 0, "said": _said()}))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _answers() -> Column:
    """Answers as they are sought, those of under two letters left out."""
    return F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), _flat), lambda a: F.length(a) >= 2)


def _said() -> Column:
    return F.exists("answers", lambda a: F.coalesce(F.contains(F.col("blob"), a), F.lit(False)))


def _told(rows: DataFrame) -> DataFrame:
    """rows (question, channels, in_range, localized, any, n_chunks, kinds, said) -> the columns of `verdicts`."""
    n = F.coalesce("n_chunks", F.lit(0))
    verdict = evidence_verdict(F.col("in_range"), F.col("localized"), F.col("any"), n)
    wanted = F.filter(F.transform(F.coalesce("channels", F.array().cast("array<string>")), lambda c: F.coalesce(*[F.when(c == k, v) for k, v in CHANNELS.items()])), lambda c: c.isNotNull())
    out = rows.withColumns({"verdict": verdict, "kept": verdict.isin("single", "split"), "wanted": wanted, "assets": F.filter(wanted, lambda c: c.isin(*ASSETS))})
    return out.select(
        "question", "verdict", n.cast("long").alias("n_chunks"),
        F.when(F.col("kept") & (F.size("wanted") > 0), F.arrays_overlap("kinds", "wanted")).alias("kind_match"),
        F.when(F.col("kept") & (F.size("assets") > 0), F.arrays_overlap("kinds", "assets")).alias("kind_match_strict"),
        F.when(F.col("kept"), F.col("said")).alias("answer_found"),
    )


def preserved(questions: DataFrame, regions: DataFrame, pages: DataFrame, scales: DataFrame, elements: DataFrame, chunks: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """The rows of `verdicts` over `localized` regions (a question stands once), without their hits, which grow with the product of a document's regions and elements.

    A document's boxes, its chunks' rows and what is asked of it meet in one task; hits live there as flags and only counts leave. Equal boxes of a page meet once,
    and questions of equal regions and answers are looked up once. A document of more than `most` questions x elements is dealt to several tasks by its questions.
    Of a question with regions in several documents the chunks and texts are brought together, as they count over all of them. Texts of one element stand in order of their plain form.
    """
    scaled = _scaled(regions, pages, scales)
    x0, y0, x1, y1 = box("g")
    part = F.when(F.col("in_range") & (x1 > x0) & (y1 > y0), F.struct("page", *box("g")))
    own = scaled.groupBy("question", "doc_id").agg(F.max("in_range").alias("in_range"), F.array_sort(F.collect_set(part)).alias("parts"))
    several = F.count("*").over(Window.partitionBy("question")) > 1
    asked = own.withColumn("several", several).join(questions.withColumn("answers", F.array_sort(F.array_distinct(_answers()))), "question")
    # as a string, since Spark's Arrow batches of nested columns take time with the square of their rows
    asked = asked.withColumn("ask", F.when(F.size("parts") > 0, F.to_json(F.struct("answers", "parts"))))
    key = ["doc_id", "ask", "several"]
    tried = asked.filter("ask is not null").select(*key).distinct()

    x0, y0, x1, y1 = box()
    boxes = elements.filter((x1 > x0) & (y1 > y0)).select(*(F.col(c).alias(c) for c in ("doc_id", "page", "idx", *BOX)))  # own columns, as chunks may be made of the same table
    rows = chunks.select("doc_id", "idx", "chunk_id", "kind", _flat(F.coalesce("text", F.lit(""))).alias("text"))
    heavy = tried.groupBy("doc_id").agg(F.count("*").alias("asks")).join(boxes.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    heavy = F.broadcast(heavy.select("doc_id", F.ceil(F.col("asks") * F.col("n") / most).cast("int").alias("slices")).filter("slices > 1"))
    dealt = lambda df: df.join(heavy, "doc_id", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    mine = tried.join(heavy, "doc_id", "left").withColumn("slice", F.pmod(F.xxhash64("ask"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    left = dealt(rows).unionByName(mine, allowMissingColumns=True)
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in left.schema)}
    schema = f"doc_id {kinds['doc_id']}, ask string, several boolean, localized boolean, any boolean, n bigint, kinds array<string>, said boolean, ids array<{kinds['chunk_id']}>, texts array<struct<idx:{kinds['idx']},text:string>>"
    met = left.groupBy("doc_id", "slice").cogroup(dealt(boxes).groupBy("doc_id", "slice")).applyInArrow(_looked_up(schema), schema)

    none = lambda kind: F.array().cast(kind)
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, none(dict(met.dtypes)[c]))))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    n = F.when(F.bool_or("several"), F.size(F.array_distinct(flat("ids")))).otherwise(F.max("n"))
    joined = asked.join(met, key, "left").groupBy("question", "channels", "answers").agg(F.bool_or("several").alias("several"), F.max("in_range").alias("in_range"), any_("localized"), any_("any"), n.alias("n_chunks"), F.array_distinct(flat("kinds")).alias("kinds"), any_("said"), F.array_sort(flat("texts")).alias("texts"))
    blob = F.array_join(F.filter(F.col("texts.text"), lambda t: t != ""), " ")
    return _told(joined.withColumn("blob", blob).withColumn("said", F.when(F.col("several"), _said()).otherwise(F.col("said"))))


def _looked_up(schema: str):
    """Of a document's chunk rows and questions (one table, apart by ask) and boxes the questions' answers."""
    import json

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def coded(column):
            """Codes (-1: null) and their values."""
            both = column.combine_chunks().dictionary_encode()
            both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
            return pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False), both.dictionary

        asks = left.filter(pc.is_valid(left["ask"])).select(["doc_id", "ask", "several"]).to_pylist()
        if not asks:
            return target.empty_table()
        rows = left.filter(pc.and_(pc.is_null(left["ask"]), pc.is_valid(left["idx"]))).select(["idx", "chunk_id", "kind", "text"]).sort_by([("idx", "ascending"), ("text", "ascending")])
        boxes = right.filter(pc.and_(pc.is_valid(right["idx"]), pc.is_valid(right["page"])))
        (chunk, chunk_names), (kind, kind_names), (text, texts) = (coded(rows[c]) for c in ("chunk_id", "kind", "text"))
        texts = texts.to_pylist()
        page, page_names = coded(boxes["page"])
        page_of = {p: i for i, p in enumerate(page_names.to_pylist())}
        # equal boxes of a page are one, and each has the rows of chunks that hold its elements
        spots, spot = np.unique(np.column_stack([page.astype(float), *(boxes[c].to_numpy() for c in BOX)]), axis=0, return_inverse=True)
        known, _ = coded(pa.chunked_array([*rows["idx"].chunks, *boxes["idx"].chunks], type=rows["idx"].type))
        of_row, of_box = known[: len(rows)], known[len(rows) :]
        order = np.argsort(of_row, kind="stable")
        low, high = (np.searchsorted(of_row[order], of_box, side) for side in ("left", "right"))
        times = high - low
        pair_spot = np.repeat(spot.ravel(), times)
        pair_row = order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        bounds = np.searchsorted(spots[:, 0], np.arange(len(page_of) + 1)) if len(spots) else np.zeros(len(page_of) + 1, int)

        met: dict[tuple, tuple] = {}

        def region(p):
            """The boxes that count, and whether any shares an area."""
            name = (p["page"], *(float(p["g" + c]) for c in BOX))
            if name not in met:
                k, (a0, b0, a1, b1) = page_of.get(name[0]), name[1:]
                low, high = (bounds[k], bounds[k + 1]) if k is not None else (0, 0)
                _, x0, y0, x1, y1 = spots[low:high].T
                shared = np.maximum(0.0, np.minimum(a1, x1) - np.maximum(a0, x0)) * np.maximum(0.0, np.minimum(b1, y1) - np.maximum(b0, y0))
                low, (x0, y0, x1, y1), shared = low + np.flatnonzero(shared > 0), spots[low:high, 1:][shared > 0].T, shared[shared > 0]
                counts = (shared / ((a1 - a0) * (b1 - b0)) >= OF_EVIDENCE) | (shared / ((x1 - x0) * (y1 - y0)) >= OF_ELEMENT)
                met[name] = low[counts], len(low) > 0
            return met[name]

        def present(codes, n):
            """Which of n codes are there."""
            there = np.zeros(n + 1, bool)
            there[codes] = True  # the last place is that of nulls
            return np.flatnonzero(there[:n])

        sought: dict[str, np.ndarray] = {}
        out = []
        for ask in asks:
            own = json.loads(ask["ask"])
            found, answers = [region(p) for p in own["parts"]], own["answers"]
            hit = np.zeros(len(spots), bool)
            for spots_met, _ in found:
                hit[spots_met] = True
            held = np.zeros(len(rows), bool)
            held[pair_row[hit[pair_spot]]] = True
            held = np.flatnonzero(held)
            told = present(text[held], len(texts))
            for a in answers:
                if a not in sought:
                    sought[a] = np.array([a in t for t in texts], bool)
            said = any(sought[a][told].any() for a in answers)
            across = [a for a in answers if " " in a]
            if not said and across and not ask["several"]:  # an answer may go on from one text to the next
                blob = " ".join([t for i in text[held] if (t := texts[i])])
                said = any(a in blob for a in across)
            chunks = present(chunk[held], len(chunk_names))
            ids = chunk_names.take(pa.array(chunks)).to_pylist() if ask["several"] else []
            parts = [{"idx": i, "text": texts[t]} for i, t in zip(rows["idx"].take(pa.array(held)).to_pylist(), text[held], strict=True)] if ask["several"] else []
            out.append(ask | {"localized": bool(hit.any()), "any": any(b for _, b in found), "n": len(chunks), "kinds": kind_names.take(pa.array(present(kind[held], len(kind_names)))).to_pylist(), "said": bool(said), "ids": ids, "texts": parts})
        return pa.Table.from_pylist(out, schema=target)

    return run
