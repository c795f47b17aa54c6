"""Retrieval quality, chunk quality, request statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import area, floor_rank, nearest_rank, overlap_area


def recall_mrr(rows: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """rows with rank (null: not found) -> n, mrr and recall at k."""
    hit = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(hit), 6).alias("recall"))


def verdict_and(first: Column, second: Column) -> Column:
    """Both passes; null where one is missing."""
    return F.when(first.isNotNull() & second.isNotNull(), first & second)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(1.0))


def first_divergence(a: Column, b: Column) -> Column:
    """The first rank, from 1, at which two rankings differ; 0 if they don't."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.array_position(same, False), F.lit(0)).cast("int")


def pick_evenly(rows: DataFrame, k: int, by: str, order: list[str]) -> DataFrame:
    """k rows of each group at evenly spaced places round(i * (n - 1) / (k - 1)); all of a group of at most k."""
    w = Window.partitionBy(by)
    rows = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count("*").over(w))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("size") - 1) / F.lit(max(1, k - 1)), 0).cast("int")))
    return rows.filter((F.col("size") <= k) | F.array_contains(places, F.col("pos").cast("int")))


def deal_equals(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each key gets when each goes to the least loaded one; of equal loads the first key's turn comes first."""
    if size <= 0:  # they change no load: all go to the first of the least loaded
        first = loads.index(min(loads))
        return [count if k == first else 0 for k in range(len(loads))]
    # loads of level or less take items; below a level each key takes a known number
    taken = lambda level: [max(0, (level - load) // size + 1) if load <= level else 0 for load in loads]
    low, high = min(loads) - 1, max(loads) + size * (count + 1)
    while low < high:  # the highest level at which no more than count are taken
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(taken(middle)) <= count else (low, middle - 1)
    out = taken(low)
    rest = count - sum(out)
    order = sorted(range(len(loads)), key=lambda k: (loads[k] + out[k] * size, k))
    for k in order[:rest]:
        out[k] += 1
    return out


def assign_keys(items: DataFrame, keys: int = 3) -> DataFrame:
    """item, size (whole numbers) -> key: the largest first, each to the least loaded key.

    Items of one size can stand for each other, so placement runs over (size, count): the driver holds a pair for each distinct size, such as
    a number of pages, never the items. Members of a size are dealt in order of item, a key's share after the other's.
    """
    spark, kind = items.sparkSession, items.schema["item"].dataType
    sized = items.select("item", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    loads, shares = [0] * keys, []
    for r in sorted(sized.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        own = deal_equals(loads, r["size"], r["count"])
        loads = [load + n * r["size"] for load, n in zip(loads, own, strict=True)]
        ends = [sum(own[: k + 1]) for k in range(keys)]
        shares.append((r["size"], ends))
    dealt = spark.createDataFrame(shares, "size long, ends array<long>")
    ranked = by_rank(sized, "size", "item")
    key = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    return ranked.join(F.broadcast(dealt), "size").select(F.col("item").cast(kind).alias("item"), key.cast("int").alias("key"))


def by_rank(rows: DataFrame, by: str, order: str, salts: int = 64) -> DataFrame:
    """rows with rank, from 1, within `by`, in the order of hashed parts and of `order` within each: a group is as many windows as salts, whose counts give where each starts."""
    part = rows.withColumn("part", F.pmod(F.xxhash64(order), F.lit(salts)))
    counts = part.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = counts.select(by, "part", (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "part").orderBy(order))
    return part.withColumn("own", own).join(before, [by, "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "part")


def evidence_verdict(in_range: Column, localized: Column, any_overlap: Column, n_chunks: Column) -> Column:
    return F.when(~in_range, "out_of_range").when(~localized & any_overlap, "unlocalized_threshold").when(~localized, "unlocalized_zero").when(n_chunks == 0, "missing").when(n_chunks == 1, "single").otherwise("split")


def request_stats(log: DataFrame, last: int = 1000, salts: int = 64) -> DataFrame:
    """route, ts, id, ms, is_error -> n, errors (all), p50, p95, max over the last requests; both percentile definitions.

    A route's last requests are found among the last of each of its salts, so no task sorts a whole route.
    """
    recent = lambda df, *by: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("rn") <= last).drop("rn")
    salted = log.select("route", "ts", "id", "ms", F.pmod(F.xxhash64("id", "ts"), F.lit(salts)).alias("salt"))
    held = recent(recent(salted, "route", "salt").drop("salt"), "route").groupBy("route").agg(F.sort_array(F.collect_list("ms")).alias("v"))
    out = log.groupBy("route").agg(F.count("*").alias("n"), F.sum(F.col("is_error").cast("bigint")).alias("errors")).join(held, "route")
    return out.select("route", "n", "errors", nearest_rank(F.col("v"), 50).alias("p50"), nearest_rank(F.col("v"), 95).alias("p95"), floor_rank(F.col("v"), 95).alias("p95_floor"), F.element_at("v", -1).alias("max_ms"))


def numbered(rows: DataFrame, order: str, by: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """rows and no, from 0 in the order of a whole-number column, within `by`. Ranges of `width` values are numbered by themselves; only their counts meet in one place."""
    by = by or []
    ranged = rows.withColumn("range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(*by, "range").agg(F.count("*").alias("n"))
    before = counts.select(*by, "range", (F.sum("n").over(Window.partitionBy(*by).orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(*by, "range").orderBy(order)) - 1
    return ranged.withColumn("own", own).join(before, [*by, "range"]).withColumn("no", F.col("before") + F.col("own")).drop("own", "before", "range")


def strategy_comparison(rows: DataFrame) -> DataFrame:
    """rows (strategy, is_text, verdict) -> per strategy and scope (all, text_only): localized n, excluded n and the shares of single, split and missing."""
    scopes = F.array(F.lit("all"), F.when(F.col("is_text"), "text_only"))
    scoped = rows.withColumn("scope", F.explode(F.filter(scopes, lambda s: s.isNotNull())))
    base = F.col("verdict").isin("single", "split", "missing")
    share = lambda v: F.round(100.0 * F.count_if(F.col("verdict") == v) / F.nullif(F.count_if(base), F.lit(0)), 1)
    return scoped.groupBy("strategy", "scope").agg(F.count_if(base).alias("localized"), F.count_if(~base).alias("excluded"), *[share(v).alias(f"{v}_pct") for v in ("single", "split", "missing")])


def chunk_of_element(chunks: DataFrame) -> DataFrame:
    """doc_id, idx, chunk_id: of the chunks that hold an element the last."""
    return chunks.select("doc_id", "chunk_no", "chunk_id", F.explode("source_indices").alias("idx")).groupBy("doc_id", "idx").agg(F.max_by("chunk_id", "chunk_no").alias("chunk_id"))


def equivalence_gate(cosines: DataFrame, least: float = 0.999, mean: float = 0.9999) -> DataFrame:
    """cosines (grp, cos) -> lowest and mean, and whether both meet their thresholds."""
    out = cosines.groupBy("grp").agg(F.round(F.min("cos"), 6).alias("low"), F.round(F.avg("cos"), 6).alias("mean"))
    return out.withColumn("passed", (F.col("low") >= least) & (F.col("mean") >= mean))


def throughput(log: DataFrame) -> DataFrame:
    """route, ts, is_error -> n, errors, requests per second between the first and the last."""
    out = log.groupBy("route").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return out.select("route", "n", "errors", F.round(F.col("n") * 1e6 / F.nullif(F.col("us"), F.lit(0)), 6).alias("per_second"))


def upload_batches(rows: DataFrame, most: int = 200) -> DataFrame:
    """api_key, language, doc_id -> api_key, language, batch, docs: the documents that go up together, at most so many, in order."""
    no = numbered(rows, "doc_id", ["api_key", "language"])
    return no.groupBy("api_key", "language", F.floor(F.col("no") / most).alias("batch")).agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


def upload_outcome(batches: DataFrame) -> DataFrame:
    """api_key, status -> how many batches were ok, failed, and ran out of time."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return batches.groupBy("api_key").agg(n("ok"), n("failed"), n("timeout"))


def best_rank(ranked: DataFrame, golden: DataFrame, by: str) -> DataFrame:
    """ranked (by, id, rank), golden (by, id) -> the smallest rank, from 1, of a golden id; null where none was found."""
    found = golden.join(ranked, [by, "id"], "left").groupBy(by).agg(F.min("rank").alias("rank"))
    return found


def covers(golden: Column, found: Column) -> Column:
    """Whether all golden ids were found; false for none."""
    return (F.size(golden) > 0) & (F.size(F.array_except(golden, found)) == 0)


def first_of_legs(legs: list[DataFrame], key: str, most: int | None = None) -> DataFrame:
    """Lists (key, rank) one after another, each key where it comes first, cut to `most`; position counts from 1. The lists are short (top hits)."""
    rows = None
    for n, leg in enumerate(legs):
        own = leg.select(key, "rank").withColumn("leg", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy(key).agg(F.min(F.struct("leg", "rank")).alias("at")).select(key, "at.leg", "at.rank")
    out = first.orderBy("leg", "rank", key) if most is None else first.orderBy("leg", "rank", key).limit(most)
    return out.withColumn("position", F.row_number().over(Window.orderBy("leg", "rank", key)))


def document_scale(pairs: DataFrame, least: int = 4) -> DataFrame:
    """pairs (doc_id, a, b) of matching coordinates -> doc_id, scale: the median of b / a; null with fewer than `least`."""
    ratio = F.when(F.col("a") > 0, F.col("b") / F.col("a"))
    return pairs.groupBy("doc_id").agg(F.count(ratio).alias("n"), F.median(ratio).alias("scale")).withColumn("scale", F.when(F.col("n") >= least, F.col("scale")))


def held_elements(elements: DataFrame, chunks: DataFrame, least: int = 20, key: int = 60) -> DataFrame:
    """elements (doc_id, idx, text), chunks (doc_id, chunk_id, text) -> doc_id, idx, n: how many chunks of the document hold the element's first
    letters (white space aside); elements under `least` letters are left out.

    Of a chunk every half `least` letters are a gram; of an element the grams from each of its first places. Where a chunk holds the
    element, one of these meets one of those, so only such places are compared. A chunk is cut in one pass, and of its grams only those that its document's
    elements ask for leave the row, with the letters around them.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    gram = least // 2
    own = elements.select("doc_id", "idx", bare(F.col("text")).alias("b")).filter(F.length("b") >= least).select("doc_id", "idx", F.substring("b", 1, key).alias("k"))
    asked = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(gram - 1)))).withColumn("g", F.substr("k", F.col("o") + 1, F.lit(gram)))
    cut = F.regexp_extract_all(bare(F.col("text")), F.lit(f"(?s).{{1,{gram}}}"), F.lit(0))
    met = chunks.select("doc_id", "chunk_id", cut.alias("grams")).join(asked.groupBy("doc_id").agg(F.collect_set("g").alias("sought")), "doc_id")
    met = met.withColumn("common", F.array_intersect("grams", "sought")).filter(F.size("common") > 0).drop("sought")
    # the gram before, and as many from it on as an element's letters reach
    around = lambda i: F.array_join(F.slice("grams", F.greatest(i, F.lit(1)), -(-(key + gram) // gram)), "")
    places = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("common", g), i)), lambda i: i.isNotNull())
    spots = met.withColumn("i", F.explode(places)).select("doc_id", "chunk_id", F.element_at("grams", F.col("i") + 1).alias("g"), around(F.col("i")).alias("t"), F.when(F.col("i") > 0, gram).otherwise(0).alias("before"))
    start = F.col("before") - F.col("o") + 1
    found = asked.join(spots, ["doc_id", "g"]).filter((start >= 1) & (F.substr("t", start, F.length("k")) == F.col("k"))).groupBy("doc_id", "idx").agg(F.count_distinct("chunk_id").alias("n"))
    return own.select("doc_id", "idx").join(found, ["doc_id", "idx"], "left").na.fill(0, ["n"])


def overlaps(regions: DataFrame, boxes: DataFrame, page: list[str], key: str, least: float, share: float = 0.3) -> DataFrame:
    """regions (key, page columns, a0, b0, a1, b1), boxes (page columns, x0, y0, x1, y1) -> key, n, total: the boxes that cover this share of a region, or `least` of area, and the area they cover.

    Equal boxes of a page are one with its number, equal regions ask once, so the pairs are those of different boxes. Regions of one key are one row.
    """
    one, two = ["x0", "y0", "x1", "y1"], ["a0", "b0", "a1", "b1"]
    own = boxes.groupBy(*page, *one).agg(F.count("*").alias("n"))
    covered, whole = overlap_area(tuple(map(F.col, one)), tuple(map(F.col, two))), area(tuple(map(F.col, two)))
    met = own.join(regions.select(*page, *two).distinct(), page).withColumn("a", covered).filter((F.col("a") >= share * whole) | (F.col("a") >= least))
    sums = met.groupBy(*page, *two).agg(F.sum("n").alias("n"), F.sum(F.col("a") * F.col("n")).alias("total"))
    return regions.join(sums, [*page, *two]).groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


def first_of_each(rows: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def gold_units(chunks: DataFrame, single: int = 4, intra: int = 3, docs: int = 2, cross: int = 3) -> DataFrame:
    """chunks (doc_id, doc_type, chunk_no, ...) -> doc_id, chunk_no, unit: which chunks a question may be made of.

    single: evenly spaced chunks of each document; intra: the first of documents that have at least `intra`; cross: the first `cross` of the first `docs` documents of each type.
    """
    rows = chunks.select("doc_id", "doc_type", "chunk_no")
    one = pick_evenly(rows, single, "doc_id", ["chunk_no"]).select("doc_id", "chunk_no", F.lit("single").alias("unit"))
    several = rows.withColumn("size", F.count("*").over(Window.partitionBy("doc_id"))).filter(F.col("size") >= intra)
    within = first_of_each(several, intra, "doc_id", ["chunk_no"]).select("doc_id", "chunk_no", F.lit("intra").alias("unit"))
    chosen = first_of_each(rows.select("doc_id", "doc_type").distinct(), docs, "doc_type", ["doc_id"]).select("doc_id")
    across = first_of_each(rows.join(chosen, "doc_id", "left_semi"), cross, "doc_id", ["chunk_no"]).select("doc_id", "chunk_no", F.lit("cross").alias("unit"))
    return one.unionByName(within).unionByName(across)


def table_questions(tables: DataFrame, per_doc: int = 4, least: int = 120, most: int = 16) -> DataFrame:
    """tables (doc_id, chunk_no, body, answer): evenly spaced ones of each document whose body is long enough and holds a number of the answer, `most` in all."""
    from larkspur.operators.serving import answer_grounded

    fit = pick_evenly(tables.filter(F.length("body") >= least), per_doc, "doc_id", ["chunk_no"]).drop("pos", "size")
    return fit.filter(answer_grounded(F.col("answer"), F.col("body"))).orderBy("doc_id", "chunk_no").limit(most)
