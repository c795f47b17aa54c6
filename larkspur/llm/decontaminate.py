"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers, and names (capitalised words within a sentence; words all in capitals are words) become typed
placeholders; the rest is lower-cased words. Windows of WINDOW template tokens are hashed and joined
with the benchmark's. A window without placeholders is a hit as it is. One with placeholders counts if
its slots are consistent: along one alignment of document and item, equal values in the item stand for
equal values in the document (different ones may coincide there), so an item asked again with other
numbers is caught while a chance mix of values is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import bound
from larkspur.llm.common import Scratch, column, free_names

WINDOW = 8
#: An item is leaked if this many of its windows are found (or all it has), and this share of them or ENOUGH_WINDOWS.
LEAST_WINDOWS = 3
LEAST_SHARE = 0.2
#: A run of 20 tokens, however long the item is.
ENOUGH_WINDOWS = 13
#: Benchmark windows (some 100 bytes each) and rows of the documents (a number each) up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Marks that stand before a number, a name, a unit. Texts can't hold them, as they are removed first.
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Stands before a capitalised word that opens a sentence or text: a word, or a name where such a word opens a window.
START = "\x04"
MARKS = NUMBER + NAME + UNIT + START
#: The units that are known: fixed values.
UNITS = "%|km|cm|mm|m|kg|mg|g|lb|oz|ml|l|mph|ms|s|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|inches|dollars?|euros?|cents?|usd|eur|percent|degrees?|liters?|litres?|pounds?|kilograms?|grams?|kilometers?|kilometres?"


def marked(text: Column) -> Column:
    """Lower-cased text whose numbers, names and units carry their marks; all else is words and separators.

    Each pattern opens with a rare character, so a place where it can't match is passed at once.
    """
    s = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARKS, " " * len(MARKS))
    s = F.regexp_replace(s, r"([0-9])[.,:/](?=[0-9])", "$1d")
    s = F.regexp_replace(s, r" (?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;] )", f" {NAME}")
    s = F.regexp_replace(s, r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:d[0-9]+)*", f" {NUMBER}$0 ")
    s = F.regexp_replace(s, rf"(?i)({NUMBER}\S+\s+)(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))", f"$1{UNIT}")
    return F.lower(F.regexp_replace(s, rf"\p{{Lu}}(?=\p{{Ll}})(?<![\p{{L}}\p{{N}}{NAME}{UNIT}]\p{{Lu}})", f"{START}$0"))


def raw_tokens(text: Column) -> Column:
    """Tokens with their values behind the marks."""
    return F.array_remove(F.split(F.replace(marked(text), F.lit(f"{UNIT}%"), F.lit(f"{UNIT}pct")), rf"[^\p{{L}}\p{{N}}{MARKS}]+"), "")


def exact_tokens(raw: Column) -> Column:
    """Of raw tokens the values, without marks."""
    return F.transform(raw, lambda x: F.translate(x, MARKS, ""))


def template(raw: Column) -> Column:
    """Of raw tokens the marks alone in place of values; opening words as words."""
    return F.transform(raw, lambda x: F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(F.translate(x, START, "")))


def _is_slot(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(NUMBER, NAME, UNIT)


#: How a window is read: by its template, by its values, with its opening word as a name.
PLAIN, EXACT, OPENED = 0, 1, 2


def _hashes(tokens: Column, size: int, exact: bool = False) -> Column:
    """Hash of each window of that size; an array, from the first token on. Made of parts of doubled lengths, so a token is hashed once."""
    part, length, out, done = F.transform(tokens, lambda x: F.xxhash64(x, F.lit(exact))), 1, None, 0
    while True:
        if size & length:
            out, done = (part, length) if out is None else (_pairs(out, part, done), done + length)
        if done == size:
            return out
        part, length = _pairs(part, part, length), 2 * length


def _pairs(a: Column, b: Column, away: int) -> Column:
    """Hashes of a's numbers with those of b that stand so far on."""

    def paired(a, b):
        n = F.greatest(F.least(F.size(a), F.size(b) - away), F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(away + 1), n), lambda x, y: F.xxhash64(x, y))

    # an argument that is used twice is computed once
    return bound(a, lambda v: paired(v, v)) if a is b else bound(F.struct(a.alias("a"), b.alias("b")), lambda v: paired(v["a"], v["b"]))


def _one(tokens: Column, size: Column, most: int, exact: bool) -> Column:
    """The hash of a whole window whose size is a column."""
    return F.coalesce(*[F.when(size == n, F.get(_hashes(tokens, n, exact), F.lit(0))) for n in range(1, most + 1)])


def _opens(x: Column) -> Column:
    return F.substring(x, 1, 1) == START


def _named(tokens: Column, values: bool) -> Column:
    """A window whose opening word is read as a name."""
    first = F.concat(F.lit(NAME), F.substring(F.element_at(tokens, 1), 2, 1 << 30)) if values else F.lit(NAME)
    return F.concat(F.array(first), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))))


def _openings(raw: Column, tokens: Column, size: int) -> Column:
    """As _hashes, of the windows that open with a START word, read as a name; null for others."""
    window = lambda i: F.when(_opens(F.element_at(raw, i)), F.get(_hashes(F.concat(F.array(F.lit(NAME)), F.slice(tokens, i + 1, size - 1)), size), F.lit(0)))
    count = F.size(tokens) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), window)).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST_WINDOWS) -> DataFrame:
    """item_id, size, at, named, exact, hash, slots (the raw values of its placeholders), windows (the item's number of those with a template), total (of all). An item shorter than a window is one window.

    A first window that opens with a START word is there twice, once with that word as a name, where the item has
    no more than `least` windows; else a whole copy shows enough of the others. Windows
    of more placeholders than words, and items of under 3 tokens, are exact: the hash is that of their values.
    """
    items = benchmark.select("item_id", raw_tokens(F.col("text")).alias("r")).dropDuplicates().filter(F.size("r") > 0)
    items = items.select("item_id", "r", template(F.col("r")).alias("t"), exact_tokens(F.col("r")).alias("e"))
    items = items.withColumn("size", F.least(F.size("t"), F.lit(window)))
    rows = items.select("item_id", "size", "t", "r", "e", F.posexplode(F.sequence(F.lit(1), F.size("t") - F.col("size") + 1)).alias("at", "i"))
    cut = lambda c: F.slice(c, F.col("i"), F.col("size"))
    rows = rows.select("item_id", "size", "at", cut("t").alias("w"), cut("r").alias("v"), cut("e").alias("e"), F.explode(F.when((F.col("at") == 0) & (F.size("t") - F.col("size") < least) & _opens(F.element_at("r", 1)), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("named"))
    read = lambda c, values: F.when(F.col("named"), _named(F.col(c), values)).otherwise(F.col(c))
    rows = rows.select("item_id", "size", "at", "named", _one(read("w", False), F.col("size"), window, False).alias("hash"), _one(F.col("e"), F.col("size"), window, True).alias("value"), F.filter(read("v", True), _is_slot).alias("slots"))
    rows = rows.withColumn("exact", (2 * F.size("slots") > F.col("size")) | (F.col("size") < 3))
    rows = rows.select("item_id", "size", "at", "named", "exact", F.when(F.col("exact"), F.col("value")).otherwise(F.col("hash")).alias("hash"), F.when(F.col("exact"), F.array().cast("array<string>")).otherwise(F.col("slots")).alias("slots"))
    total = rows.groupBy("item_id").agg(F.count_distinct(F.when(~F.col("exact"), F.col("at"))).alias("windows"), F.count_distinct("at").alias("total"))
    return rows.join(total, "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, n_windows, coverage, n_changed (slots of another value).

    A row per document and item that it leaks. Windows whose opening word is read as a name, and exact
    ones, count only where the others do not suffice; an item of under 3 tokens must be the whole text. Null and empty
    texts and items hold nothing; a text of any length is read whole; equal rows count once, rows of one id and other
    texts each; a null doc_id is reported as null. More columns are left out. No documents or no items give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    out = scratch.stage(found(docs, benchmark, scratch, **options).drop("key"), "leaks")
    scratch.drop(out)
    return out


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def found(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, least: int = LEAST_WINDOWS, share: float = LEAST_SHARE, most: int = ENOUGH_WINDOWS) -> DataFrame:
    """As leaks, with key, the hash of the row that leaks. Texts are read twice and never shuffled while the rows with slots are few."""
    items = scratch.stage(item_windows(benchmark, window, least), "items")
    facts = items.groupBy("size", "exact", "named").count().collect()  # four rows per window size, at most
    near = F.broadcast if sum(r["count"] for r in facts) <= BROADCAST_ROWS else (lambda df: df)
    sizes = lambda exact, named: sorted({r["size"] for r in facts if r["exact"] == exact and named in (None, r["named"])})
    rows = docs.select(_key().alias("key"), "doc_id", raw_tokens(F.col("text")).alias("r"))
    exact = sizes(True, None)
    tokens = rows.select("key", "doc_id", "r", template(F.col("r")).alias("t"), (exact_tokens(F.col("r")) if exact else F.lit(None).cast("array<string>")).alias("e"))
    read = [(PLAIN, _hashes(F.col("t"), s)) for s in sizes(False, None)] + [(OPENED, _openings(F.col("r"), F.col("t"), s)) for s in sizes(False, True)]
    read += [(EXACT, _hashes(F.col("e"), s, True) if s >= 3 else F.when(F.size("e") == s, _hashes(F.col("e"), s, True))) for s in exact]
    if not read:
        read = [(PLAIN, F.array().cast("array<bigint>"))]
    # the outer generators keep a filter from being put below, where it would compute the arrays again
    windows = tokens.select("key", "doc_id", F.array(*[F.struct(F.lit(how).alias("how"), h.alias("h")) for how, h in read]).alias("all"))
    windows = windows.select("key", "doc_id", F.explode_outer("all").alias("x")).select("key", "doc_id", "x.how", F.posexplode_outer("x.h").alias("pos", "hash")).filter(F.col("hash").isNotNull())
    hits = windows.join(near(items), "hash").select("key", "doc_id", "pos", (F.col("how") == OPENED).alias("opened"), "item_id", "at", "size", "slots", "windows", "total", ((F.col("how") == OPENED) | F.col("named") | F.col("exact")).alias("other"))
    hits = scratch.stage(hits, "hits")
    plain = hits.filter(F.size("slots") == 0).select("key", "doc_id", "item_id", "at", "windows", "total", "other", F.lit(0).alias("changed"))
    # second look at the documents whose hits have slots: their values, along each alignment
    slotted = hits.filter(F.size("slots") > 0).distinct()
    wanted = scratch.stage(slotted.select("key").distinct(), "wanted")
    few = F.broadcast if wanted.count() <= BROADCAST_ROWS else (lambda df: df)
    values = docs.select(_key().alias("key"), "text").join(few(wanted), "key", "left_semi").dropDuplicates(["key"]).select("key", raw_tokens(F.col("text")).alias("r"))
    seen = slotted.join(values, "key").withColumn("v", F.slice("r", F.col("pos") + 1, F.col("size"))).drop("r")
    seen = seen.withColumn("own", F.filter(F.when(F.col("opened"), _named(F.col("v"), True)).otherwise(F.col("v")), _is_slot)).withColumn("shift", F.col("pos") - F.col("at"))
    seen = scratch.stage(seen.drop("v"), "seen")
    group = ["key", "item_id", "shift"]
    pairs = seen.select(*group, "other", F.explode(F.arrays_zip(F.col("slots").alias("a"), F.col("own").alias("b"))).alias("p")).groupBy(*group, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.min("other").alias("other"))
    # a value of the item has one value in the document, with and without the other readings
    values = pairs.groupBy(*group, "a").agg(F.count("*").alias("n"), F.count_if(~F.col("other")).alias("n0"), F.count_if(F.col("a") != F.col("b")).alias("c"), F.count_if((F.col("a") != F.col("b")) & ~F.col("other")).alias("c0"))
    clash = values.groupBy(*group).agg(F.max("n").alias("n"), F.max("n0").alias("n0"), F.sum("c").alias("c"), F.sum("c0").alias("c0"))
    fits = F.when(F.col("other"), F.col("n") == 1).otherwise(F.col("n0") <= 1)
    held = seen.join(clash, group).filter(fits).select("key", "doc_id", "item_id", "at", "windows", "total", "other", F.when(F.col("other"), F.col("c")).otherwise(F.col("c0")).alias("changed"))
    spots = plain.unionByName(held).groupBy("key", "doc_id", "item_id", "at").agg(F.min("other").alias("other"), F.max("windows").alias("windows"), F.max("total").alias("total"), F.max("changed").alias("c"), F.max(F.when(~F.col("other"), F.col("changed"))).alias("c0"))
    out = spots.groupBy("key", "doc_id", "item_id").agg(F.count("*").alias("n"), F.count_if(~F.col("other")).alias("n0"), F.max("windows").alias("windows"), F.max("total").alias("total"), F.max("c").alias("c"), F.max("c0").alias("c0"))
    enough = lambda n, of: (n > 0) & (n >= F.least(of, F.lit(least))) & (n >= F.least(share * of, F.lit(most)))
    first = enough(F.col("n0"), F.col("windows"))
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    out = out.filter(first | enough(F.col("n"), F.col("total")))
    return out.select("key", "doc_id", "item_id", either("n0", "n").alias("n_windows"), F.round(either("n0", "n") / either("windows", "total"), 6).alias("coverage"), either("c0", "c").cast("long").alias("n_changed"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that leak an item, as leaks finds them.

    Rows with null or empty texts stay, repeated rows stay or go together, all columns stay, whatever their names; no items
    or no documents change nothing. Texts are only shuffled where over BROADCAST_ROWS rows go.
    """
    scratch = Scratch(docs.sparkSession)
    (key,) = free_names(docs, "key")
    bad = scratch.stage(found(docs.select("doc_id", "text"), benchmark, scratch, **options).select(F.col("key").alias(key)).distinct(), "bad")
    scratch.drop(bad)
    few = F.broadcast if bad.count() <= BROADCAST_ROWS else (lambda df: df)
    return docs.withColumn(key, _key()).join(few(bad), key, "left_anti").select(*map(column, docs.columns))
