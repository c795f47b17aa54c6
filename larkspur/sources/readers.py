"""Readers: parsed block lists, office files, manifests, identities."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string,text_level:int,page_idx:int,bbox:array<double>,list_items:array<string>,table_caption:string,table_footnote:string,table_body:string,image_caption:string,image_footnote:string,chart_caption:string,chart_footnote:string,img_path:string,content:string,sub_type:string>>"
#: Number formats that show dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
MANIFEST = "doc_id string, doc_type string, dataset string, domain string, language string, page_count int, eff_pages int, page_ranges string, layout_tags string, api_key string, corpus_path string, src_path string"
ELEMENT = "doc_id string, idx int, kind string, text string, text_level int, page int, bbox array<double>, list_items array<string>, caption string, footnote string, table_body string, asset_content string, sub_type string, merge_prev boolean, image_path string"


def elements_from_json(rows: DataFrame) -> DataFrame:
    """rows (doc_id, json): an array of typed blocks -> ELEMENT, idx the block's place."""
    blocks = rows.select("doc_id", F.posexplode(F.from_json("json", BLOCKS)).alias("idx", "b"))
    # a caption is a text or a list of texts, which from_json gives as its JSON
    one = lambda c: F.coalesce(F.array_join(F.from_json(F.when(c.startswith("["), c), "array<string>"), " "), c)
    said = lambda c: F.when(c.isNotNull() & ~c.isin("", "[]"), one(c))
    joined = lambda *names: F.coalesce(*[said(F.col(f"b.{n}")) for n in names])
    picture = F.col("b.type").isin("image", "chart")
    return blocks.select(
        "doc_id", "idx", F.coalesce("b.type", F.lit("text")).alias("kind"), "b.text", "b.text_level", F.coalesce("b.page_idx", F.lit(0)).alias("page"), "b.bbox", "b.list_items",
        joined("table_caption", "image_caption", "chart_caption").alias("caption"), joined("table_footnote", "image_footnote", "chart_footnote").alias("footnote"), "b.table_body", F.when(picture, F.col("b.content")).alias("asset_content"), "b.sub_type", F.lit(False).alias("merge_prev"), F.col("b.img_path").alias("image_path"),
    )


def read_parsed(spark: SparkSession, folder: str, only: str | None = None) -> DataFrame:
    """Elements of all *content_list.json below the folder but those of version 2; doc_id is the file's folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*content_list.json").text(folder)
    files = files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("doc_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("json")).filter(~F.col("name").contains("_v2"))
    first = files.groupBy("doc_id").agg(F.min_by("json", "name").alias("json"))
    return elements_from_json(first if only is None else first.filter(F.col("doc_id").startswith(only)))


LAYOUT = "struct<pdf_info:array<struct<page_idx:int,para_blocks:array<struct<merge_prev:boolean,bbox:array<double>,lines:array<struct<spans:array<struct<content:string>>>>>>>>>"


def layout_from_json(rows: DataFrame) -> DataFrame:
    """rows (doc_id, json of a layout) -> doc_id, page, pos, text (spans joined by a space), bbox, merge_prev: what merge_flags and document_scale compare elements with."""
    pages = rows.select("doc_id", F.explode(F.from_json("json", LAYOUT)["pdf_info"]).alias("p")).select("doc_id", F.coalesce("p.page_idx", F.lit(0)).alias("page"), F.posexplode("p.para_blocks").alias("pos", "b"))
    spans = F.flatten(F.transform(F.filter("b.lines", lambda n: n["spans"].isNotNull()), lambda n: n["spans"]))
    return pages.select("doc_id", "page", "pos", F.coalesce(F.array_join(F.transform(spans, lambda s: F.coalesce(s["content"], F.lit(""))), " "), F.lit("")).alias("text"), "b.bbox", F.coalesce("b.merge_prev", F.lit(False)).alias("merge_prev"))


def read_layout(spark: SparkSession, folder: str) -> DataFrame:
    """layout_from_json of all layout.json below the folder; doc_id is the file's folder, and of several layouts of a document the first counts."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "layout.json").text(folder)
    files = files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("doc_id"), F.col("_metadata.file_path").alias("name"), F.col("value").alias("json"))
    return layout_from_json(files.groupBy("doc_id").agg(F.min_by("json", "name").alias("json")))


def doc_type_of(doc_id):
    """The part before the first double underscore, else unknown."""
    return F.when(doc_id.contains("__"), F.substring_index(doc_id, "__", 1)).otherwise("unknown")


def merge_flags(elements: DataFrame, layout: DataFrame) -> DataFrame:
    """merge_prev from layout (doc_id, page, pos, text, merge_prev): of a page's blocks the first whose 24-character key starts with the element's first 12, or the other way round; an element's key under 6 never matches. Only texts and lists go on over a page."""
    key = lambda c: F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", ""), 1, 24)
    a = elements.filter(F.col("kind").isin("text", "list")).select("doc_id", "idx", "page", key(F.col("text")).alias("k")).filter(F.length("k") >= 6)
    b = layout.select("doc_id", "page", "pos", key(F.col("text")).alias("m"), F.col("merge_prev").alias("flag")).filter(F.length("m") > 0)
    near = F.col("k").startswith(F.substring("m", 1, 12)) | F.col("m").startswith(F.substring("k", 1, 12))
    found = a.join(b, ["doc_id", "page"]).filter(near).groupBy("doc_id", "idx").agg(F.min_by("flag", "pos").alias("flag"))
    return elements.join(found, ["doc_id", "idx"], "left").withColumn("merge_prev", F.coalesce("flag", F.lit(False))).drop("flag")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST, multiLine=True, escape='"')


def annotated(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """manifest rows whose source file's name, without its folder, is an annotation's doc_name."""
    return manifest.withColumn("doc_name", F.element_at(F.split("src_path", "/"), -1)).join(annotations, "doc_name")


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """key, name, tenant, principals, admin; keys of 16 characters at least and single names without a bar, else an error."""
    rows = spark.read.json(path, multiLine=True, schema="keys array<struct<key:string,name:string,tenant:string,principals:array<string>,admin:boolean>>").select(F.explode("keys").alias("k")).select("k.*")
    bad = rows.filter((F.length(F.coalesce("key", F.lit(""))) < 16) | F.coalesce("name", F.lit("")).rlike(r"^$|\|"))
    twice = rows.groupBy("name").count().filter("count > 1")
    if bad.limit(1).count() or twice.limit(1).count():
        raise ValueError("identities need keys of 16 characters and single names without a bar")
    return rows.withColumn("admin", F.coalesce("admin", F.lit(False)))


def a1_range(ref: str) -> tuple[int, int, int, int]:
    """A reference such as B2:D5 as 0-based (row, column, last row, last column), corners in either order."""
    cells = []
    for part in ref.replace("$", "").split(":"):
        letters, digits = re.fullmatch(r"([A-Za-z]+)(\d+)", part).groups()
        n = 0
        for c in letters.upper():
            n = n * 26 + ord(c) - 64
        cells.append((int(digits) - 1, n - 1))
    (r1, c1), (r2, c2) = cells[0], cells[-1]
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _texts(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _tag(x) == name)


def _workbook(data: bytes):
    """(sheet's name, its XML tree), shared strings, and the styles that show dates."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name))
        strings = [_texts(si) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter() if _tag(x) == "numFmt"}
            shown = [int(x.get("numFmtId", 0)) for c in styles if _tag(c) == "cellXfs" for x in c]
            dates = {n for n, f in enumerate(shown) if f in DATE_FORMATS or re.search(r"(?i)[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(f, "")))}
        sheets = []
        for sheet in (x for x in tree("xl/workbook.xml").iter() if _tag(x) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            sheets.append((sheet.get("name"), tree(target if target.startswith("xl/") else f"xl/{target}")))
        return sheets, strings, dates


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, object]]:
    """(sheet, row, column, value) of a workbook's cells: numbers as floats, dates, truth values, all else as text."""
    sheets, strings, dates = _workbook(data)
    out = []
    for name, tree in sheets:
        for c in (x for x in tree.iter() if _tag(x) == "c"):
            row, col, _, _ = a1_range(c.get("r"))
            raw = next((x.text for x in c if _tag(x) == "v"), None)
            kind = c.get("t", "n")
            if kind == "inlineStr":
                value = _texts(c)
            elif raw is None:
                value = None
            elif kind == "s":
                value = strings[int(raw)]
            elif kind == "b":
                value = raw == "1"
            elif kind == "d":
                value = datetime.datetime.fromisoformat(raw)
            elif kind == "n":
                value = float(raw)
                if int(c.get("s", 0)) in dates:
                    value = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(value * 86400))
            else:
                value = raw
            if value not in (None, ""):
                out.append((name, row, col, value))
    return out


def xlsx_merges(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(sheet, first row, first column, last row, last column) of a workbook's merged cells."""
    return [(name, *a1_range(x.get("ref"))) for name, tree in _workbook(data)[0] for x in tree.iter() if _tag(x) == "mergeCell"]


def _from_workbooks(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    """rows(data) of each .xlsx file below the folder, after doc_id, the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(folder)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(path.rsplit("/", 1)[-1], *r) for path, data in zip(pdf["path"], pdf["content"], strict=True) for r in rows(data)], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def sheet_rows(data: bytes) -> list[tuple[str, int, int, str, str]]:
    """(sheet, row, column, value as text, type: n, b, d or s) of a workbook's cells."""
    from larkspur.operators.tables import cell_text

    kind = lambda v: "b" if isinstance(v, bool) else "n" if isinstance(v, float) else "d" if isinstance(v, datetime.date) else "s"
    return [(s, r, c, repr(v) if isinstance(v, float) else cell_text(v), kind(v)) for s, r, c, v in xlsx_cells(data)]


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, sheet, row, col, value (text), vtype (n, b, d or s) of the .xlsx files below a folder."""
    return _from_workbooks(spark, folder, sheet_rows, "doc_id string, sheet string, row int, col int, value string, vtype string")


def read_merges(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, sheet, r1, c1, r2, c2 (0-based, both ends within) of the .xlsx files below a folder."""
    return _from_workbooks(spark, folder, xlsx_merges, "doc_id string, sheet string, r1 int, c1 int, r2 int, c2 int")
