"""Word documents and slides as elements: a recursive walk of their XML, and a data source that reads folders of them.

Paragraphs, tables, text boxes and pictures come in reading order, from within content controls and grouped shapes too.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.sources.office_meta import authored_alt

ELEMENTS = "doc_id string, idx int, kind string, text string, text_level int, page int, table_body string, alt string"
#: Bytes of files that a task reads, about; a larger file is a task of its own.
GROUP_BYTES = 32 << 20

# fixed values: what ends a sentence, words and marks that open a numbered heading, and how long a bold heading may be
TERMINAL = tuple("。！？；.!?;，,")
NUMBERED = r"(?i)^\s*(?:section|article|clause|sec\.|art\.|chapter|part|rule|item|artículo|artikel|§)\b|^\s*\(?\d{1,3}[.)）]|^\s*[A-Z]\.\s"
MOST_WORDS, MOST_SIGNS = 14, 25


def tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def named(node, *names: str) -> Iterator:
    """The nodes below of such names, at any depth."""
    return (x for x in node.iter() if tag(x) in names)


def attribute(node, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), "") if node is not None else ""


#: Parts of a paragraph that hold runs, and those whose inside is not the paragraph's own text.
HOLDERS = {"hyperlink", "ins", "smartTag", "sdt", "sdtContent", "fld", "fldSimple", "r"}
BREAKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def run_text(node) -> str:
    """A paragraph's own text: runs also within links and content controls, but not text boxes that hang on it."""
    out = []
    for x in node:
        name = tag(x)
        if name == "t":
            out.append(x.text or "")
        elif name in BREAKS:
            out.append(BREAKS[name])
        elif name in HOLDERS:
            out.append(run_text(x))
    return "".join(out)


def bold_heading(paragraph, text: str) -> bool:
    """A short paragraph wholly in bold that is no sentence, unless it is numbered; a text of Chinese signs, which has no spaces, is short by its signs."""
    words = text.split()
    unspaced = len(words) == 1 and any("　" <= c <= "鿿" for c in text)
    if len(text if unspaced else words) > (MOST_SIGNS if unspaced else MOST_WORDS):
        return False
    if text.endswith(TERMINAL) and not re.match(NUMBERED, text):
        return False
    runs = [r for r in paragraph if tag(r) == "r" and run_text(r).strip()]
    marks = [next((b for p in r if tag(p) == "rPr" for b in p if tag(b) == "b"), None) for r in runs]
    return bool(runs) and all(m is not None and attribute(m, "val").lower() not in ("0", "false", "off") for m in marks)


def style_level(paragraph, names: dict[str, str]) -> int | None:
    """Of a heading's style, by its id (the same in all languages) or its name."""
    own = next((attribute(x, "val") for p in paragraph if tag(p) == "pPr" for x in p if tag(x) == "pStyle"), "")
    for m in (re.fullmatch(r"Heading(\d+)", own), re.fullmatch(r"(?i)Heading\s+(\d+)", names.get(own, "").strip())):
        if m:
            return int(m[1])
    return 1 if "title" in (own.lower(), names.get(own, "").strip().lower()) else None


def cell_of(node) -> str:
    return "\n".join(run_text(p) for p in node if tag(p) == "p").strip()


def word_table(table) -> str:
    """Rows of cells; a cell over several columns or rows stands in each."""
    above: list[str] = []
    rows = []
    for row in (r for r in table if tag(r) == "tr"):
        own: list[str] = []
        for cell in (c for c in row if tag(c) == "tc"):
            marks = {tag(x): x for p in cell if tag(p) == "tcPr" for x in p}
            goes_on = "vMerge" in marks and attribute(marks["vMerge"], "val") in ("", "continue")
            text = above[len(own)] if goes_on and len(own) < len(above) else cell_of(cell)
            own += [text] * max(1, int(attribute(marks.get("gridSpan"), "val") or 1))
        rows.append(own)
        above = own
    return html_table(rows)


def html_table(rows: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def blocks(parent) -> Iterator:
    """Paragraphs and tables in order, those in content controls too."""
    for x in parent:
        if tag(x) in ("p", "tbl"):
            yield x
        elif tag(x) in ("sdt", "sdtContent"):
            yield from blocks(x)


def alt_of(properties) -> str:
    return attribute(properties, "descr") or attribute(properties, "title")


def docx_elements(data: bytes) -> list[tuple]:
    """(kind, text, level, page, table_body, alt) of a Word document. Bold paragraphs are headings only where no style is one. A text box has two copies in the file and comes once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if tag(x) == "body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names = {} if styles is None else {attribute(s, "styleId"): attribute(next(named(s, "name"), None), "val") for s in named(styles, "style")}
    styled = any(style_level(p, names) is not None for p in body if tag(p) == "p")
    out: list[tuple] = []
    boxes: set[str] = set()
    for node in blocks(body):
        if tag(node) == "tbl":
            out.append(("table", None, None, 0, word_table(node), None))
            continue
        level, text = style_level(node, names), run_text(node).strip()
        if text:
            out.append(("text", text, 1 if level is None and not styled and bold_heading(node, text) else level, 0, None, None))
        for paragraph in (p for box in named(node, "txbxContent") for p in named(box, "p")):
            own = "".join(x.text or "" for x in named(paragraph, "t")).strip()
            if own and own not in boxes:
                boxes.add(own)
                out.append(("text", own, None, 0, None, None))
        drawn = [d for d in named(node, "drawing") if next(named(d, "blip"), None) is not None]
        drawn = drawn or [d for d in named(node, "pict") if next(named(d, "imagedata"), None) is not None]
        out += [("image", None, None, 0, None, alt_of(next(named(d, "docPr"), None))) for d in drawn]
    return out


def leaves(shapes) -> Iterator:
    for x in shapes:
        if tag(x) == "grpSp":
            yield from leaves(x)
        elif tag(x) in ("sp", "pic", "graphicFrame"):
            yield x


def slide_paragraph(node) -> str:
    return "".join("\x0b" if tag(x) == "br" else x.text or "" for x in named(node, "t", "br")).strip()


def slides(z: zipfile.ZipFile) -> list[str]:
    """The slides' parts in the order of the presentation, or of their numbers where it names none."""
    present = set(z.namelist())
    found: list[str] = []
    if {"ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"} <= present:
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        for x in named(ElementTree.fromstring(z.read("ppt/presentation.xml")), "sldId"):
            target = links.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), ""), "")
            found.append(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"ppt/{target}"))
    numbered = sorted((int(m[1]), n) for n in present if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [n for n in found if n in present] or [n for _, n in numbered]


def pptx_elements(data: bytes) -> list[tuple]:
    """(kind, text, level, page, table_body, alt) of slides: of each its title first, then paragraphs, tables, charts and pictures of all shapes, grouped ones too; notes are left out."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for page, name in enumerate(slides(z)):
            root = ElementTree.fromstring(z.read(name))
            shapes = list(leaves(next(named(root, "spTree"), root)))
            titles = {id(s) for s in shapes if any(y.get("type") in ("title", "ctrTitle") for y in named(s, "ph"))}
            for shape in sorted(shapes, key=lambda s: id(s) not in titles):
                table = next(named(shape, "tbl"), None)
                if table is not None:
                    cells = lambda r: ["\n".join(slide_paragraph(p) for p in named(c, "p")).strip() for c in r if tag(c) == "tc"]
                    out.append(("table", None, None, page, html_table([cells(r) for r in table if tag(r) == "tr"]), None))
                elif tag(shape) == "graphicFrame":
                    if any(x.get("uri", "").endswith("/chart") for x in named(shape, "graphicData")):
                        out.append(("chart", None, None, page, None, None))
                elif tag(shape) == "pic":
                    out.append(("image", None, None, page, None, alt_of(next(named(shape, "cNvPr"), None))))
                else:
                    level = 1 if id(shape) in titles else None
                    out += [("text", text, level, page, None, None) for p in named(shape, "p") if (text := slide_paragraph(p))]
    return out


READERS = {"docx": docx_elements, "pptx": pptx_elements}


def rows_of(name: str, data: bytes) -> list[tuple]:
    """Rows of ELEMENTS of one file; one that is no office file gives none."""
    try:
        found = READERS[name.rsplit(".", 1)[-1].lower()](data)
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return []
    return [(name, n, *x) for n, x in enumerate(found)]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class OfficeReader(DataSourceReader):
    """Files below a folder, in groups of about group_bytes."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("group_bytes", GROUP_BYTES))

    def _files(self):
        from pyarrow import fs

        at = re.sub(r"^s3[an]://", "s3://", self.path)
        return fs.FileSystem.from_uri(at if re.match(r"[a-z0-9]+:", at) else f"file://{posixpath.abspath(at)}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = self._files()
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        groups: list[list[str]] = []
        held = self.most + 1
        for f in sorted((f for f in found if f.is_file and f.base_name.lower().endswith(tuple(READERS))), key=lambda f: f.path):
            if held + f.size > self.most:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files):
        system = self._files()[0]
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as stream:
                yield from rows_of(path.rsplit("/", 1)[-1], stream.read())


class OfficeSource(DataSource):
    """spark.read.format("office"): ELEMENTS of the .docx and .pptx files below a folder of the shared file system; doc_id is the file's name."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(dict(self.options))


def captioned(elements: DataFrame) -> DataFrame:
    """ELEMENTS with caption: a picture's alternative text, where an author wrote it."""
    alt = authored_alt(F.col("alt"))
    return elements.withColumn("caption", F.when((F.col("kind") == "image") & (alt != ""), alt)).drop("alt")


def read_office(spark: SparkSession, folder: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Elements of the .docx and .pptx files below a folder, by the data source."""
    spark.dataSource.register(OfficeSource)
    return captioned(spark.read.format("office").option("group_bytes", group_bytes).load(folder))


def elements_of(files: DataFrame) -> DataFrame:
    """Elements of files that are rows (name, content), as spark.read.format("binaryFile") gives them from any store."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            frame = pd.DataFrame([r for name, data in zip(pdf["name"], pdf["content"], strict=True) for r in rows_of(name, data)], columns=[x.split()[0] for x in ELEMENTS.split(", ")])
            frame["text_level"] = frame["text_level"].astype("Int64")
            yield frame

    return captioned(files.select("name", "content").mapInPandas(run, ELEMENTS))
