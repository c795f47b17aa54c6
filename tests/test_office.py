"""Word documents and slides: what is read from their XML, and the data source over folders."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.sources import office


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def word(body, styles=None):
    return packed({"word/document.xml": f'<w:document xmlns:w="w" xmlns:m="m" xmlns:d="d"><w:body>{body}</w:body></w:document>'} | ({"word/styles.xml": styles} if styles else {}))


def p(text, style="", mark="", more=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{mark}</w:rPr><w:t>{text}</w:t></w:r>{more}</w:p>'


def texts(data):
    return [(k, t, lv) for k, t, lv, *_ in office.docx_elements(data)]


BOLD = "<w:b/>"


def test_paragraphs_in_content_controls_links_and_breaks():
    inline = '<w:sdt><w:sdtContent><w:r><w:t> in form</w:t></w:r></w:sdtContent></w:sdt><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del>'
    body = f"<w:sdt><w:sdtContent><w:sdt><w:sdtContent>{p('deep')}</w:sdtContent></w:sdt>{p('outer')}</w:sdtContent></w:sdt>{p('own', more=inline)}{p('  ')}"
    assert texts(word(body)) == [("text", "deep", None), ("text", "outer", None), ("text", "own in form link\tx\ny", None)]


def test_text_boxes_come_once_and_are_no_pictures():
    box = lambda *ts: "<w:txbxContent>" + "".join(map(p, ts)) + "</w:txbxContent>"
    both = f"<w:r><m:AlternateContent><m:Choice><w:drawing>{box('note', 'second')}</w:drawing></m:Choice><m:Fallback><w:pict>{box('note', 'second')}</w:pict></m:Fallback></m:AlternateContent></w:r>"
    assert texts(word(p("anchor", more=both) + p("next", more=both))) == [("text", "anchor", None), ("text", "note", None), ("text", "second", None), ("text", "next", None)]


@pytest.mark.parametrize(
    "text,heading",
    [("Results of the year", True), ("Results.", False), ("Results,", False), ("1) All of it.", True), ("Section 4.", True), ("A. Scope.", True), ("word " * 15, False), ("結果と考察", True), ("長" * 26, False), ("長" * 25, True), ("結果。", False), ("x" * 60, True)],
)
def test_bold_headings(text, heading):
    assert texts(word(p(text, mark=BOLD) + p("body"))) == [("text", text.strip(), 1 if heading else None), ("text", "body", None)]


def test_bold_counts_only_without_heading_styles_and_as_a_whole():
    assert texts(word(p("Bold", mark=BOLD) + p("Styled", "Heading2"))) == [("text", "Bold", None), ("text", "Styled", 2)]
    assert texts(word(p("Half", mark=BOLD, more="<w:r><w:t> plain</w:t></w:r>"))) == [("text", "Half plain", None)]
    assert texts(word(p("Off", mark='<w:b w:val="0"/>'))) == [("text", "Off", None)]
    styles = '<w:styles xmlns:w="w"><w:style w:styleId="berschrift3"><w:name w:val="heading 3"/></w:style><w:style w:styleId="Titel"><w:name w:val="Title"/></w:style></w:styles>'
    assert texts(word(p("Teil", "berschrift3") + p("Buch", "Titel") + p("x", "other"), styles)) == [("text", "Teil", 3), ("text", "Buch", 1), ("text", "x", None)]


def test_word_tables_and_pictures():
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(t)}</w:tc>"
    rows = f"<w:tr>{cell('a', '<w:gridSpan w:val=\"2\"/>')}{cell('b', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('c')}{cell('d')}{cell('', '<w:vMerge/>')}</w:tr>"
    picture = lambda descr: f'<w:p><w:r><w:drawing><d:docPr descr="{descr}"/><d:blip/></w:drawing></w:r></w:p>'
    got = office.docx_elements(word(f"<w:tbl>{rows}</w:tbl>{picture('Map of the valley')}{picture('')}"))
    assert got == [("table", None, None, 0, "<table><tr><td>a</td><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td><td>b</td></tr></table>", None), ("image", None, None, 0, None, "Map of the valley"), ("image", None, None, 0, None, "")]


def slide(shapes):
    return f'<p:sld xmlns:a="a" xmlns:p="p"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'


def shape(*paragraphs, kind=""):
    return f"<p:sp>{kind}<p:txBody>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in paragraphs) + "</p:txBody></p:sp>"


def test_slides():
    table = "<p:graphicFrame><a:graphicData uri='x/table'><a:tbl><a:tr><a:tc><a:txBody><a:p><a:t>h</a:t></a:p></a:txBody></a:tc><a:tc/></a:tr></a:tbl></a:graphicData></p:graphicFrame>"
    chart = "<p:graphicFrame><a:graphicData uri='x/chart'/></p:graphicFrame>"
    picture = '<p:pic><p:nvPicPr><p:cNvPr descr="Two boats"/></p:nvPicPr></p:pic>'
    group = f"<p:grpSp><p:grpSp>{shape('deep')}</p:grpSp>{picture}</p:grpSp>"
    first = slide(shape("one", " ", "two") + group + table + chart + shape("Title", kind='<p:ph type="ctrTitle"/>'))
    data = packed({"ppt/slides/slide1.xml": slide(shape("last")), "ppt/slides/slide2.xml": first, "ppt/presentation.xml": '<p xmlns:r="r"><sldIdLst><sldId r:id="b"/><sldId r:id="a"/></sldIdLst></p>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="/ppt/slides/slide2.xml"/></R>'})
    assert office.pptx_elements(data) == [
        ("text", "Title", 1, 0, None, None), ("text", "one", None, 0, None, None), ("text", "two", None, 0, None, None), ("text", "deep", None, 0, None, None), ("image", None, None, 0, None, "Two boats"),
        ("table", None, None, 0, "<table><tr><td>h</td><td></td></tr></table>", None), ("chart", None, None, 0, None, None), ("text", "last", None, 1, None, None),
    ]
    plain = packed({f"ppt/slides/slide{n}.xml": slide(shape(str(n))) for n in (10, 9)})
    assert [t for _, t, *_ in office.pptx_elements(plain)] == ["9", "10"]


def test_data_source(spark, tmp_path):
    """Groups of files are partitions; broken files give no rows; the same rows as from binaryFile; captions are authored ones."""
    (tmp_path / "sub").mkdir()
    alt = lambda text: f'<w:p><w:r><w:drawing><d:docPr descr="{text}"/><d:blip/></w:drawing></w:r></w:p>'
    for n in range(6):
        (tmp_path / "sub" / f"{n}.docx").write_bytes(word(p(f"text {n}") + alt("IMG_1.png" if n % 2 else "A plan of the town")))
    (tmp_path / "s.PPTX").write_bytes(packed({"ppt/slides/slide1.xml": slide(shape("talk"))}))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "notes.txt").write_text("x")
    df = office.read_office(spark, str(tmp_path), group_bytes=1000)
    assert df.rdd.getNumPartitions() > 2
    rows = df.orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.kind, r.text or r.caption) for r in rows] == [x for n in range(6) for x in ((f"{n}.docx", "text", f"text {n}"), (f"{n}.docx", "image", None if n % 2 else "A plan of the town"))] + [("s.PPTX", "text", "talk")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).filter(F.col("path").rlike(r"(?i)\.(docx|pptx)$"))
    assert office.elements_of(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")).orderBy("doc_id", "idx").collect() == rows
    (tmp_path / "none").mkdir()
    assert not office.read_office(spark, f"file://{tmp_path}/none").collect()
