"""Operators on small fixtures, against plain loops."""

import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import acl, chunking, context, search, serving, structure, tables
from larkspur.sources import index, readers, sinks
from larkspur.streaming import sessions

ELEMENT = "doc_id string, lang string, doc_type string, idx int, kind string, text string, text_level int, page int, list_items array<string>, caption string, footnote string, table_body string, asset_content string, image_path string, merge_prev boolean"


def elements(spark, lines, doc_type=None, lang="en"):
    """lines: (kind, text, level, page)."""
    rows = [("d", lang, doc_type, i, k, t, lv, p, None, None, None, None, None, None, False) for i, (k, t, lv, p) in enumerate(lines)]
    return spark.createDataFrame(rows, ELEMENT)


FIXTURE = [("header", "Running", None, 0), ("text", "2 Methods", 1, 0), ("text", "Body of methods.", None, 0), ("text", "2.1 Data", 1, 0), ("text", "Body of data.", None, 0), ("table", "", None, 0), ("text", "2.2 Model", 1, 1), ("text", "Body of the model.", None, 1), ("footer", "page 2", None, 1)]


def test_levels_and_tree(spark):
    e = elements(spark, FIXTURE)
    rows = {r.idx: r for r in structure.sections(structure.leveled(e), e).collect()}
    assert {i: (r.level, r.end_idx, r.parent_idx, r.breadcrumb) for i, r in rows.items()} == {1: (1, 9, None, ["2 Methods"]), 3: (2, 6, 1, ["2 Methods", "2.1 Data"]), 6: (2, 9, 1, ["2 Methods", "2.2 Model"])}


@pytest.mark.parametrize("numbers,promoted", [(["1 a", "2 b", "1 c", "2 d"], False), (["1 a", "1.1 b", "2 c", "3 d"], True)])
def test_numbering_that_starts_again_is_a_list(spark, numbers, promoted):
    e = elements(spark, [("text", n, 3, 0) for n in numbers])
    levels = [r.level for r in structure.leveled(e).orderBy("idx").collect()]
    assert levels == ([3] * 4 if not promoted else [1, 2, 1, 1])


def test_banners(spark):
    lines = [x for p in range(8) for x in (("text", "Draft 7", None, p), ("text", "Prompt:", None, p), ("text", f"page {p}", None, p))]
    assert [r.norm for r in structure.banners(elements(spark, lines)).collect()] == ["Draft 7"]
    assert not structure.banners(elements(spark, lines[:9])).count()


def test_chunks_keep_every_body_and_number_densely(spark):
    lines = FIXTURE[:5] + [("text", "word " * 900, None, 0)] + FIXTURE[5:]
    rows = chunking.chunks(elements(spark, lines)).orderBy("chunk_no").collect()
    assert [r.chunk_id for r in rows] == [f"d#{i:04d}" for i in range(len(rows))]
    assert {i for r in rows for i in r.source_indices} == {2, 4, 5, 8}  # the table (6) holds nothing


def test_same_named_sections_stay_apart(spark):
    lines = [("text", "1 Part", 1, 0), ("text", "Notes", 2, 0), ("text", "first", None, 0), ("text", "Notes", 2, 0), ("text", "second", None, 0)]
    assert [r.text for r in chunking.chunks(elements(spark, lines)).orderBy("chunk_no").collect()] == ["first", "second"]


def test_assets(spark):
    rows = [("d", "en", None, i, k, None, None, 0, None, cap, None, body, content, img, False) for i, (k, cap, body, content, img) in enumerate([("table", None, None, None, None), ("table", "Sales", "<tr><th>Year</th></tr><tr><td>2020</td></tr>", None, None), ("image", None, None, None, "../../etc/passwd"), ("image", None, None, None, "img/a.png")])]
    got = {r.idx: (r.retrieval, r.image) for r in chunking.asset_rows(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert got == {1: ("Sales Year | 2020", None), 3: ("", "img/a.png")}


def test_pack_glues_merges_and_small_groups():
    block = lambda i, n, merge=False: (i, "x" * n, 0, merge)
    ids = lambda groups: [[b[0] for b in g] for g in groups]
    assert ids(chunking.pack([block(0, 300), block(1, 300), block(2, 300)], (0, 100, 200), 4.0)) == [[0], [1], [2]]
    assert ids(chunking.pack([block(0, 300), block(1, 300, True)], (0, 100, 200), 4.0)) == [[0, 1]]
    assert ids(chunking.pack([block(0, 300), block(1, 40), block(2, 300)], (20, 80, 200), 4.0)) == [[0, 1], [2]]
    long = " ".join("s" * 90 + "." for _ in range(10))
    pieces = chunking.pack([(0, long, 0, False)], (0, 50, 100), 4.0)
    assert len(pieces) == 3 and all(len(p[0][1]) / 4 <= 100 for p in pieces)


def test_sentences_of_unspaced_text_stay_whole():
    text = "一句。二句。三句。"
    assert chunking.sentence_pieces(text, 2, 1.7) == [text]
    assert len(chunking.sentence_pieces(text, 2, 1.7, unspaced=True)) == 3


def doc(lines, sections, limits, admitted=()):
    out = context.Document("d", lines, [True] * len(lines), [0] * len(lines), sections, 4.0, limits)
    out.admit(list(admitted))
    return out


def test_big_block_paths():
    lines = ["a" * 40] * 10
    tree = {0: {"start": 0, "end": 10, "parent": None}, 4: {"start": 4, "end": 6, "parent": 0}}
    whole = doc(lines, tree, (5, 15, 200)).big_block([4], 4, 0, 0)
    assert (whole["resolved_section"], whole["climbed"]) == ("d::s4", 0)
    assert doc(lines, tree, (5, 90, 200)).big_block([4], 4, 0, 0)["climbed"] == 1
    over = doc(lines, tree, (5, 50, 60)).big_block([4], 4, 0, 0)
    assert over["note"] == context.OVERSHOT and over["n_tokens"] <= 60
    assert doc(lines, tree, (5, 8, 10)).big_block([4], 4, 0, 0)["note"] == "section>max -> window"
    assert doc(lines, {}, (5, 30, 60)).big_block([2], None, 0, 0)["resolved_section"] == "d::p0#window"
    closed = doc(lines, tree, (0, 5, 200), [i == 4 for i in range(10)]).big_block([4], 4, 0, 0)
    assert closed["text"] == "a" * 40


CAPS = [("ab cd ef gh\nx", 2, 4.0, "ab cd"), ("abc\nefg\nij", 2.5, 4.0, "abc\nefg\nij"), ("abc\nefg\nij", 1.75, 4.0, "abc\nefg"), ("一二三四五六", 2, 1.7, "一二三"), ("abcdefghijkl", 2, 4.0, "abcdefgh"), ("", 1, 4.0, ""), ("a\n\nbcdef", 1, 4.0, "a\n")]


def test_cap_keeps_the_first_line(spark):
    df = spark.createDataFrame([(n, t, float(m), r) for n, (t, m, r, _) in enumerate(CAPS)], "n int, t string, m double, r double")
    got = {r.n: r.c for r in df.select("n", X.capped(F.col("t"), F.col("m"), F.col("r")).alias("c")).collect()}
    for n, (text, most, ratio, want) in enumerate(CAPS):
        assert got[n] == want and context.capped_length(text.split("\n"), most, ratio) == len(want)


def test_asset_chunks(spark):
    """Labels and breadcrumb of a table are its text, its body stays raw; a picture's description has low trust; empty ones are no chunks and shift no ids."""
    body = "<table><tr><td></td><td>As of December 31,</td></tr><tr><td>2015</td><td>2014</td></tr><tr><td>Revenues</td><td>$ 6,779,511</td><td>$ 5</td></tr></table>"
    rows = [("text", "Overview", 1, None, None, None, None), ("text", "Segments", 2, None, None, None, None), ("table", "", None, "Selected Data", body, None, None), ("table", "", None, None, None, None, None), ("text", "prose", None, None, None, None, None), ("table", None, None, None, body, None, None), ("image", None, None, None, None, "a red bridge", None), ("chart", None, None, None, None, None, "img/a.png"), ("image", None, None, None, None, None, "../x"), ("text", "more", None, None, None, None, None)]
    e = spark.createDataFrame([("d", "en", "form", i, k, t, lv, 0, None, cap, None, b, c, img, False) for i, (k, t, lv, cap, b, c, img) in enumerate(rows)], ELEMENT)
    got = chunking.chunks(e).orderBy("chunk_no").collect()
    labels = "As of December 31, | 2015 | 2014 | Revenues"
    assert [(r.chunk_id, r.kind, r.text, r.flags, r.trust, r.image_path) for r in got] == [
        ("d#0000", "table", f"Selected Data Overview > Segments {labels}", [], "high", None), ("d#0001", "text", "prose", [], "high", None), ("d#0002", "table", f"Overview > Segments {labels}", ["captionless"], "high", None),
        ("d#0003", "image", "a red bridge", ["captionless", "vlm_content"], "low", None), ("d#0004", "chart", "[chart without caption]", ["captionless", "image_only"], "high", "img/a.png"), ("d#0005", "text", "more", [], "high", None),
    ]
    assert got[0].content_raw == body and got[4].n_tokens == 0 and all(r.breadcrumb == ["Overview", "Segments"] for r in got)
    e = spark.createDataFrame([("d", "en", "form", 0, "table", "", None, 0, None, "Cap", None, body, None, None, False)], ELEMENT)
    assert [r.text for r in chunking.chunks(e).collect()] == [f"Cap {labels}"]


def test_captions_are_texts_or_lists(spark):
    blocks = [{"type": "chart", "chart_caption": "one text", "chart_footnote": ["foot", "note"]}, {"type": "table", "table_caption": ["a", "b"], "table_footnote": []}, {"type": "image", "image_caption": "[Fig. 1] x", "image_footnote": ""}, {"type": "image"}]
    got = readers.elements_from_json(spark.createDataFrame([("d", json.dumps(blocks))], "doc_id string, json string")).orderBy("idx").collect()
    assert [(r.caption, r.footnote) for r in got] == [("one text", "foot note"), ("a b", None), ("[Fig. 1] x", None), (None, None)]


def test_only_texts_and_lists_go_on_over_a_page(spark):
    e = spark.createDataFrame([("d", i, k, 0, "a longer text") for i, k in enumerate(["text", "table", "list"])], "doc_id string, idx int, kind string, page int, text string")
    layout = spark.createDataFrame([("d", 0, 0, "a longer text", True)], "doc_id string, page int, pos int, text string, merge_prev boolean")
    assert [r.merge_prev for r in readers.merge_flags(e, layout).orderBy("idx").collect()] == [True, False, True]


def test_a_band_is_as_wide_as_its_own_rows():
    wide = [["k", "a", "b", "c", "d"], ["x", 1.0, 2.0, 3.0, 4.0]]
    people = [["name", "town", "job"], ["Ann", "Bern", "cook"], ["Bob", "Rome", "smith"]]
    parts = tables.sheet_chunks([*wide, [], *people], (), "S")
    assert [p[1].splitlines()[1:] for p in parts] == [["| k | a | b | c | d |", "| --- | --- | --- | --- | --- |", "| x | 1 | 2 | 3 | 4 |"], ["| name | town | job |", "| --- | --- | --- |", "| Ann | Bern | cook |", "| Bob | Rome | smith |"]]
    # a band of numbers goes on under the header before, and may be wider
    parts = tables.sheet_chunks([["n", "v"], ["a", 1.0], [], [1.5, 2.5, 3.5]], (), "S")
    assert parts[1][1].splitlines()[1:] == ["| n | v |  |", "| --- | --- | --- |", "| 1.5 | 2.5 | 3.5 |"]
    # forty columns of one band are one slice, whatever another band has
    parts = tables.sheet_chunks([[f"c{i}" for i in range(50)], [], ["name", "town"], ["Ann", "Bern"]], (), "S")
    assert [p[0] for p in parts] == ["header_only", "header_only", "table"]
    # groups are spread over equal labels too
    assert tables.pair_labels(["Sales", "", "Cost"], ["Sales", "2021", ""]) == ["Sales Sales", "Sales 2021", "Cost"]


@pytest.mark.parametrize("tenant,principals,seen", [("t", ["g"], {1, 2}), ("t", [], {2}), ("", ["g"], set()), ("u", ["g"], set())])
def test_acl_is_closed_by_default(spark, tenant, principals, seen):
    schema = "doc_id int, acl struct<tenant:string,allow:array<string>,visibility:string,unset:boolean>"
    docs = spark.createDataFrame([(1, ("t", ["g"], "restricted", False)), (2, ("t", [], "public", False)), (3, ("t", ["g"], "public", True)), (4, None), (5, ("", ["g"], "public", False)), (6, ("t", None, None, None))], schema)
    split = docs.select("doc_id", *[c.alias(n) for n, c in acl.split(F.col("acl")).items()])
    assert {r.doc_id for r in acl.visible(split, tenant, principals).collect()} == seen


def test_sheets_keep_every_value():
    grid = [["Report"], ["in thousands"], [], ["Name", "Unit", "2020"], ["a", "kg", 1.0], ["b", "kg", 2.5], [], ["c", 7, 3]]
    parts = tables.sheet_chunks(grid)
    text = "\n".join(p[1] for p in parts)
    assert all(tables.cell_text(v) in text for row in grid for v in row)
    assert [p[0] for p in parts] == ["nontabular", "table", "table"] and parts[2][1].startswith("Sheet: \n| Name | Unit | 2020 |")


def test_wide_sheet_repeats_its_key():
    grid = [[f"h{i}" for i in range(95)], [f"v{i}" for i in range(95)]]
    parts = tables.sheet_chunks(grid)
    assert len(parts) == 3 and all(p[1].startswith("Sheet: \n| h0 |") for p in parts)


def test_merged_headers_and_blank_rows_within_a_merge():
    assert tables.header_labels([["Sales", "", "Cost"], ["2020", "2021", "2020"]], [(0, 0, 0, 1)], 0) == ["Sales 2020", "Sales 2021", "Cost 2020"]
    rows = [["a"], [""], ["b"], [""], ["c"]]
    assert tables.bands(rows) == [(0, 1), (2, 3), (4, 5)]
    assert tables.bands(rows, [(0, 0, 2, 0)]) == [(0, 3), (4, 5)]
    assert tables.bands([[""], ["a"]], [(0, 0, 1, 0)]) == [(1, 2)]  # the top of a merge may be blank
    assert tables.markdown_row(["a|b"]) == "| a\\|b |"


def test_sheet_values_and_types():
    grid = [["Title"], ["Group", None, "Other"], ["2020", "b", "c"], [1.0, "12", True], [2.5, "x|y", False]]
    parts = tables.sheet_chunks(grid, [(1, 0, 2, 0)], "S")
    assert [(p[0], p[4]) for p in parts] == [("nontabular", None), ("table", "Title")]
    assert parts[1][1].splitlines() == ["Sheet: S — Title", "| Group 2020 | b | Other c |", "| --- | --- | --- |", "| 1 | 12 | true |", "| 2.5 | x\\|y | false |"]
    # texts of digits are no numbers, years are labels
    assert tables.header_like(["12", "13"]) and tables.header_like([2020.0, 2021.0]) and not tables.header_like([12.0, 13.0]) and tables.header_like(["x"])
    long = [["h", "i"], *([f"row {n}", "y" * 500] for n in range(20))]
    sizes = [len(p[1]) / 4 for p in tables.sheet_chunks(long)]
    assert len(sizes) > 4 and max(sizes) <= 600


def test_sheets_with_merges_from_a_workbook(spark, tmp_path):
    cells = '<c r="A1" t="inlineStr"><is><t>Sales</t></is></c><c r="C1" t="inlineStr"><is><t>Who</t></is></c><c r="A2" t="inlineStr"><is><t>old</t></is></c><c r="B2" t="inlineStr"><is><t>new</t></is></c><c r="A3"><v>5</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3" t="b"><v>1</v></c>'
    sheet = f'<w>{cells}<mergeCells><mergeCell ref="A1:B1"/><mergeCell ref="C1:C2"/></mergeCells></w>'
    data = office({"xl/workbook.xml": '<w xmlns:r="r"><sheet name="S" r:id="x"/></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="x" Target="/xl/worksheets/s.xml"/></R>', "xl/worksheets/s.xml": sheet, "xl/styles.xml": '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></s>'})
    (tmp_path / "a.xlsx").write_bytes(data)
    rows, merges = readers.read_sheets(spark, str(tmp_path)), readers.read_merges(spark, str(tmp_path))
    assert sorted(tuple(r)[2:] for r in merges.collect()) == [(0, 0, 0, 1), (0, 2, 1, 2)]
    got = tables.chunk_sheets(rows, merges).collect()
    assert [r.text.splitlines()[1:] for r in got] == [["| Sales old | Sales new | Who |", "| --- | --- | --- |", "| 5 | 2023-03-15T00:00:00 | true |"]]
    elements, sections = tables.sheet_elements(tables.chunk_sheets(rows, merges))
    assert [(r.idx, r.kind) for r in elements.collect()] == [(0, "table")] and [(r.sec_id, r.idx, r.end_idx) for r in sections.collect()] == [("a.xlsx::sheet::S", 0, 1)]


@pytest.mark.parametrize("ref,want", [("B2:D5", (1, 1, 4, 3)), ("D5:B2", (1, 1, 4, 3)), ("AA1", (0, 26, 0, 26))])
def test_a1(ref, want):
    assert readers.a1_range(ref) == want


def test_hashes_and_ids(spark):
    words = ["", "a", "héllo", "foobar"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r for r in df.select("w", X.fnv1a32(F.col("w")).alias("h"), X.uuid5_url(F.col("w")).alias("u")).collect()}
    for w in words:
        h = 2166136261
        for b in w.encode():
            h = (h ^ b) * 16777619 % 2**32
        assert got[w].h == h and got[w].u == str(uuid.uuid5(uuid.NAMESPACE_URL, w))


def test_tokens(spark):
    t = lambda s: spark.createDataFrame([(s,)], "t string").select(X.tokenize(F.col("t"), ["the"])).first()[0]
    assert t("The GPT-4 model v1.2") == ["gpt", "4", "model", "v1", "2", "gpt-4", "v1.2"]
    assert t(None) == []


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbook_cells():
    data = office({"xl/workbook.xml": '<w xmlns:r="r"><sheet name="S" r:id="x"/></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="x" Target="worksheets/s.xml"/></R>', "xl/sharedStrings.xml": "<s><si><t>hi</t></si></s>", "xl/worksheets/s.xml": '<w><c r="A1" t="s"><v>0</v></c><c r="B2"><v>1.5</v></c></w>'})
    assert readers.xlsx_cells(data) == [("S", 0, 0, "hi"), ("S", 1, 1, 1.5)]


def test_index_replaces_documents(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    rows = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    now = lambda: {r.doc_id: r.text for r in index.read_index(spark, path).collect()}
    with pytest.raises(FileNotFoundError):
        index.read_index(spark, path)
    index.write_index(rows(range(40), "old"), path)
    index.write_index(rows([3, 50], "new"), path)
    got = now()
    assert len(got) == 41 and got[3] == got[50] == "new" and got[4] == "old"
    index.delete_documents(spark, path, spark.createDataFrame([(3,), (4,), (999,)], "doc_id long"))
    assert set(now()) == {*range(40), 50} - {3, 4}
    index.write_index(rows([4], "again"), path)
    before = now()
    index.merge_index(spark, path)
    assert now() == before and before[4] == "again" and len(index.manifest(spark, path)["batches"]) == 1
    assert [r.text for r in index.read_index(spark, path, 4).collect()] == ["again"]
    # a writer that was overtaken fails and changes nothing; one that fails midway changes nothing
    stale = index.manifest(spark, path)
    index.write_index(rows([60], "x"), path)
    monkeypatch.setattr(index, "manifest", lambda *a: stale)
    with pytest.raises(RuntimeError):
        index.write_index(rows([61], "y"), path)
    monkeypatch.undo()
    assert 60 in now() and 61 not in now()
    monkeypatch.setattr(index, "MOST_BATCHES", 3)
    index.write_index(rows([62], "z"), path)
    assert len(index.manifest(spark, path)["batches"]) == 1 and now()[62] == "z"
    monkeypatch.setattr(index, "VERSION", 2)
    with pytest.raises(index.VersionError):
        index.read_index(spark, path)


def test_searches_read_only_their_terms(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"word{n % 50} common other{n}") for n in range(2000)], "doc_id long, text string")
    index.write_postings(docs, f"file://{tmp_path}/p")
    posts, lengths = index.read_postings(spark, f"file://{tmp_path}/p")
    rows = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    fast = search.sparse_scores(docs.select("doc_id"), "word7 common", posts)
    assert rows(fast) == rows(search.sparse_scores(docs, "word7 common"))
    assert rows(search.okapi_scores(docs.select("doc_id"), "word7", posts=posts, lengths=lengths)) == rows(search.okapi_scores(docs, "word7"))
    assert "PushedFilters: [In(tok" in fast._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_checked(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "doc_id int, embedding array<double>")
    assert index.checked_vectors(v.filter("doc_id = 1"), 2).count() == 1
    with pytest.raises(Exception, match="width"):
        index.checked_vectors(v, 2).collect()
    with pytest.raises(ValueError):
        index.checked_vectors(v, 2, "a", "b")


def test_blocks_hold_elements_of_the_hits_acl_only(spark):
    """A public and a restricted chunk of one section; an element in both has the stricter acl, headings have none."""
    e = elements(spark, [("text", "1 Part", 1, 0), ("text", "open text", None, 0), ("text", "closed text", None, 0), ("text", "shared text", None, 0)])
    schema = "doc_id string, chunk_no int, chunk_id string, source_indices array<int>, sec_head int, page_start int, page_end int, acl_tenant string, acl_allow array<string>, acl_visibility string, acl_unset boolean"
    chunks = spark.createDataFrame([("d", 0, "d#0", [1, 3], 0, 0, 0, "t", ["g"], "public", False), ("d", 1, "d#1", [2, 3], 0, 0, 0, "t", ["h"], "restricted", False)], schema)
    own = serving.with_chunk_acls(e, chunks)
    text = lambda who: {r.hit_no: r.text for r in serving.expand(chunks, None, own, "t", who).collect()}
    assert text(["g"]) == {0: "open text"}
    assert text(["h"]) == {0: "open text", 1: "closed text\nshared text"}
    assert text([]) == {0: "open text"} and not serving.expand(chunks, ["d#1"], own, "t", ["g"]).count()


def test_identities_have_single_names(spark):
    one = spark.createDataFrame([("k" * 16, "a")], "key string, name string")
    assert sinks.append_identity(one, one.withColumn("name", F.lit("b"))).count() == 2
    with pytest.raises(ValueError):
        sinks.append_identity(one, one)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", i % 3, "click", 1.0) for i in range(20)]
    src = str(tmp_path / "log")
    spark.createDataFrame(rows, "event_id long, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = sessions.run_available(sessions.tumbling(stream()), "tumbling", "complete", str(tmp_path / "c1"))
    assert sorted(r.n for r in out.collect()) == [4] * 5
    out = sessions.run_available(sessions.late_dedup(stream(), ["user_id", "event_type"]), "deduped", "append", str(tmp_path / "c2"))
    assert out.count() == 3


def test_deliveries_are_remembered_per_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "MOST_KEYS", 3)
    src = str(tmp_path / "log")
    schema = "session string, key string"
    keys = [("a", "x"), ("b", "x"), ("a", "y"), ("a", "x"), ("a", "y"), ("a", "z"), ("a", "u"), ("a", "x")]
    spark.createDataFrame(keys, schema).coalesce(1).write.parquet(src)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = sessions.run_available(sessions.deliveries(spark.readStream.schema(schema).parquet(src)), "deliveries", "append", str(tmp_path / "state"))
        # x, y, z are held; the fourth key clears them
        assert sorted(tuple(r) for r in out.collect()) == [("a", "u", False), ("a", "x", False), ("a", "x", False), ("a", "x", True), ("a", "y", False), ("a", "y", True), ("a", "z", False), ("b", "x", False)]
    finally:
        spark.conf.unset(provider)


def test_a_stream_gives_what_the_batch_gives(spark):
    from larkspur.plans.registry import QUERIES

    rows = lambda name: sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    assert rows("stream_windows") == rows("tumbling_windows")
