"""Segmentation, placement by load, counted writes, layouts, table functions: against plain loops."""

import heapq
import io
import itertools
import json
import math
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.functions import tables as T
from larkspur.operators import evaluate as E
from larkspur.operators import segment as G
from larkspur.operators import search as S
from larkspur.sources import index, readers

WORDS = [("净利润", 50), ("利润", 80), ("净", 3), ("公司", 90), ("营收", 40), ("公", 2), ("司", 2), ("人民币", 30), ("人民", 60), ("币", 5), ("中国人民", 10), ("中国", 100)]


def likeliest(run, freq):
    """Of all ways to cut the run the best, by trying them."""
    total = sum(freq.values())
    best = None
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        words = [run[a:b] for a, b in itertools.pairwise(cuts)]
        if all(w in freq or len(w) == 1 for w in words):
            score = sum(math.log(freq.get(w, 1) / total) for w in words)
            if best is None or score > best[0] + 1e-12:
                best = (score, words)
    return best[1]


@pytest.mark.parametrize("limit", [10**6, 0], ids=["in tasks", "by join"])
def test_segmentation_is_the_best_of_all_cuts(spark, limit):
    rng = random.Random(5)
    signs = "净利润公司营收人民币中国元"
    runs = sorted({"".join(rng.choice(signs) for _ in range(rng.randrange(1, 10))) for _ in range(60)} | {"公司净利润", "中国人民币", "元"})
    dictionary = spark.createDataFrame([*WORDS, ("zero", 0), ("", 5), ("利润", 0)], "word string, freq long")
    got = {r.run: r.words for r in G.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), dictionary, limit).collect()}
    assert got == {r: likeliest(r, dict(WORDS)) for r in runs}
    assert got["公司净利润"] == ["公司", "净利润"] and got["中国人民币"] == ["中国", "人民币"]


def test_without_a_dictionary_signs_stand_alone(spark):
    got = G.segmented(spark.createDataFrame([("公司",)], "run string"), spark.createDataFrame([], "word string, freq long")).collect()
    assert [r.words for r in got] == [["公", "司"]]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_tokens_of_mixed_text(spark, limit):
    dictionary = spark.createDataFrame(WORDS, "word string, freq long")
    docs = spark.createDataFrame([(1, "使用 GPT-4 和 v1.2,公司营收 42000000 元"), (2, "model model"), (3, "gpt-4"), (4, ""), (5, None), (6, "。,、 "), (7, "净利润净利润 净利润")], "doc_id long, text string")
    tf = {(r.doc_id, r.tok): r.tf for r in S.counted(G.unspaced_rows(docs, dictionary, limit)).collect()}
    assert {"gpt-4", "v1.2", "42000000", "公司", "营收"} <= {t for d, t in tf if d == 1}
    assert tf[2, "model"] == 2 and tf[3, "gpt-4"] == 1 and tf[7, "净利润"] == 3 and not [d for d, _ in tf if d in (4, 5, 6)]


def plain_longest_first(items, keys):
    heap = [(0, k) for k in range(keys)]
    loads = [0] * keys
    for size, _ in sorted(((s, i) for i, s in items), key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(heap)
        loads[k] = load + size
        heapq.heappush(heap, (loads[k], k))
    return loads


@pytest.mark.parametrize("seed,keys,sizes", [(1, 3, 40), (2, 5, 3), (3, 8, 1), (4, 4, 1000), (5, 2, 7)])
def test_placement_has_the_loads_of_the_plain_heap(spark, seed, keys, sizes):
    rng = random.Random(seed)
    items = [(i, rng.randrange(sizes) + (seed != 5)) for i in range(500)]
    rows = E.assign_keys(spark.createDataFrame(items, "item long, size long"), keys).collect()
    loads = [0] * keys
    for r in rows:
        loads[r.key] += dict(items)[r.item]
    assert len(rows) == 500 and loads == plain_longest_first(items, keys)


def test_equal_items_are_dealt_as_one_by_one():
    rng = random.Random(6)
    for _ in range(300):
        loads = [rng.randrange(50) for _ in range(rng.randrange(1, 6))]
        size, count = rng.randrange(0, 12), rng.randrange(40)
        own, plain = list(loads), [0] * len(loads)
        for _ in range(count):
            k = own.index(min(own))
            own[k] += size
            plain[k] += 1
        assert E.deal_equals(loads, size, count) == plain


def test_ranks_within_hot_groups(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(300)], "g int, item long")
    got = {}
    for r in E.by_rank(rows, "g", "item", salts=5).collect():
        got.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and sum(map(len, got.values())) == 300


def test_counted_write(spark, tmp_path):
    rows = [("a", None), ("b", "x.png"), ("", None), (None, None), ("  ", None), (None, "y.png")]
    df = spark.createDataFrame(rows, "text string, image_path string").repartition(3)
    assert index.write_counted(df, f"file://{tmp_path}/c") == {"images": 2, "texts": 1, "skipped": 3, "indexed": 3}
    assert Counter(map(tuple, spark.read.parquet(f"file://{tmp_path}/c").collect())) == Counter([rows[0], rows[1], rows[5]])
    assert index.write_counted(df.limit(0), f"file://{tmp_path}/none") == {"images": 0, "texts": 0, "skipped": 0, "indexed": 0}
    with pytest.raises(index.CountError):
        index.check_counts({"images": 1, "texts": 1, "skipped": 0, "indexed": 2}, 3)


LAYOUT = {"pdf_info": [{"page_idx": 2, "para_blocks": [{"lines": [{"spans": [{"content": "goes on"}, {"content": "here"}]}, {"spans": None}], "merge_prev": True, "bbox": [1, 2, 3, 4]}, {"lines": None}]}, {"para_blocks": None}, {"para_blocks": [{"lines": [{"spans": [{"content": None}]}]}]}]}


def test_layout_files(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "layout.json").write_text(json.dumps(LAYOUT))
    (tmp_path / "d1" / "x_content_list.json").write_text(json.dumps([{"type": "text", "text": "Goes on here", "page_idx": 2}, {"type": "table", "text": "goes on here", "page_idx": 2}]))
    layout = readers.read_layout(spark, str(tmp_path))
    assert sorted((r.page, r.pos, r.text, r.merge_prev, r.bbox) for r in layout.collect()) == [(0, 0, "", False, None), (2, 0, "goes on here", True, [1.0, 2.0, 3.0, 4.0]), (2, 1, "", False, None)]
    merged = readers.merge_flags(readers.read_parsed(spark, str(tmp_path)), layout).orderBy("idx").collect()
    assert [(r.doc_id, r.merge_prev) for r in merged] == [("d1", True), ("d1", False)]


def test_content_blocks_in_sql(spark):
    T.register(spark)
    blocks = [{"type": "chart", "chart_caption": ["one", "two"], "chart_footnote": "foot", "content": "c", "bbox": [1, 2, 3, 4]}, {"text": "t", "page_idx": 3, "content": "no"}, "odd"]
    docs = spark.createDataFrame([(1, json.dumps(blocks)), (2, None), (3, "no json"), (4, "{}"), (5, "[]")], "doc_id long, json string")
    got = spark.sql("SELECT d.doc_id, b.* FROM {d} d, LATERAL content_blocks(d.json) b", d=docs).collect()
    assert [(r.doc_id, r.idx, r.kind, r.page, r.caption, r.footnote, r.asset_content, r.bbox) for r in sorted(got, key=lambda r: r.idx)] == [(1, 0, "chart", 0, "one two", "foot", "c", [1.0, 2.0, 3.0, 4.0]), (1, 1, "text", 3, None, None, None, None), (1, 2, "text", 0, None, None, None, None)]
    few = spark.sql("SELECT b.* FROM {d} d, LATERAL content_blocks(d.json, 'page, text') b", d=docs)
    assert few.columns == ["page", "text"] and sorted(map(str, map(tuple, few.collect()))) == ["(0, None)", "(0, None)", "(3, 't')"]
    with pytest.raises(Exception, match="no field colour"):
        spark.sql("SELECT b.* FROM {d} d, LATERAL content_blocks(d.json, 'colour') b", d=docs).collect()


def test_workbook_cells_in_sql(spark):
    T.register(spark)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="r"><sheet name="S" r:id="x"/></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="x" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/worksheets/s.xml", '<w><c r="A1" t="inlineStr"><is><t>hi</t></is></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></w>')
    books = spark.createDataFrame([(1, out.getvalue()), (2, b"no zip"), (3, None)], "doc_id long, content binary")
    got = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL workbook_cells(d.content) c ORDER BY row, col", d=books).collect()
    assert [tuple(r) for r in got] == [(1, "S", 0, 0, "hi", "s"), (1, "S", 1, 1, "1.5", "n"), (1, "S", 1, 2, "true", "b")]
    assert not spark.sql("SELECT * FROM {d} d, LATERAL workbook_cells(d.content) c", d=books.filter(F.col("doc_id") > 1)).collect()


def test_descriptions_and_table_labels(spark):
    from larkspur.functions import text as X

    told = {
        "a plain   text": "a plain text", "```mermaid\ngraph TD\nA[\"Start here\"] --> B{Is it?}\nB -->|yes| C(( End ))\nstyle A fill:#f9f\n```": "Start here Is it? yes End", "flowchart A[one] B[two]": "one two", "graph paper [x]": "graph paper [x]", "A->B": "",
        "graph LR [a \"b\" c] (ok)": "ok", "": "", None: "",
    }
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(told)], "n int, t string").select("n", X.asset_text(F.col("t")).alias("x")).orderBy("n").collect()
    assert [r.x for r in rows] == list(told.values())
    signals = {
        "<table><thead><tr><th>A</th><th a='b'>B <b>c</b></th></tr></thead><TR><td>d</td><td></td></TR><tr><td> </td><td>e\nf</td><td>g</td></tr><tr><td>A</td></tr></table>": "A | B c | d | e f", "<tr><td>open": "", "<tr><td>x</td>": "",
        "<tr>no cell</tr><tr><td>y</td></tr>": "y", "no table": "", None: "",
    }
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(signals)], "n int, t string").select("n", X.table_signal(F.col("t")).alias("x")).orderBy("n").collect()
    assert [r.x for r in rows] == list(signals.values())
