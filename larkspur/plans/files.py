"""Queries over office files that Spark makes from documents and reads again, table functions, counted writes, unspaced text."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from larkspur.plans.base import ORACLE_SQL, query, table
from larkspur.plans import shaping  # noqa: F401  its SQL is used here
from larkspur.sources.office import elements_of

ALTS = ["IMG_001.png", "Map of the river valley"]


def word_file(lines: list[str]) -> bytes:
    """Lines as a Word document: headings, content controls, tables with a cell over two columns, text boxes in two copies, pictures."""
    paragraph = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    box = lambda text: f"<w:txbxContent>{paragraph(text)}</w:txbxContent>"
    forms = [
        lambda n, t: paragraph(t, f"Heading{1 + n % 3}"),
        lambda n, t: f"<w:sdt><w:sdtPr/><w:sdtContent>{paragraph(t)}</w:sdtContent></w:sdt>",
        lambda n, t: f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{paragraph(t)}</w:tc></w:tr></w:tbl>',
        lambda n, t: f"<w:p><w:r><m:AlternateContent><m:Choice><w:drawing>{box(t)}</w:drawing></m:Choice><m:Fallback><w:pict>{box(t)}</w:pict></m:Fallback></m:AlternateContent></w:r></w:p>",
        lambda n, t: f'<w:p><w:r><w:drawing><d:docPr descr="{ALTS[n % 2]}"/><d:blip/></w:drawing></w:r></w:p>',
    ]
    body = "".join(forms[n % 5](n, t) for n, t in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w" xmlns:m="m" xmlns:d="d"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, t FROM (SELECT doc_id, i, trim(regexp_replace(t, '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM l) WHERE t <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n % 5, t ORDER BY n) AS copy FROM m)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS idx, ['text', 'text', 'table', 'text', 'image'][(n % 5 + 1)::INT] AS kind, CASE WHEN n % 5 = 0 THEN 1 + n % 3 END::INT AS text_level,
  CASE n % 5 WHEN 4 THEN CASE WHEN n % 2 = 1 THEN 'Map of the river valley' END WHEN 2 THEN md5('<table><tr><td>' || t || '</td><td>' || t || '</td></tr></table>') ELSE md5(t) END AS held
FROM k WHERE n % 5 <> 3 OR copy = 1""")
def office_elements(spark, sf):
    """Each document as a Word file, read back; held is a picture's caption or a digest of the text or table."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))), lambda t: t != "")

    def files(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"name": [f"{i}.docx" for i in pdf["doc_id"]], "content": [word_file(list(x)) for x in pdf["lines"]]})

    made = table(spark, sf, "documents").select("doc_id", F.coalesce(lines, F.array().cast("array<string>")).alias("lines")).mapInPandas(files, "name string, content binary")
    held = F.when(F.col("kind") == "image", F.col("caption")).otherwise(F.md5(F.coalesce("table_body", "text")))
    return elements_of(made).select(F.substring_index("doc_id", ".", 1).cast("long").alias("doc_id"), "idx", "kind", "text_level", held.alias("held"))


@query(ORACLE_SQL["content_list_elements"])
def content_blocks_lateral(spark, sf):
    """content_list_elements by the table function, from SQL; one caption is a list, as parsers write it, and the other could be a text."""
    from larkspur.functions.tables import register

    register(spark)
    d = table(spark, sf, "documents")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text", F.lit(0).alias("page_idx"), F.lit(None).cast("string").alias("image_caption")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("page_idx"), F.concat(F.lit("cap "), "lang").alias("image_caption"))))
    sql = "SELECT d.doc_id, b.idx, b.kind, md5(b.text) AS text, coalesce(b.caption, '') AS caption, b.page FROM {d} d, LATERAL content_blocks(d.json, 'idx, kind, text, caption, page') b"
    return spark.sql(sql, d=d.select("doc_id", blocks.alias("json")))


@query("SELECT count(*) FILTER (WHERE image) AS images, count(*) FILTER (WHERE NOT image AND t <> '') AS texts, count(*) FILTER (WHERE NOT image AND t = '') AS skipped, count(*) FILTER (WHERE image OR t <> '') AS indexed FROM (SELECT n_chars % 7 = 0 AS image, trim(regexp_replace(string_split(text, chr(10))[1], '[^a-m ]', '', 'g')) AS t FROM documents)")
def counted_write(spark, sf):
    """Chunks of each document's first line, written once; the counts are taken in that pass and held against the files."""
    from larkspur.session import shared_dir
    from larkspur.sources.index import write_counted

    line = F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), "[^a-m ]", "")
    chunks = table(spark, sf, "documents").select("doc_id", line.alias("text"), F.when(F.col("n_chars") % 7 == 0, "img/a.png").alias("image_path"))
    told = write_counted(chunks, f"{shared_dir(spark)}/larkspur-counted-{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


@query("SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, p_partkey) AS words FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def unspaced_words(spark, sf):
    """The names of an order's parts, written without spaces, in words again; the dictionary is the parts' words with their counts."""
    from larkspur.operators.segment import segmented

    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    dictionary = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    names = li.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_name"))).alias("n"))
    orders = names.select("l_orderkey", F.replace(F.array_join(F.transform("n", lambda x: x["p_name"]), ""), F.lit(" "), F.lit("")).alias("run"))
    return orders.join(segmented(orders.select("run").distinct(), dictionary), "run").select("l_orderkey", F.array_join("words", " ").alias("words"))
