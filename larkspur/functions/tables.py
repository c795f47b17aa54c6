"""Table functions for SQL: parsed blocks and workbook cells as rows of a LATERAL join."""

from __future__ import annotations

import json as js

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: The fields of a block, and where their values come from: the first name that has one.
BLOCK_FIELDS = {
    "idx": IntegerType(), "kind": StringType(), "text": StringType(), "text_level": IntegerType(), "page": IntegerType(), "bbox": ArrayType(DoubleType()), "list_items": ArrayType(StringType()), "caption": StringType(), "footnote": StringType(),
    "table_body": StringType(), "asset_content": StringType(), "sub_type": StringType(), "image_path": StringType(),
}
SOURCES = {"caption": ("table_caption", "image_caption", "chart_caption"), "footnote": ("table_footnote", "image_footnote", "chart_footnote"), "image_path": ("img_path",)}


def _line(value) -> str | None:
    """A caption that is a text or a list of texts."""
    return " ".join(map(str, value)) if isinstance(value, list) else str(value) if value else None


def block_row(number: int, block: dict) -> dict:
    first = lambda names: next((block[n] for n in names if block.get(n)), None)
    kind = block.get("type") or "text"
    bbox = block.get("bbox")
    return {
        "idx": number, "kind": kind, "page": block.get("page_idx") or 0, "bbox": [float(x) for x in bbox] if bbox else None, "asset_content": block.get("content") if kind in ("image", "chart") else None,
        **{k: _line(first(v)) for k, v in SOURCES.items()}, **{k: block.get(k) for k in ("text", "text_level", "list_items", "table_body", "sub_type")},
    }


class ContentBlocks:
    """content_blocks(json [, fields]): a row for each block of a parsed document's list; fields, a constant such as 'idx, text', says which columns."""

    @staticmethod
    def analyze(json: AnalyzeArgument, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = list(BLOCK_FIELDS) if fields is None else [x.strip() for x in (fields.value or "").split(",")]
        if fields is not None and not fields.isConstantExpression:
            raise ValueError("the fields of content_blocks are a constant")
        unknown = [n for n in names if n not in BLOCK_FIELDS]
        if unknown:
            raise ValueError(f"content_blocks has no field {', '.join(unknown)}")
        schema = StructType()
        for n in names:
            schema = schema.add(n, BLOCK_FIELDS[n])
        return AnalyzeResult(schema=schema)

    def eval(self, json, fields=None):
        names = list(BLOCK_FIELDS) if fields is None else [x.strip() for x in fields.split(",")]
        try:
            blocks = js.loads(json) if json else []
        except ValueError:
            blocks = []
        for number, block in enumerate(blocks if isinstance(blocks, list) else []):
            row = block_row(number, block if isinstance(block, dict) else {})
            yield tuple(row[n] for n in names)


class WorkbookCells:
    """workbook_cells(content): sheet, row, col, value (text) and vtype of a workbook's cells; what is no workbook has none."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType().add("sheet", StringType()).add("row", IntegerType()).add("col", IntegerType()).add("value", StringType()).add("vtype", StringType())
        return AnalyzeResult(schema=schema)

    def eval(self, content):
        import zipfile

        from larkspur.sources.readers import sheet_rows

        try:
            yield from sheet_rows(bytes(content)) if content is not None else []
        except (zipfile.BadZipFile, KeyError):
            return


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("content_blocks", udtf(ContentBlocks))
    spark.udtf.register("workbook_cells", udtf(WorkbookCells))
