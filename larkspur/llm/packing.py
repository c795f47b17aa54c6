"""Bounded-space online packing of token ids into fixed-length sequences.

Each partition keeps a fixed number of open windows. A document's full lengths leave at once, its
rest goes to the open window that it fits best; if none can hold it, the fullest is topped up with
its head and emitted. The windows left open meet in small groups, level by level, until one is left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import slices, staged
from larkspur.llm.tokens import tokenizer

PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"
#: Partitions whose leftovers one task merges: bounds a task to MERGE x open windows.
MERGE = 8


class Packer:
    """Pieces are (row, start, ids, doc_tokens); next_id gives the windows' numbers."""

    def __init__(self, length: int, windows: int, next_id: Callable[[], int]):
        self.length, self.windows, self.next_id = length, windows, next_id
        self.open: list[list] = []  # [used, sequence_id, pieces]

    def place(self, row, ids: np.ndarray, total: int, start: int = 0):
        """Yields each window that gets full or has to go."""
        while len(ids) >= self.length:
            yield [self.length, self.next_id(), [(row, start, ids[: self.length], total)]]
            ids, start = ids[self.length :], start + self.length
        while len(ids):
            fits = [w for w in self.open if self.length - w[0] >= len(ids)]
            if fits:
                best = max(fits, key=lambda w: w[0])
                head = len(ids)
            elif len(self.open) < self.windows:
                best, head = [0, self.next_id(), []], len(ids)
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                head = self.length - best[0]
            best[2].append((row, start, ids[:head], total))
            best[0] += head
            ids, start = ids[head:], start + head
            if best[0] == self.length:
                self.open.remove(best)
                yield best


def _rows(windows: list[list], part: int, is_open: bool, schema: pa.Schema) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in schema]
    for _, sequence, pieces in windows:
        offset = 0
        for row, start, ids, total in pieces:
            for col, value in zip(cols, (row, start, len(ids), ids.tobytes(), total, sequence, offset, part, is_open), strict=True):
                col.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _schema(doc_id: pa.DataType) -> pa.Schema:
    kinds = [doc_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.schema(list(zip(("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part", "open"), kinds, strict=True)))


def _counter(level: int, part: int) -> Callable[[], int]:
    """Sequence numbers: level, partition and count, so none comes twice and a task run again gives the same."""
    n = (level << 58) + (part << 26) - 1

    def following() -> int:
        nonlocal n
        n += 1
        return n

    return following


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, windows: int = 16, style: str = "byte", project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs (doc_id, text; more columns are left out) -> a row per piece: doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, part, open.

    project may derive further columns from ids and drop ids of closed windows before they are written.
    A null or empty text is its end id alone; a text of any length is cut into pieces; equal texts, repeated rows and null ids are packed like others, each by itself; no rows, no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        part = TaskContext.get().partitionId()
        tok, packer, schema = tokenizer(path, style), Packer(length, windows, _counter(0, part)), None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("doc_id").type)
            for rows, texts in slices(batch):
                ids, counts = tok.encode(texts)
                ends, full = np.cumsum(counts), []
                for doc, end, n in zip(rows.column("doc_id").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                    own = np.append(ids[end - n : end], np.uint32(end_id))
                    full += packer.place(doc, own, n + 1)
                    if len(full) > 500:
                        yield _rows(full, part, False, schema)
                        full = []
                yield _rows(full, part, False, schema)
        if schema:
            yield _rows(packer.open, part, True, schema)

    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pack, PIECES.format(id=kind))
    pieces = staged(project(pieces) if project else pieces, "pieces")
    return merge_leftovers(pieces, length)


def _merger(length: int, level: int, last: bool):
    def merge(table):
        schema = _schema(table.schema.field("doc_id").type)
        if not table.num_rows:
            return schema.empty_table()
        part = table.column("part")[0].as_py() // MERGE
        packer = Packer(length, 1, _counter(level, part))
        order = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        full: list[list] = []
        for doc, start, ids, total in zip(*(order.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            full += packer.place(doc, np.frombuffer(ids, np.uint32), total, start)
        return pa.Table.from_batches([_rows(full, part, False, schema), _rows(packer.open, part, not last, schema)])

    return merge


def merge_leftovers(pieces: DataFrame, length: int) -> DataFrame:
    """Fills the open windows from each other. MERGE partitions meet in a task, then MERGE of those groups, until a group is alone; each leaves one window unfilled. A level's pieces are written before the next."""
    schema_text = PIECES.format(id=pieces.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema_text.split(", ")]
    most = pieces.agg(F.max("part")).first()[0]
    done, rest, level = pieces.filter("not open"), pieces.filter("open").select(*names), 1
    while most is not None:
        most //= MERGE
        merged = staged(rest.groupBy((F.col("part") / MERGE).cast("long")).applyInArrow(_merger(length, level, most == 0), schema_text), "merged")
        done = done.unionByName(merged.filter("not open"), allowMissingColumns=True)
        rest = merged.filter("open")
        if most == 0:
            break
        level += 1
    return done
