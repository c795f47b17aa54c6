"""Token ids in files, each id in the fewest bits that the vocabulary needs.

A file: magic, the packed blocks, then the documents' ids as JSON, their counts (int64), block offsets
(int64, in bytes from the file's start), a JSON header (bits, block, numbers), its length, and the magic again. A block
holds `block` ids, so it starts at a byte's edge where bits x block is a multiple of 8; any id's
place follows from the offsets, and any span of ids is unpacked by itself.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, as_name, file_system, from_name, slices, written
from larkspur.llm.tokens import tokenizer

MAGIC = b"LKBITS1\n"
BLOCK = 4096


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, lowest bit first, one after another; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Writes packed blocks to an open file as they get full; ids come in any portions. Only the documents' names and counts are held."""

    def __init__(self, file, bits: int, block: int = BLOCK):
        self.file, self.bits, self.block = file, bits, block
        self.docs: list = []
        self.counts: list[int] = []
        self.sizes: list[int] = []
        self.rest = np.zeros(0, np.uint32)
        self.tokens = 0
        file.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.file.write(data)
        self.sizes.append(len(data))

    def add(self, docs: list, counts: list[int], ids: np.ndarray) -> None:
        self.docs += docs
        self.counts += counts
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._put(ids[i : i + self.block])
        self.rest = ids[whole:].copy()

    def finish(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        names = json.dumps(self.docs).encode()
        head = json.dumps({"bits": self.bits, "block": self.block, "documents": len(self.docs), "tokens": self.tokens, "names": len(names), "blocks": len(self.sizes)}).encode()
        offsets = np.cumsum([len(MAGIC), *self.sizes]).astype("<i8").tobytes()
        self.file.write(names + np.array(self.counts, "<i8").tobytes() + offsets + head + struct.pack("<I", len(head)) + MAGIC)


class Reader:
    """Random access to an open file: tokens(i, j) reads only the blocks that hold ids i to j - 1."""

    def __init__(self, file):
        self.file = file
        start = file.read(len(MAGIC))
        file.seek(0, 2)
        end = file.tell() - len(MAGIC) - 4
        if start != MAGIC or end < len(MAGIC):
            raise ValueError("not a packed token file")
        file.seek(end)
        size = struct.unpack("<I", file.read(4))[0]
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("the file's end is missing")
        file.seek(end - size)
        head = json.loads(file.read(size))
        self.bits, self.block, self.total = head["bits"], head["block"], head["tokens"]
        counts, offsets = 8 * head["documents"], 8 * (head["blocks"] + 1)
        file.seek(end - size - offsets - counts - head["names"])
        self.docs = json.loads(file.read(head["names"]))
        self.counts = np.frombuffer(file.read(counts), "<i8")
        self.offsets = np.frombuffer(file.read(offsets), "<i8")

    def tokens(self, i: int, j: int) -> np.ndarray:
        if not 0 <= i <= j <= self.total:
            raise IndexError((i, j, self.total))
        if i == j:
            return np.zeros(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        at = [int(x - self.offsets[first]) for x in self.offsets[first : last + 2]]
        parts = [unpack_bits(data[a:b], self.bits, min(self.block, self.total - (first + n) * self.block)) for n, (a, b) in enumerate(zip(at, at[1:]))]
        return np.concatenate(parts)[i - first * self.block : j - first * self.block]

    def document(self, n: int) -> np.ndarray:
        start = int(self.counts[:n].sum())
        return self.tokens(start, start + int(self.counts[n]))


def write_tokens(docs: DataFrame, path: str, vocabulary: int, end_id: int, style: str, folder: str, block: int = BLOCK) -> list[dict]:
    """Writes docs (doc_id of any type, text) in ascending doc_id order (null first; of equal ids the smaller text, null first), a
    file per range of ids and texts; the manifest's rows: file, documents, tokens, start. A null or empty text is its end id alone,
    repeated rows are written each, a text of any length whole. No rows give no file. A file and the manifest have temporary names until they are whole, so a task run again just replaces them."""
    bits = bits_for(vocabulary)

    def write(batches):
        part, writer, out = TaskContext.get().partitionId(), None, None
        tok = tokenizer(path, style)
        for batch in batches:
            for rows, texts in slices(batch):
                if writer is None:
                    fs, root = file_system(folder)
                    fs.create_dir(root, recursive=True)
                    name, temp = f"tokens-{part:08d}.bin", f"{root}/.tmp-{part:08d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp, compression=None)
                    writer = Writer(out, bits, block)
                ids, counts = tok.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                writer.add(rows.column("name").to_pylist(), (counts + 1).tolist(), ids)
        if writer is not None:
            writer.finish()
            out.close()
            fs.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "documents": [len(writer.docs)], "tokens": [writer.tokens]})

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("doc_id").asc_nulls_first()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # rows of one id may be many: ranges part them by how their texts begin
    rows = rows.repartitionByRange(n, first, F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(first, F.col("text").asc_nulls_first())
    done = rows.select(as_name(F.col("doc_id"), docs.schema["doc_id"].dataType).alias("name"), "text").mapInArrow(write, "part long, file string, documents long, tokens long")
    manifest, start = [], 0
    for r in sorted(done.collect()):  # a row per file
        manifest.append(r.asDict() | {"start": start})
        start += r.tokens
    written(f"{folder}/manifest.json", json.dumps({"bits": bits, "block": block, "vocabulary": vocabulary, "files": manifest}).encode())
    return manifest


def read_tokens(spark, manifest: list[dict], folder: str, doc_type=T.LongType()) -> DataFrame:
    """The files' documents: doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit). An empty manifest gives no rows; a document of any length is one row."""

    def read(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    reader = Reader(file)
                    at = 0
                    for i in range(0, len(reader.docs), 256):  # as many documents at once
                        counts = reader.counts[i : i + 256]
                        ids = reader.tokens(at, at + int(counts.sum()))
                        ends = np.cumsum(counts)
                        yield pa.RecordBatch.from_pydict({"name": pa.array(reader.docs[i : i + 256], pa.string()), "start": start + at + ends - counts, "ids": pa.array([ids[b - n : b].astype("<u4").tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())})
                        at += len(ids)

    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(max(1, len(manifest)))
    return files.mapInArrow(read, "name string, start long, ids binary").select(from_name(F.col("name"), doc_type).alias("doc_id"), "start", "ids")


def token_files(docs: DataFrame, path: str, vocabulary: int = 49_408, end_id: int = 2, style: str = "word") -> DataFrame:
    """docs (doc_id, text; more columns are left out) written by write_tokens and read back by read_tokens."""
    scratch = Scratch(docs.sparkSession)
    folder = scratch.path("tokens")
    manifest = write_tokens(docs, path, vocabulary, end_id, style, folder)
    scratch.drop(folder)
    return read_tokens(docs.sparkSession, manifest, folder, docs.schema["doc_id"].dataType)
