"""Substring deduplication by a log-structured index of window fingerprints.

Words covered by a window of WINDOW words that also starts elsewhere are removed. Two levels of
fingerprints keep the index small:

1. Of each window only its anchor, the smallest hash of the runs of GRAM words in it, is indexed: equal
   windows have equal anchors, and an anchor serves about eight windows.
2. Windows with a repeated anchor are verified by 64-bit hashes of all their words, of another base
   than the anchors', which go to an index of their own. So two windows count as equal on 128 bits.

An index is a folder with a manifest and immutable runs, each sorted within its buckets (ranges of hash
values). A new batch is merge-joined, bucket by bucket, with the runs that are there. In the same pass
blocks are told which of their hashes are repeated, those of the batch and those of the history whose hash
came once so far, and the batch becomes a run, or is merged with all of them into one where there would be
over FANOUT. A hash that many documents share is one entry for each block and portion, so no task gets more of it than these.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, byte_view, column, dropped, file_system, free_names, mapped, slices, written
from larkspur.llm.unigram import words_of

WINDOW = 35
GRAM = 20
#: Rows of the input that make up a block: what is known of a block's repeats is read at once.
BLOCK_ROWS = 4096
#: Batches that a table is taken in, and runs that an index holds before they are merged.
BATCHES, FANOUT = 3, 1
#: Hashes that a worker collects before it hands them on, and bytes of text for each bucket.
PORTION, BUCKET_BYTES = 1 << 19, 64 << 20
RUN = "bucket int, fresh boolean, hashes binary, multi binary, owners binary, blocks binary"
MERGED = "kind int, bucket int, block long, hashes binary, multi binary, owners binary, blocks binary"
TOLD, KEPT = 0, 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their order."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of each `size` words in a row; made of parts of doubled lengths."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    part, length, out, done = words, 1, None, 0
    while True:
        if size & length:
            if out is None:
                out, done = part, length
            else:  # the part follows what is done
                n = len(words) - done - length + 1
                out = out[:n] * np.uint64(pow(base, length, 1 << 64)) + part[done : done + n]
                done += length
        if done == size:
            return mixed(out)
        n = len(part) - length
        part = part[:n] * np.uint64(pow(base, length, 1 << 64)) + part[length : length + n]
        length *= 2


class Windows:
    """The windows of a slice of texts: starts (places in the slice's words), anchors, and on call their hashes."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        buf, offsets = byte_view(texts)
        if len(buf):
            runs, self.first = words_of(buf, offsets)
            each = np.array([xxhash.xxh3_64_intdigest(w) for w in runs.dictionary.to_pylist()], np.uint64)
            self.words = each[runs.indices.to_numpy()] if len(each) else np.zeros(0, np.uint64)
        else:
            self.words, self.first = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        n = len(self.words)
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        self.starts = np.flatnonzero(room >= window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Each window's anchor, and the hashes at all places that are some window's anchor."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        grams = rolling(self.words, self.gram, _BASES[0])
        span = self.window - self.gram + 1
        low, width = grams, 1
        while width * 2 <= span:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        low = np.minimum(low[: len(grams) - span + 1], low[span - width : span - width + len(grams) - span + 1])[self.starts]
        chosen = np.zeros(len(grams), bool)
        for d in range(span):
            at = self.starts + d
            chosen[at[grams[at] == low]] = True
        return low, grams[chosen]

    def hashes(self) -> np.ndarray:
        return rolling(self.words, self.window, _BASES[1])[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """For each word whether a window of those (a mask of starts) covers it."""
        steps = np.zeros(len(self.words) + 1, np.int32)
        at = self.starts[repeated]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + self.window, -1)
        return np.cumsum(steps[:-1]) > 0


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.searchsorted(known, values).clip(max=len(known) - 1)] == values


def _blocks(batches, block: str, text: str = "text", most: int = 4 << 20):
    """(block, rows, texts) of rows that stand together."""
    for batch in batches:
        ids = batch.column(block).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            for rows, texts in slices(batch.slice(a, b - a), text, most):
                yield int(ids[a]), rows, texts


class Entries:
    """Hashes with their blocks, handed on as rows of a run, a row per bucket."""

    def __init__(self, buckets: int, fresh: bool | None = True):
        self.buckets, self.fresh = buckets, fresh
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, hashes: np.ndarray, block: int) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        if len(values):
            self.parts.append((values, counts > 1, np.full(len(values), block)))
            self.held += len(values)

    def rows(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        values, multi, owner = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(values, kind="stable")
        values, multi, owner = values[order], multi[order], owner[order]
        bucket = ((values >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        own, starts = np.unique(bucket, return_index=True)
        packed = [packed_entries(values[a:b], multi[a:b], owner[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)])]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([self.fresh] * len(own)), *(pa.array(c, pa.binary()) for c in zip(*packed, strict=True))], ["bucket", "fresh", "hashes", "multi", "owners", "blocks"])


def packed_entries(values: np.ndarray, multi: np.ndarray, owner: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    blocks, at = np.unique(owner, return_inverse=True)
    return values.tobytes(), multi.astype(np.uint8).tobytes(), at.astype("<u4").tobytes(), blocks.astype("<i8").tobytes()


def _merge(compact: bool, keep: bool):
    """Merge-join of a bucket's fresh entries with those of the runs: what blocks are told, and the bucket of the new run."""

    def run(table: pa.Table) -> pa.Table:
        fresh = np.array(table.column("fresh").to_pylist(), bool)
        order = np.argsort(fresh, kind="stable").tolist()  # the history first
        columns = [table.column(c).to_pylist() for c in ("hashes", "multi", "owners", "blocks")]
        hashes, multi, owners, blocks = ([c[n] for n in order] for c in columns)
        values = np.frombuffer(b"".join(hashes), np.uint64)
        counts = 1 + np.frombuffer(b"".join(multi), np.uint8).astype(np.int64)
        owner = np.concatenate([np.frombuffer(b, "<i8")[np.frombuffer(o, "<u4")] for o, b in zip(owners, blocks, strict=True)])
        new = np.repeat(fresh[order], [len(h) // 8 for h in hashes])
        order = np.argsort(values, kind="stable")
        values, counts, owner, new = values[order], counts[order], owner[order], new[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
        total, before = np.add.reduceat(counts, starts), np.add.reduceat(np.where(new, 0, counts), starts)
        told = np.flatnonzero((total[group] > 1) & (new | (before[group] == 1)))
        told = told[np.argsort(owner[told], kind="stable")]
        whom, at = np.unique(owner[told], return_index=True)
        out = [(TOLD, 0, b, values[told[i:j]].tobytes(), None, None, None) for b, i, j in zip(whom.tolist(), at.tolist(), [*at[1:].tolist(), len(told)])]
        if keep:
            first = starts if compact else starts + np.add.reduceat((~new).astype(np.int64), starts)
            stays = np.ones(len(starts), bool) if compact else np.add.reduceat(new.astype(np.int64), starts) > 0
            first, more = first[stays], (total > 1)[stays]
            if len(first):
                out.append((KEPT, table.column("bucket")[0].as_py(), None, *packed_entries(values[first], more, owner[first])))
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[n] for r in out], k) for n, k in enumerate(kinds)], names=["kind", "bucket", "block", "hashes", "multi", "owners", "blocks"])

    return run


class Told:
    """What blocks were told: their repeated hashes, from files sorted by block."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files
        self.block, self.hashes = None, np.zeros(0, np.uint64)

    def of(self, block: int) -> np.ndarray:
        if block != self.block:
            parts = []
            for uri, low, high in self.files:
                if low <= block <= high:
                    parts += self._read(uri, block)
            self.block, self.hashes = block, np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        return self.hashes

    @staticmethod
    def _read(uri: str, block: int) -> list[np.ndarray]:
        """Only the row groups that may hold the block, one after another."""
        fs, path = file_system(uri)
        out = []
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            at = file.schema_arrow.get_field_index("block")
            for n in range(file.num_row_groups):
                span = file.metadata.row_group(n).column(at).statistics
                if span is None or span.min <= block <= span.max:
                    rows = file.read_row_group(n, columns=["block", "hashes"], use_threads=False)
                    out += [np.frombuffer(x, np.uint64) for x in rows.filter(pc.equal(rows.column("block"), block)).column("hashes").to_pylist()]
        return out


class FingerprintIndex:
    """A folder of runs. Its state is what the manifest says, so a batch that failed leaves it as it was."""

    def __init__(self, spark: SparkSession, folder: str, state: dict, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.runs: list[str] = state.get("runs", [])
        self.joins, self.compactions, self.batches = (state.get(k, 0) for k in ("joins", "compactions", "batches"))

    def state(self) -> dict:
        return {"runs": self.runs, "joins": self.joins, "compactions": self.compactions, "batches": self.batches}

    def ingest(self, fresh: DataFrame, keep: bool = True) -> list[tuple[str, int, int]]:
        """Joins a batch's entries (RUN) with the history and adds them as a run, unless nothing follows; the files (uri, first and last block) of what blocks were told."""
        rows, compact = fresh, keep and bool(self.runs) and len(self.runs) + 1 > self.fanout
        for path in self.runs:
            run = self.spark.read.schema(MERGED).parquet(path).filter(F.col("kind") == KEPT)
            rows = rows.unionByName(run.select("bucket", F.lit(False).alias("fresh"), "hashes", "multi", "owners", "blocks"))
        path = f"{self.folder}/run-{self.batches:06d}"
        rows.groupBy("bucket").applyInArrow(_merge(compact, keep), MERGED).write.mode("overwrite").parquet(path)
        self.joins, self.compactions, self.batches = self.joins + bool(self.runs), self.compactions + compact, self.batches + 1
        gone = self.runs if compact else []
        self.runs = [*([] if compact else self.runs), *([path] if keep else [])]
        told, folder = self.spark.read.schema(MERGED).parquet(path).filter(F.col("kind") == TOLD).select("block", "hashes"), f"{path}-told"
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # small row groups, as a block is read by itself
        told.repartitionByRange(n, "block").sortWithinPartitions("block").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(folder)
        for old in gone if keep else [path]:
            dropped(self.spark, old)
        span = self.spark.read.schema("block long, hashes binary").parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min("block").alias("low"), F.max("block").alias("high"))
        return [(f"{folder}/{r.name}", r.low, r.high) for r in span.collect()]  # a row per file


class SubstringIndex:
    """A folder with the texts of all batches in blocks, an index of anchors, one of windows, and a manifest.

    A folder may be opened again: a later batch is held against all earlier ones.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, block_rows: int = BLOCK_ROWS):
        if not 0 < gram < window:
            raise ValueError("a gram is shorter than a window")
        self.spark, self.folder, self.window, self.gram = spark, folder, window, gram
        self.log = block_rows.bit_length() - 1
        state = self._read()
        if state and (state["window"], state["gram"]) != (window, gram):
            raise ValueError("the index was made for other windows")
        self.buckets, self.texts, self.block = state.get("buckets", 0), state.get("texts", []), state.get("block", "")
        self.told = [[tuple(f) for f in files] for files in state.get("told", [])]
        self.anchors = FingerprintIndex(spark, f"{folder}/anchors", state.get("anchors", {}), fanout)
        self.windows = FingerprintIndex(spark, f"{folder}/windows", state.get("windows", {}), fanout)

    def _read(self) -> dict:
        found = self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).collect() if self._there() else []
        return json.loads(found[0].value) if found else {}

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest.json")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _write(self) -> None:
        state = {"window": self.window, "gram": self.gram, "buckets": self.buckets, "texts": self.texts, "block": self.block, "told": self.told, "anchors": self.anchors.state(), "windows": self.windows.state()}
        written(f"{self.folder}/manifest.json", json.dumps(state).encode())

    def add(self, docs: DataFrame, batches: int = BATCHES, last: bool = False) -> int:
        """Takes docs (with text) in so many batches; the number of the first. last: nothing will follow, so the last batch becomes no run."""
        first = len(self.texts)
        self.block = self.block or free_names(docs, "block")[0]
        (batch,) = free_names(docs, "batch")
        text = F.col("text") if docs.schema["text"].dataType == T.StringType() else F.col("text").cast("string")
        number = F.shiftright(F.monotonically_increasing_id(), self.log)
        # written once: a row's block is the same in each of the passes
        path = f"{self.folder}/texts-{first:06d}"
        docs = docs.withColumns({"text": text, self.block: number}).withColumns({batch: F.pmod(self.block, F.lit(batches)), self.block: F.col(self.block) + F.lit(first << 44)})
        docs.write.mode("overwrite").partitionBy(batch).parquet(path)
        schema = T.StructType([f for f in docs.schema.fields if f.name != batch]).json()
        if not self.buckets:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            size = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
            self.buckets = max(64, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
        for n in range(batches):
            self.texts.append([f"{path}/{batch}={n}", schema])
            self._ingest(len(self.texts) - 1, keep=not last or n + 1 < batches)
            self._write()
        return first

    def _texts(self, numbers, *names: str) -> DataFrame:
        """Those batches' rows; a batch that got none has no folder."""
        out = None
        for n in numbers:
            path, schema = self.texts[n]
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            kind = T.StructType.fromJson(json.loads(schema))
            there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
            rows = self.spark.read.schema(kind).parquet(path) if there else self.spark.createDataFrame([], kind)
            rows = rows.select(*map(column, names)) if names else rows
            out = rows if out is None else out.unionByName(rows)
        return out

    def _ingest(self, number: int, keep: bool) -> None:
        window, gram, buckets, block = self.window, self.gram, self.buckets, self.block

        def entries(hashes):
            def run(source):
                out = Entries(buckets)
                for own, _, texts in _blocks(source, block):
                    out.add(hashes(own, texts), own)
                    if out.held > PORTION:
                        yield out.rows()
                if out.held:
                    yield out.rows()

            return run

        fresh = self._texts([number], block, "text").mapInArrow(entries(lambda _, texts: Windows(texts, window, gram).anchors()[1]), RUN)
        files = self.anchors.ingest(fresh, keep)
        known: list[Told] = []

        def candidates(own, texts):
            if not known:
                known.append(Told(files))
            repeated = known[0].of(own)
            if not len(repeated):
                return np.zeros(0, np.uint64)
            w = Windows(texts, window, gram)
            return w.hashes()[_in(w.anchors()[0], repeated)]

        # windows of this batch, and those of earlier ones whose anchor is repeated since now
        self.told.append(self.windows.ingest(self._texts(range(number + 1), block, "text").mapInArrow(entries(candidates), RUN), keep))

    def cleaned(self, first: int, words: str, removed: str, kept: str) -> DataFrame:
        """The rows of the batches from `first` on, with their number of words, of removed words, and the kept words joined by one space."""
        files, window, gram, block = [f for told in self.told[first:] for f in told], self.window, self.gram, self.block
        source = self._texts(range(first, len(self.texts)))

        def clean(batches):
            known = Told(files)
            for own, rows, texts in _blocks(batches, block):
                names = [c for c in rows.schema.names if c != block]
                w = Windows(texts, window, gram)
                gone = w.covered(_in(w.hashes(), known.of(own)))
                sums = np.concatenate([[0], np.cumsum(gone)])
                n_removed = sums[w.first[1:]] - sums[w.first[:-1]]
                out = []
                for text, n, a, b in zip(texts.to_pylist(), n_removed.tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    own_words = text.split()
                    out.append(b" ".join(own_words if not n else [own_words[i] for i in np.flatnonzero(~gone[a:b]).tolist()]).decode())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(np.diff(w.first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], [*names, words, removed, kept])

        added = [T.StructField(words, T.LongType()), T.StructField(removed, T.LongType()), T.StructField(kept, T.StringType())]
        return mapped(source, clean, added, (block,))


def _removed(docs: DataFrame, names: list[str], batches: int, index: str | None, options: dict) -> DataFrame:
    """docs with the columns `names` of SubstringIndex.cleaned. Without a folder the index is a temporary one."""
    scratch = Scratch(docs.sparkSession)
    held = SubstringIndex(docs.sparkSession, index or scratch.path("index"), **options)
    first = held.add(docs, batches, last=index is None)
    if index is None:
        for path in (held.anchors.folder, *held.windows.runs):
            dropped(docs.sparkSession, path)
        scratch.drop(held.folder)
    return held.cleaned(first, *names)


def substring_report(docs: DataFrame, batches: int = BATCHES, index: str | None = None, **options) -> DataFrame:
    """docs (doc_id, text; more columns are left out) -> doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Null and empty texts have no words; repeated rows repeat each other's windows, so both lose them; null and equal ids
    don't matter. A window lies in one document; a text of any length is read whole. No rows, no result rows. index: a folder to keep
    or to go on with, where windows of earlier calls count too. gram < window.
    """
    return _removed(docs.select("doc_id", "text"), ["n_words", "n_removed", "kept_text"], batches, index, options)


def strip_repeats(docs: DataFrame, batches: int = BATCHES, index: str | None = None, **options) -> DataFrame:
    """docs with the kept text; a text that loses nothing stays as it is, null and empty ones too; one that loses all its words is left out.

    All columns stay, whatever their names; an n_chars is the new text's. Else as substring_report.
    """
    words, removed, kept = names = free_names(docs, "words", "removed", "kept")
    out = _removed(docs, names, batches, index, options)
    out = out.filter((F.col(removed) == 0) | (F.col(removed) < F.col(words))).withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*map(column, docs.columns))
