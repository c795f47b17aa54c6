"""What the operators share: the shared folder, staged tables, free names, byte views of Arrow text columns."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import shared_dir

#: Bytes of text that numpy handles at once; bounds the memory of a worker.
SLICE_BYTES = 4 << 20
#: The ASCII white space [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}/{name}"


class Scratch:
    """Tables that a step writes to the shared folder and reads again: that cuts the lineage and survives lost executors.

    A step drops what its result doesn't read. What a lazy result reads stays until sweep() is called,
    after the result was used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def stage(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df, written (in folders by that column) and read again."""
        path = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def adopt(self, other: Scratch) -> None:
        self.paths += other.paths

    def drop(self, *keep: DataFrame | str) -> None:
        """Deletes all tables but those."""
        stay = [k if isinstance(k, str) else k._staged for k in keep]
        for path in self.paths:
            if path not in stay:
                dropped(self.spark, path)
        self.paths = stay
        _KEPT.setdefault(self.spark.sparkContext.applicationId, []).extend(stay)


_KEPT: dict[str, list[str]] = {}


def kept(spark: SparkSession) -> int:
    """How many tables results of this application still read."""
    return len(_KEPT.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes what results of this application still read, or those since there were so many. Call it when they were used."""
    held = _KEPT.get(spark.sparkContext.applicationId, [])
    for path in held[since:]:
        dropped(spark, path)
    del held[since:]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, until sweep()."""
    scratch = Scratch(df.sparkSession)
    out = scratch.stage(df, name)
    scratch.drop(out)
    return out


#: Keys with over a MOST_HOTth of all rows are joined by broadcast; there are fewer than MOST_HOT of them.
MOST_HOT = 8192


def joined(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows, joined (inner, left or left_semi) with keyed, which has one row for each key and, in count, how many rows have that key.

    The few keys that hold over a MOST_HOTth of all counted rows are broadcast, so no task gets all rows of a
    hot key; the others are shuffled. Both sides are read twice: stage them where they are dear to make.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * MOST_HOT > F.lit(total)
    keyed, much, few = keyed.drop(count), keyed.filter(hot).drop(count), keyed.filter(~hot).drop(count)
    if how == "left_semi":
        keyed, much, few = (x.select(*on) for x in (keyed, much, few))
    named = F.broadcast(much.select(*on))
    inner = "left_semi" if how == "left_semi" else "inner"
    return rows.join(F.broadcast(much), on, inner).unionByName(rows.join(named, on, "left_anti").join(few, on, how))


def column(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, run, added: list[T.StructField], left_out: tuple[str, ...] = ()) -> DataFrame:
    """df.mapInArrow(run), whose batches have df's columns but those left out, and those that are added. Names with dots, which mapInArrow can't resolve, are others inside."""
    plain = [c if re.fullmatch(r"\w+", c) else free_names(df, f"column{n}")[0] for n, c in enumerate(df.columns)]
    fields = [f for f in df.schema.fields if f.name not in left_out]
    inside = [T.StructField(p, f.dataType) for p, f in zip(plain, df.schema.fields) if f.name not in left_out]
    return df.toDF(*plain).mapInArrow(run, T.StructType([*inside, *added])).toDF(*(f.name for f in [*fields, *added]))


def as_name(id_column, kind):
    """An id of any type as text, from which from_name gets it back."""
    return F.hex(id_column) if kind.simpleString() == "binary" else id_column.cast("string")


def from_name(name, kind):
    return F.unhex(name) if kind.simpleString() == "binary" else name.cast(kind)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those that df has not."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        own = f"_{n}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def file_system(uri: str):
    """(file system, path) of a folder as pyarrow opens it in a task: file, hdfs, viewfs, s3 (also written s3a), gs, abfs and abfss. Others raise."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def written(uri: str, data: bytes) -> None:
    """A file at uri, whole or not at all: written under a temporary name, then renamed."""
    fs, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    temp = f"{folder}/.tmp-{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(data)
    fs.move(temp, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def binary(column) -> pa.Array:
    """An Arrow text column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column.cast(pa.large_binary())


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array and the rows' offsets in them, from 0."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch, each of about most bytes of text, at least a row."""
    text = binary(batch.column(column))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at), text.slice(at, end - at)
        at = end
