"""PNG in binary columns: zlib chunks with checksum tests, numpy unfiltering, cosine-transform hashes.

A payload becomes an 8-bit grey image SIDE pixels wide. The reader takes 8-bit grey, grey-alpha, RGB
and RGBA images without interlacing, tests each chunk's CRC-32, and undoes all five row filters.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import mapped, slices

#: The fixed first bytes of a PNG file, and the samples of each colour type.
SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
SIDE = 24
UNIT = SIDE * SIDE
FILL = 255
IDAT = 1 << 16


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data and bytes FILL up to a positive multiple of unit."""
    size = max(1, -(-len(data) // unit)) * unit
    return data + bytes([FILL]) * (size - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = SIDE, channels: int = 1, level: int = 4) -> bytes:
    """A PNG of the payload's samples. All rows get the one of the filters none, sub and up that leaves the least sum of magnitudes."""
    stride = width * channels
    rows = np.frombuffer(payload, np.uint8).reshape(-1, stride)
    sub = rows.copy()
    sub[:, channels:] -= rows[:, :-channels]
    up = rows.copy()
    up[1:] -= rows[:-1]
    costs = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, sub, up)]
    kind = int(np.argmin(costs))
    body = np.empty((len(rows), stride + 1), np.uint8)
    body[:, 0], body[:, 1:] = kind, (rows, sub, up)[kind]
    packed = zlib.compress(body.tobytes(), level)
    colour = {n: k for k, n in CHANNELS.items()}[channels]
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def chunks(media: bytes):
    """(kind, body) of each chunk, each with a right checksum, else ValueError."""
    if media[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG")
    at = len(SIGNATURE)
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("the file ends within a chunk")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body, end = media[at + 8 : at + 8 + size], at + 12 + size
        if end > len(media) or zlib.crc32(kind + body) != struct.unpack(">I", media[end - 4 : end])[0]:
            raise ValueError(f"chunk {kind!r} is broken")
        yield kind, body
        if kind == b"IEND":
            return
        at = end
    raise ValueError("no IEND")


def _row_by_row(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of any filters, in order; only average and Paeth go pixel by pixel."""
    before = np.zeros(rows.shape[1], np.uint8)
    out = np.empty_like(rows)
    for n, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True)):
        if kind == 0:
            own = row
        elif kind == 1:
            own = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            own = row + before
        elif kind in (3, 4):
            line, up = row.tolist(), before.tolist()
            for i in range(len(line)):
                a, b, c = (line[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = sorted((abs(x - (a + b - c)), k, x) for k, x in enumerate((a, b, c)))
                    guess = near[0][2]
                line[i] = (line[i] + guess) & 255
            own = np.array(line, np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        out[n] = before = own
    return out


def unfilter(body: bytes, height: int, stride: int, step: int) -> np.ndarray:
    table = np.frombuffer(body, np.uint8)
    if len(table) != height * (stride + 1):
        raise ValueError("the image has not its size")
    table = table.reshape(height, stride + 1)
    kinds, rows = table[:, 0], table[:, 1:]
    one = kinds[0] if height and (kinds == kinds[0]).all() else None
    if one == 0:
        return rows.copy()
    if one == 1:
        return np.cumsum(rows.reshape(height, -1, step), axis=1, dtype=np.uint8).reshape(height, stride)
    if one == 2:
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    return _row_by_row(kinds, rows, step)


def decode(media: bytes) -> np.ndarray:
    """The samples, height x width x channels."""
    head, packed = None, []
    for kind, body in chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind[:1].isupper() and kind not in (b"PLTE", b"IEND"):
            raise ValueError(f"chunk {kind!r} is not known")
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise ValueError("only 8-bit images without palette or interlacing")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    return unfilter(zlib.decompress(b"".join(packed)), height, width * step, step).reshape(height, width, step)


def _cosines(size: int, count: int) -> np.ndarray:
    k, n = np.arange(count)[:, None], np.arange(size)[None]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * size))


_LOW = _cosines(SIDE, 9)


def low_frequency_hash(image: np.ndarray) -> bytes:
    """8 bytes: the image as SIDE x SIDE mean values; the transform's coefficients 1 to 8 by 1 to 8, above their median or not."""
    grey = image.mean(axis=2) if image.shape[2] > 1 else image[:, :, 0].astype(np.float64)
    for axis in (0, 1):
        size = grey.shape[axis]
        if size % SIDE:
            edges = np.arange(SIDE) * size // SIDE
            grey = np.add.reduceat(grey, edges, axis=axis) / np.diff(np.append(edges, size)).clip(1).reshape((-1, 1) if axis == 0 else (1, -1)) if size > SIDE else np.take(grey, np.arange(SIDE) * size // SIDE, axis=axis)
        elif size > SIDE:
            shape = (SIDE, size // SIDE, grey.shape[1]) if axis == 0 else (grey.shape[0], SIDE, size // SIDE)
            grey = grey.reshape(shape).mean(axis=axis + 1)
    # rounded, so that sums in another order give the same bits
    low = np.round(_LOW @ grey @ _LOW.T, 6)[1:, 1:].reshape(-1)
    return np.packbits(low > np.median(low)).tobytes()


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; more columns are left out) -> doc_id, n_bytes, media (binary).

    A null text is an empty one, which is one unit of FILL; a text of any length is one image; equal texts have equal media;
    repeated rows and null ids stay. No rows, no result rows.
    """

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch):
                raw = texts.to_pylist()
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array([encode(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """stored (media, and any columns but payload and hash) and payload (binary, read back from media) and hash (binary).

    A broken medium raises, a null one has nulls; equal media have equal hashes; repeated rows stay; no rows, no result rows.
    """

    def run(batches):
        for batch in batches:
            media = batch.column("media")
            for at in range(0, len(media), 256):
                part = batch.slice(at, 256)
                images = [None if m is None else decode(m) for m in part.column("media").to_pylist()]
                payloads = pa.array([None if i is None else i.tobytes() for i in images], pa.binary())
                hashes = pa.array([None if i is None else low_frequency_hash(i) for i in images], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, payloads, hashes], [*part.schema.names, "payload", "hash"])

    return mapped(stored, run, [T.StructField("payload", T.BinaryType()), T.StructField("hash", T.BinaryType())])
