"""PNG images of eight bits a channel, as rasters; each file is decoded by a task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarn.plans.state import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of the colour types: grey, RGB, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Bytes indexed [row, column, channel]. Interlaced and palette images raise."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only plain images of eight bits a channel can be read")
    w, h, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    out, above = np.empty((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for k in range(h):
        out[k] = above = _unfilter(int(rows[k, 0]), rows[k, 1:], above, n)
    return out.reshape(h, w, n)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    raw, up, out = row.tolist(), above.tolist(), [0] * len(row)
    for i, x in enumerate(raw):
        left, b = (out[i - n] if i >= n else 0), up[i]
        if kind == 3:
            guess = (left + b) // 2
        else:  # whichever of left, above and upper left is nearest to their plane, in this order
            corner = up[i - n] if i >= n else 0
            plane = left + b - corner
            guess = min((left, b, corner), key=lambda v: abs(plane - v))
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def write_png(path: str, values: np.ndarray) -> None:
    """Bytes indexed [x, y, channel] with three channels."""
    w, h, _ = values.shape
    rows = np.concatenate((np.zeros((h, 1), np.uint8), np.ascontiguousarray(values.transpose(1, 0, 2)).reshape(h, -1)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    with open(path, "wb") as f:
        f.write(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))


def read_red(spark: SparkSession, path: str) -> DataFrame:
    """file, n, x, y, h: the first channel over 255, as fields like uplift are painted; n counts along y first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                red = decode_png(content.as_py())[:, :, 0].T
                x, y = (a.ravel().astype(np.int32) for a in np.indices(red.shape))
                n = x.astype(np.int64) * red.shape[1] + y
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(n), pa.array(x), pa.array(y), pa.array(red.ravel() / 255.0)], names=["file", "n", "x", "y", "h"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, n long, x int, y int, h double")
