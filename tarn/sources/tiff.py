"""TIFF and GeoTIFF files of one channel: a codec for strips and tiles, plain or compressed, and a Spark data source."""

from __future__ import annotations

import io
import math
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tarn.plans.state import ship
from tarn.sources import placed

# Tags of the TIFF 6.0 and GeoTIFF formats, and sizes of their field types: fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, ORIENTATION, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINTS, KEYS, DOUBLES, ASCII, METADATA, NODATA = 33550, 33922, 34735, 34736, 34737, 42112, 42113
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Sample formats: unsigned, signed, floating; bits that each may have.
KINDS = {1: ("u", (8, 16, 32)), 2: ("i", (8, 16, 32)), 3: ("f", (32, 64))}


@dataclass
class Meta:
    """What the header says; `scale` and `coords` place the raster in the world."""

    filename: str = ""
    width: int = 0
    height: int = 0
    bits: int = 32
    gdal_nodata: str = ""
    gdal_metadata: str = ""
    ascii_params: str = ""
    scale: list[float] = field(default_factory=lambda: [1.0, 1.0, 1.0])
    coords: list[float] = field(default_factory=lambda: [0.0] * 6)
    params: list[float] = field(default_factory=list)
    keydir: list[int] = field(default_factory=list)
    blocks: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # x, y, width, height, offset, bytes
    order: str = "<"
    kind: int = 3
    compression: int = PLAIN
    predictor: int = 1

    @property
    def low(self) -> tuple[float, float]:
        return min(self.coords[3], self.coords[3] + self.scale[0] * self.width), min(self.coords[4], self.coords[4] + self.scale[1] * self.height)

    @property
    def high(self) -> tuple[float, float]:
        return max(self.coords[3], self.coords[3] + self.scale[0] * self.width), max(self.coords[4], self.coords[4] + self.scale[1] * self.height)

    def map(self, x: float, y: float) -> tuple[float, float]:
        return self.low[0] + self.scale[0] * x, self.low[1] + self.scale[1] * y

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{KINDS[self.kind][0]}{self.bits // 8}")


def _store(path: str | os.PathLike) -> tuple[pyarrow.fs.FileSystem, str] | None:
    """The store and the path in it of a URI; None for a plain path."""
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", str(path)) else None


def _open(path: str | os.PathLike) -> io.BufferedIOBase:
    """A file that can be read at any place, so blocks are read alone whatever the store."""
    found = _store(path)
    return found[0].open_input_file(found[1]) if found else open(path, "rb")


def peek(path: str | os.PathLike) -> Meta:
    """The header alone. A missing file raises FileNotFoundError; what the codec can't read raises ValueError."""
    with _open(path) as f:
        return _header(f, os.path.basename(path))


def _header(f: io.BufferedIOBase, name: str) -> Meta:
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError(f"{name}: no TIFF file")
    # BigTIFF (43) has eight bytes where the other has four, and a longer count of tags.
    word, wide, count = ("I", 4, "H") if magic == 42 else ("Q", 8, "Q")
    f.seek(struct.unpack(f"{order}{word}", head[4:8] if magic == 42 else head[8:16])[0])
    tags = {}
    for _ in range(struct.unpack(f"{order}{count}", f.read(struct.calcsize(f"{order}{count}")))[0]):
        tag, kind, n = struct.unpack(f"{order}HH{word}", f.read(4 + wide))
        raw = f.read(wide)
        if kind not in TYPES:
            continue
        code, size = TYPES[kind]
        if size * n > wide:
            back = f.tell()
            f.seek(struct.unpack(f"{order}{word}", raw)[0])
            raw = f.read(size * n)
            f.seek(back)
        raw = raw[: size * n]
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else list(struct.unpack(f"{order}{n * len(code)}{code[0]}", raw))
    one = lambda t, d: tags[t][0] if t in tags else d
    m = Meta(name, one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 32), tags.get(NODATA, ""), tags.get(METADATA, ""), tags.get(ASCII, ""), order=order)
    m.kind, m.compression, m.predictor = one(FORMAT, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if one(SAMPLES, 1) != 1 or m.kind not in KINDS or m.bits not in KINDS[m.kind][1]:
        raise ValueError(f"{name}: only one channel of 8 to 32-bit integers or 32 or 64-bit floats can be read")
    if m.compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or m.predictor not in (1, 2, 3):
        raise ValueError(f"{name}: compression {m.compression} with predictor {m.predictor} can't be read")
    if SCALE in tags:
        m.scale = [*tags[SCALE][:2], tags[SCALE][2] or 1.0] if len(tags[SCALE]) > 2 else [*tags[SCALE], 1.0]
    m.coords = (tags.get(TIEPOINTS, []) + [0.0] * 6)[:6]
    m.params, m.keydir = tags.get(DOUBLES, []), tags.get(KEYS, [])
    tiles = TILE_OFFSETS in tags
    offsets = tags.get(TILE_OFFSETS if tiles else STRIP_OFFSETS, [])
    sizes = tags.get(TILE_BYTES if tiles else STRIP_BYTES, [0] * len(offsets))
    if tiles:
        w, h = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
        across = -(-m.width // w)
        m.blocks = [(k % across * w, k // across * h, w, h, o, size) for k, (o, size) in enumerate(zip(offsets, sizes, strict=True))]
    else:
        rows = min(one(ROWS, m.height), m.height)
        m.blocks = [(0, k * rows, m.width, min(rows, m.height - k * rows), o, size) for k, (o, size) in enumerate(zip(offsets, sizes, strict=True))]
    return m


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out, held, have, width, at = [], 0, 0, 9, 0
    table, before = [], b""
    while True:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            held, have, at = (held << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or (code == len(table) and not before):
            raise ValueError("broken LZW data")
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before and len(table) < 4096:
            table.append(before + now[:1])
        # The width grows one code early.
        width = min(12, max(9, (len(table) + 1).bit_length()))
        before = now


def unpack_bits(data: bytes) -> bytes:
    """A count byte, then as many bytes and one, or one byte to repeat."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def _block(f: io.BufferedIOBase, m: Meta, block: tuple[int, int, int, int, int, int]) -> np.ndarray | None:
    """A block's values, row by row, clipped to the image; None if the file doesn't hold it."""
    x, y, w, h, offset, size = block
    whole, each = w * h * m.bits // 8, m.bits // 8
    f.seek(offset)
    if m.compression == PLAIN:
        raw = f.read(whole)
    else:
        raw = f.read(size)
        if len(raw) < size or not size:
            return None
        raw = {LZW: unpack_lzw, PACKBITS: unpack_bits}.get(m.compression, zlib.decompress)(raw)
    if len(raw) < whole:
        return None
    if m.predictor == 3:  # bytes of one rank after the other, each the difference to the one before
        rows = np.cumsum(np.frombuffer(raw[:whole], np.uint8).reshape(h, w * each), axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(rows.reshape(h, each, w).transpose(0, 2, 1)).view(f">{KINDS[m.kind][0]}{each}").reshape(h, w)
    elif m.predictor == 2:
        whole_numbers = np.dtype(f"{m.order}u{each}")
        values = np.cumsum(np.frombuffer(raw[:whole], whole_numbers).reshape(h, w), axis=1, dtype=whole_numbers.newbyteorder("=")).astype(whole_numbers).view(m.dtype)
    else:
        values = np.frombuffer(raw[:whole], m.dtype).reshape(h, w)
    return values[: m.height - y, : m.width - x].astype(np.float64)


def _image(f: io.BufferedIOBase, m: Meta) -> np.ndarray:
    out = np.full((m.width, m.height), np.nan)
    for b in m.blocks:
        if (v := _block(f, m, b)) is not None:
            out[b[0] : b[0] + v.shape[1], b[1] : b[1] + v.shape[0]] = v.T
    if m.gdal_nodata.strip():
        out[out == float(m.gdal_nodata)] = np.nan
    return out


def read_array(path: str) -> tuple[Meta, np.ndarray]:
    """The whole image, indexed [x, y]; no data is NaN."""
    m = peek(path)
    with _open(path) as f:
        return m, _image(f, m)


def _pixels(values: np.ndarray, meta: Meta | None, bits: int) -> bytes:
    """Values indexed [x, y], row by row; NaN becomes the meta's no-data value, if any."""
    values = np.asarray(values, np.float64)
    if meta and meta.gdal_nodata.strip():
        values = np.where(np.isnan(values), float(meta.gdal_nodata), values)
    return np.ascontiguousarray(values.T).astype(f"<f{bits // 8}").tobytes()


def _directory(at: int, w: int, h: int, block: tuple[int, int] | int, offsets: list[int], sizes: list[int], meta: Meta | None, bits: int, compression: int, big: bool = False) -> bytes:
    """The directory of a little-endian file, as it stands at byte `at`, with what doesn't fit into its entries after it.

    block: the rows of a strip, or the width and height of a tile.
    """
    word, wide, number = ("Q", 8, 16) if big else ("I", 4, 4)
    if isinstance(block, int):
        placed = [(STRIP_OFFSETS, number, offsets), (ROWS, 4, [block]), (STRIP_BYTES, number, sizes)]
    else:
        placed = [(TILE_WIDTH, 4, [block[0]]), (TILE_HEIGHT, 4, [block[1]]), (TILE_OFFSETS, number, offsets), (TILE_BYTES, number, sizes)]
    tags: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (ORIENTATION, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]),
        (FORMAT, 3, [3]), *placed,
    ]
    if meta:
        tags += [(SCALE, 12, meta.scale), (TIEPOINTS, 12, meta.coords)]
        tags += [(KEYS, 3, meta.keydir)] * bool(meta.keydir) + [(DOUBLES, 12, meta.params)] * bool(meta.params)
        tags += [(t, 2, v.encode("latin-1") + b"\0") for t, v in ((ASCII, meta.ascii_params), (METADATA, meta.gdal_metadata), (NODATA, meta.gdal_nodata)) if v]
    count = struct.pack("<Q" if big else "<H", len(tags))
    table, extra, free = b"", b"", at + len(count) + (4 + 2 * wide) * len(tags) + wide
    for tag, kind, v in sorted(tags, key=lambda t: t[0]):
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{TYPES[kind][0]}", *v)
        head = struct.pack(f"<HH{word}", tag, kind, len(v))
        if len(raw) > wide:
            table += head + struct.pack(f"<{word}", free + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            table += head + raw.ljust(wide, b"\0")
    return count + table + struct.pack(f"<{word}", 0) + extra


def _start(directory: int, big: bool = False) -> bytes:
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, directory) if big else struct.pack("<2sHI", b"II", 42, directory)


def encode(values: np.ndarray, meta: Meta | None = None, bits: int = 32, compression: int = PLAIN) -> bytes:
    """A little-endian file of one strip from values indexed [x, y], plain or deflated."""
    w, h = np.shape(values)
    pixels = _pixels(values, meta, bits)
    pixels = zlib.compress(pixels) if compression == DEFLATE else pixels
    pixels += b"\0" * (len(pixels) % 2)
    return _start(8 + len(pixels)) + pixels + _directory(8 + len(pixels), w, h, h, [8], [len(pixels)], meta, bits, compression)


def write_array(path: str, values: np.ndarray, meta: Meta | None = None, bits: int = 32) -> None:
    with open(path, "wb") as f:
        f.write(encode(values, meta, bits))


#: Bytes of blocks, or of files, that a task reads; files whose headers the driver reads to plan, beyond which tasks do.
PACK, HEADERS = 32 << 20, 64


def files(path: str, limit: int | None = None) -> list[str]:
    """A file, or the TIFF files of a folder in order of name, at most `limit`; a path or a URI."""
    if found := _store(path):
        if found[0].get_file_info(found[1]).type != pyarrow.fs.FileType.Directory:
            return [path]
        names = [f.base_name for f in found[0].get_file_info(pyarrow.fs.FileSelector(found[1]))]
    elif not os.path.isdir(path):
        return [path]
    else:
        names = os.listdir(path)
    return [f"{path.rstrip('/')}/{x}" for x in sorted(names) if x.lower().endswith((".tif", ".tiff"))][:limit]


def _bytes(path: str) -> int:
    return found[0].get_file_info(found[1]).size if (found := _store(path)) else os.path.getsize(path)


@dataclass
class Box:
    """What pushed filters leave of files and cells; ends are included."""

    names: set[str] | None = None
    ends: dict[str, tuple[float, float]] = field(default_factory=dict)

    def add(self, f: Filter) -> None:
        column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
        if column == "file" and isinstance(f, (EqualTo, In)):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.names = names if self.names is None else self.names & names
        elif column in ("x", "y"):
            low, high = self.ends.get(column, (-math.inf, math.inf))
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = min(high, f.value)
            if isinstance(f, In):
                low, high = max(low, min(f.value)), min(high, max(f.value))
            self.ends[column] = low, high

    def has(self, name: str) -> bool:
        return self.names is None or name in self.names

    def meets(self, block: tuple[int, int, int, int, int, int]) -> bool:
        return all(self.ends.get(c, (-math.inf, math.inf))[0] < a + n and a <= self.ends.get(c, (-math.inf, math.inf))[1] for c, a, n in (("x", block[0], block[2]), ("y", block[1], block[3])))


class _Pack(InputPartition):
    """Blocks of files whose headers are known, or files (meta None) whose headers the task reads."""

    def __init__(self, parts: list[tuple[str, Meta | None]]):
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.pack = files(options["path"], int(options["limit"]) if "limit" in options else None), int(options.get("pack", PACK))
        self.headers, self.box = int(options.get("headers", HEADERS)), Box()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on file, x and y pick files and blocks; Spark still applies them to cells."""
        for f in filters:
            self.box.add(f)
            yield f

    def partitions(self) -> list[_Pack]:
        paths = [p for p in self.paths if self.box.has(os.path.basename(p))]
        packs, size = [[]], 0
        known = len(paths) <= self.headers
        for p in paths:
            m = peek(p) if known else None
            for b in [b for b in m.blocks if self.box.meets(b)] if known else [None]:
                each = (b[2] * b[3] * m.bits // 8 if m.compression == PLAIN else b[5]) if b else _bytes(p)
                if packs[-1] and size + each > self.pack:
                    packs.append([])
                    size = 0
                size += each
                if packs[-1] and b and packs[-1][-1][0] == p:
                    packs[-1][-1][1].blocks.append(b)
                else:
                    packs[-1].append((p, replace(m, blocks=[b]) if b else None))
        return [_Pack(x) for x in packs]

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        for path, m in partition.parts:
            with _open(path) as f:
                m = m or _header(f, os.path.basename(path))
                for b in m.blocks:
                    if self.box.meets(b) and (v := _block(f, m, b)) is not None:
                        yield _rows(m, b, v)


def _rows(m: Meta, block: tuple[int, int, int, int, int, int], v: np.ndarray) -> pa.RecordBatch:
    if m.gdal_nodata.strip():
        v = np.where(v == float(m.gdal_nodata), np.nan, v)
    y, x = np.indices(v.shape, np.int32)
    x, y = x.ravel() + np.int32(block[0]), y.ravel() + np.int32(block[1])
    n = x.astype(np.int64) * m.height + y
    return pa.RecordBatch.from_arrays([pa.array([m.filename] * len(n)), pa.array(n), pa.array(x), pa.array(y), pa.array(v.ravel())], names=["file", "n", "x", "y", "h"])


class TiffSource(DataSource):
    """spark.read.format("tarn_tiff").load(path): the cells of strips or tiles, no data as NaN.

    Filters on file, x and y leave files and blocks unread. Blocks are packed by their bytes into partitions of about
    option `pack`. Headers of up to `headers` files are read to plan that; of more files, tasks read the headers of theirs. The
    path may be a URI of any store that pyarrow opens, or one that every executor can open, such as a mounted share.
    """

    @classmethod
    def name(cls) -> str:
        return "tarn_tiff"

    def schema(self) -> str:
        return "file string, n long, x int, y int, h double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


def read(spark: SparkSession, path: str, **options: int) -> DataFrame:
    register(spark)
    return spark.read.format("tarn_tiff").options(**options).load(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same cells from any store that Spark reads, a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                f = io.BytesIO(content.as_py())
                m = _header(f, os.path.basename(name))
                for b in m.blocks:
                    if (v := _block(f, m, b)) is not None:
                        yield _rows(m, b, v)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, TiffSource({}).schema())


META_SCHEMA = "filename string, width long, height long, bits long, gdal_nodata string, gdal_metadata string, ascii_params string, scale array<double>, coords array<double>, params array<double>, keydir array<int>, min_x double, min_y double, max_x double, max_y double"


def read_meta(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A row for each file, from headers alone; headers are read by tasks, where the files can be opened."""
    paths = files(path, limit)
    for p in paths[:1]:
        peek(p)  # a missing file raises here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                m = peek(p)
                own = [m.filename, m.width, m.height, m.bits, m.gdal_nodata, m.gdal_metadata, m.ascii_params, m.scale, m.coords, m.params, m.keydir, *m.low, *m.high]
                kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, *[pa.list_(pa.float64())] * 3, pa.list_(pa.int32()), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(own, kinds, strict=True)], names=[c.split()[0] for c in META_SCHEMA.split(", ")])

    ship(spark)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // 64)))
    return rows.mapInArrow(run, META_SCHEMA)


def to_array(raster: DataFrame, nx: int, ny: int, v: str = "h", bound: int = 1 << 30) -> np.ndarray:
    """The raster as an array [x, y] on the driver; more than `bound` bytes raise before anything is collected."""
    if nx * ny * 8 > bound:
        raise ValueError(f"{nx} x {ny} cells pass the bound of {bound} bytes")
    got = raster.select("n", v).toArrow()
    out = np.full(nx * ny, np.nan)
    out[got.column("n").to_numpy()] = got.column(v).to_numpy().astype(float)
    return out.reshape(nx, ny)


def from_array(spark: SparkSession, values: np.ndarray) -> DataFrame:
    nx, ny = values.shape
    n = np.arange(nx * ny, dtype=np.int64)
    table = pa.table({"n": n, "x": (n // ny).astype(np.int32), "y": (n % ny).astype(np.int32), "h": np.asarray(values, np.float64).ravel()})
    return spark.createDataFrame(table)


def write(
    raster: DataFrame, path: str, nx: int, ny: int, meta: Meta | None = None, v: str = "h", bits: int = 32, rows: int = 256, compression: int = PLAIN, tile: tuple[int, int] | None = None
) -> None:
    """One file of strips of `rows` rows, or of tiles, with cells that the raster lacks as NaN or no data.

    Tasks make the blocks, plain or deflated, and write them at places that follow from the sums of their sizes; the driver
    only writes the directory, and names the file once all is there. A failed job leaves no file. Files over 4 GB are
    BigTIFF. Tiles have multiples of 16 cells a side, as the format asks.
    """
    if compression not in (PLAIN, DEFLATE):
        raise ValueError("plain or deflated")
    if tile and any(t < 16 or t % 16 for t in tile):
        raise ValueError("tiles have multiples of 16 cells a side")
    bw, bh = tile or (nx, rows)
    across, down = -(-nx // bw), -(-ny // bh)

    def block(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        x0, y0 = k % across * bw, k // across * bh
        table = table.filter(pa.compute.is_valid(table.column("n")))
        n = table.column("n").to_numpy()
        values = np.full((bw, bh if tile else min(bh, ny - y0)), np.nan)
        values[n // ny - x0, n % ny - y0] = table.column("v").to_numpy()
        raw = _pixels(values, meta, bits)
        return pa.table({"k": pa.array([k], pa.int64()), "data": pa.array([zlib.compress(raw) if compression == DEFLATE else raw], pa.binary())})

    spark = raster.sparkSession
    ship(spark)
    at = F.floor(F.col("n") % ny / bh) * across + F.floor(F.floor(F.col("n") / ny) / bw)
    cells = raster.select(F.col("n").cast("long").alias("n"), F.col(v).cast("double").alias("v"), at.cast("long").alias("k"))
    each = spark.range(across * down).select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("v"), F.col("id").alias("k"))
    made = cells.unionAll(each).groupBy("k").applyInArrow(block, "k long, data binary")
    is_big = lambda size: size + 24 * across * down > (1 << 32) - (1 << 20)

    def frame(blocks: list[tuple[int, int, int]]) -> list[tuple[int, bytes]]:
        size = sum(b[2] for b in blocks)
        end = max((b[1] + b[2] + b[2] % 2 for b in blocks), default=16)
        return [(0, _start(end, is_big(size))), (end, _directory(end, nx, ny, tile or bh, [b[1] for b in blocks], [b[2] for b in blocks], meta, bits, compression, is_big(size)))]

    placed.write(made, path, lambda size: 16 if is_big(size) else 8, frame, even=True)


def write_folder(rasters: DataFrame, folder: str, ny: int, v: str = "h", bits: int = 32) -> DataFrame:
    """Writes each file of (file, n, h) in a task of its own into a folder that all executors share; (file, cells)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        values = np.full((int(n.max()) // ny + 1, ny), np.nan)
        values.ravel()[n] = table.column(v).to_numpy()
        write_array(os.path.join(folder, key[0].as_py()), values, None, bits)
        return pa.table({"file": pa.array([key[0].as_py()]), "cells": pa.array([len(n)], pa.int64())})

    ship(rasters.sparkSession)
    return rasters.select("file", "n", F.col(v).cast("double").alias(v)).groupBy("file").applyInArrow(run, "file string, cells long")


def zip_save(path: str, fields: dict[str, np.ndarray], meta: Meta | None = None, bits: int = 32) -> None:
    """One GeoTIFF for each field, in a ZIP file."""
    with zipfile.ZipFile(path, "w") as z:
        for name, values in fields.items():
            z.writestr(f"{name}.tiff", encode(values, meta or Meta(), bits))


def zip_load(path: str) -> dict[str, np.ndarray]:
    """The fields of such a file, by name."""
    out = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            f = io.BytesIO(z.read(name))
            out[name.rsplit(".", 1)[0]] = _image(f, _header(f, name))
    return out
