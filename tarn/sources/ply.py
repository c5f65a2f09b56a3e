"""PLY files of meshes, as text or little-endian binary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.state import ship
from tarn.sources import placed

_KIND = {"ascii": "ascii 1.0", "binary": "binary_little_endian 1.0"}


def _head(kind: str, vertices: int, faces: int) -> bytes:
    return "\n".join(["ply", f"format {_KIND[kind]}", f"element vertex {vertices}", *(f"property float {c}" for c in "xyz"), f"element face {faces}", "property list uchar uint vertex_indices", "end_header", ""]).encode()


#: Vertices or faces that one block of a file has.
RUN = 1 << 16


def _runs(rows: DataFrame, columns: list[str], encode: Callable[[np.ndarray], bytes], part: int) -> DataFrame:
    """k, first, data: the rows in runs of RUN ids, encoded; part 0 stands before part 1."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        values = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        first = table.column("id")[0].as_py()
        return pa.table({"k": pa.array([part * (1 << 48) + first // RUN], pa.int64()), "first": pa.array([first], pa.int64()), "data": pa.array([encode(values)], pa.binary())})

    return rows.select("id", *columns, F.floor(F.col("id") / RUN).alias("run")).groupBy("run").applyInArrow(run, "k long, first long, data binary")


def write_ascii(path: str, vertices: DataFrame, faces: DataFrame) -> None:
    """Vertices are scaled into [0, 1] along each axis. Tasks make the lines, whose lengths give each run its place."""
    span = vertices.agg(*(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    low, high = np.array(span[::2], float), np.array(span[1::2], float)
    wide = np.where(high > low, high - low, 1.0)
    line = lambda form, values: "".join(form.format(*r) for r in values.tolist()).encode()
    head = _head("ascii", vertices.count(), faces.count())
    ship(vertices.sparkSession)
    runs = _runs(vertices, ["x", "y", "z"], lambda v: line("{:g} {:g} {:g}\n", (v - low) / wide), 0).unionAll(_runs(faces, ["a", "b", "c"], lambda f: line("3 {} {} {}\n", f), 1))
    placed.write(runs, str(path), lambda size: len(head), lambda blocks: [(0, head)])


def write_binary(path: str, vertices: DataFrame, faces: DataFrame) -> None:
    """Places follow from the ids, which count from 0: 12 bytes for a vertex, 13 for a face."""

    def face(f: np.ndarray) -> bytes:
        rows = np.zeros(len(f), [("k", "u1"), ("i", "<u4", 3)])
        rows["k"], rows["i"] = 3, f
        return rows.tobytes()

    count = vertices.count()
    head = _head("binary", count, faces.count())
    ship(vertices.sparkSession)
    own = _runs(vertices, ["x", "y", "z"], lambda v: v.astype("<f4").tobytes(), 0).withColumn("at", len(head) + F.col("first") * 12)
    rest = _runs(faces, ["a", "b", "c"], face, 1).withColumn("at", len(head) + count * 12 + F.col("first") * 13)
    placed.write_runs(own.unionAll(rest), str(path), lambda blocks: [(0, head)])


def _sizes(path: str) -> tuple[int, int, int]:
    """Where a binary file's vertices begin, how many there are, and faces."""
    with open(path, "rb") as f:
        head = b""
        while not head.endswith(b"end_header\n"):
            line = f.readline()
            if not line:
                raise ValueError("no PLY file")
            head += line
    lines = head.decode().splitlines()
    if f"format {_KIND['binary']}" not in lines:
        raise ValueError("only little-endian binary files can be read")
    count = lambda kind: next(int(x.split()[2]) for x in lines if x.startswith(f"element {kind}"))
    return len(head), count("vertex"), count("face")


def _read(spark: SparkSession, path: str, start: int, count: int, kind: np.dtype, columns: dict[str, str], each: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("id").to_pylist():
                with open(path, "rb") as f:
                    f.seek(start + kind.itemsize * first)
                    v = np.frombuffer(f.read(kind.itemsize * min(each, count - first)), kind)["v"]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(v))), *(pa.array(v[:, k].astype("f8" if t == "double" else "i8")) for k, t in enumerate(columns.values()))], names=["id", *columns])

    ship(spark)
    return spark.range(0, count, each).mapInArrow(run, ", ".join(["id long", *(f"{c} {t}" for c, t in columns.items())]))


def read_vertices(spark: SparkSession, path: str, each: int = 1 << 20) -> DataFrame:
    """id, x, y, z of a binary file; tasks read runs of `each` vertices from a path that all of them can open."""
    start, count, _ = _sizes(path)
    return _read(spark, path, start, count, np.dtype([("v", "<f4", 3)]), dict.fromkeys("xyz", "double"), each)


def read_faces(spark: SparkSession, path: str, each: int = 1 << 20) -> DataFrame:
    """id, a, b, c of a binary file of triangles."""
    start, before, count = _sizes(path)
    return _read(spark, path, start + 12 * before, count, np.dtype([("n", "u1"), ("v", "<u4", 3)]), dict.fromkeys("abc", "long"), each)
