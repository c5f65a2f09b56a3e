"""Files whose tasks write their own byte ranges: lengths first, then places from their sums, then writes at those places."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tarn.plans.state import settled, ship

#: What stands around the blocks: (at, bytes) pairs, from the (number, at, size) of all blocks in order.
Frame = Callable[[list[tuple[int, int, int]]], list[tuple[int, bytes]]]


@dataclass
class _Wrote(WriterCommitMessage):
    blocks: list[tuple[int, int, int]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Blocks go to a file beside the wanted one, which takes its name once the driver has put the frame around them.

    Equal tasks write equal bytes to equal places, so an attempt may be repeated; a failed job leaves no file.
    """

    def __init__(self, options: dict):
        self.path, self.frame = options["path"], cloudpickle.loads(base64.b64decode(options["frame"]))
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        done = _Wrote()
        handle = os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o666)
        try:
            for batch in iterator:
                for k, at, data in zip(batch.column("k").to_pylist(), batch.column("at").to_pylist(), batch.column("data"), strict=True):
                    raw, sent = memoryview(data.as_buffer()), 0
                    while sent < len(raw):
                        sent += os.pwrite(handle, raw[sent:], at + sent)
                    done.blocks.append((k, at, len(raw)))
            os.fsync(handle)
        finally:
            os.close(handle)
        return done

    def commit(self, messages: list[_Wrote | None]) -> None:
        blocks = sorted(b for m in messages if m for b in m.blocks)
        handle = os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o666)
        try:
            for at, raw in self.frame(blocks):
                os.pwrite(handle, raw, at)
            os.fsync(handle)
        finally:
            os.close(handle)
        os.replace(self.part, self.path)

    def abort(self, messages: list[_Wrote | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class PlacedSource(DataSource):
    """df.write.format("tarn_placed"): rows k, at, data, written at their places into the file of option `path`."""

    @classmethod
    def name(cls) -> str:
        return "tarn_placed"

    def schema(self) -> str:
        return "k long, at long, data binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PlacedSource)


def write(blocks: DataFrame, path: str, start: Callable[[int], int], frame: Frame, even: bool = False) -> None:
    """One file of the blocks (k, data), in the order of k from byte start(sum of sizes) on, with what `frame` puts around.

    Blocks are made once and settled; their sizes alone come to the driver, as a file's directory does, and their places go
    back to the tasks. No block passes the driver. With `even`, each block starts at an even byte. The path must be one
    that all executors can open, such as a mounted share.
    """
    spark = blocks.sparkSession
    register(spark)
    made = settled(blocks.select("k", "data"))
    sizes = made.select("k", F.octet_length("data").cast("long").alias("size")).toArrow().sort_by("k")
    at, places = start(sum(sizes.column("size").to_pylist())), []
    for size in sizes.column("size").to_pylist():
        places.append(at)
        at += size + (size % 2 if even else 0)
    table = spark.createDataFrame(pa.table({"k": sizes.column("k"), "at": pa.array(places, pa.int64())}))
    told = base64.b64encode(cloudpickle.dumps(frame)).decode()
    made.join(F.broadcast(table), "k").select("k", "at", "data").write.format("tarn_placed").option("frame", told).mode("append").save(path)


def write_runs(runs: DataFrame, path: str, frame: Frame) -> None:
    """One file of blocks whose places are known beforehand: k, at, data."""
    register(runs.sparkSession)
    told = base64.b64encode(cloudpickle.dumps(frame)).decode()
    runs.select("k", "at", "data").write.format("tarn_placed").option("frame", told).mode("append").save(path)
