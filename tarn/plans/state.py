"""What iterations and Python workers need of the session: settled tables, and this package on the executors."""

from __future__ import annotations

import importlib.util
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: A key is hot if it has more rows than this many, and more than this share of all, so there are at most 4096 hot ones.
HOT_ROWS, HOT_SHARE = 10_000, 1 / 4096


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, as they needn't share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(importlib.util.find_spec("tarn").origin).parent
    archive = Path(tempfile.mkdtemp(prefix="tarn-")) / "tarn.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the session names none, a temporary one serves a local master, as in tests; any other master raises.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tarn-")
    if not known.isDefined():
        context.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; codecs open files by path, so it must be mounted."""
    shared = shared_folder(spark)
    path = shared.removeprefix("file://") if shared.startswith("file://") else shared.removeprefix("file:")
    if "://" in path:
        raise ValueError("the shared folder must be one that files can be opened in")
    path = os.path.join(path, f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def packed(df: DataFrame) -> DataFrame:
    """A small result of much work in as many files as its bytes fill: a shuffle of the result, so that adaptive
    execution sizes the files, and the work before it keeps its own number of tasks."""
    return df.hint("rebalance")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned in the block loses its shuffles' files as soon as it has run; else they stay until the driver
    happens to collect garbage. A stage that needs them again is run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: What has been settled in the block of `scratch` that runs.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        planned = df.select("*")
    out = planned.checkpoint(eager=True)
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are settled in the block are removed when it ends, but for those that go through the given function."""
    kept, token = [], _made.set(made := [])
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _made.reset(token)
        for df in made:
            if not any(df is k for k in kept):
                forget(df)
        if (outer := _made.get()) is not None:
            outer.extend(kept)


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """df kept in the shared folder in buckets by a key while the block runs: grouping by that key alone shuffles nothing,
    however often it is done."""
    spark, name = df.sparkSession, f"tarn_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with shuffles_removed(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def attach(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with the one row of `values` that has their keys, inner or left, where a key may have most rows.

    Hot keys are joined by broadcasting their values, at most 1 / HOT_SHARE rows, so their rows stay where they are;
    the others are joined as Spark likes. `rows` is read three times, so it should be settled or cheap. total: how many
    rows there are, if that is known.
    """
    total = rows.count() if total is None else total
    if total <= HOT_ROWS:
        return rows.join(values, keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(" and ".join(f"`{k}` is not null" for k in keys))
    hot = settled(counts.where(F.col("__rows") > max(HOT_ROWS, int(total * HOT_SHARE))).select(*keys))
    if not hot.limit(1).count():
        return rows.join(values, keys, how)
    known = settled(F.broadcast(hot).join(values, keys, how) if how == "left" else values.join(F.broadcast(hot), keys))
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(values, keys, how)
    return rows.join(F.broadcast(known), keys).select(*rest.columns).unionAll(rest)


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], room: int = 100_000) -> DataFrame:
    """The inner join where a key may have most rows of `left`: those are dealt to parts, and its right rows copied to each.

    A key is crowded if it has more rows than `room` and than one in 4096 of all, so a table of at most 4096 rows says which
    are. `left` is read twice.
    """
    limit = max(room, left.count() // 4096)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    crowded = settled(counts.select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    if not crowded.limit(1).count():
        return left.join(right, keys)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(F.broadcast(crowded), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*(c for c in left.columns)), parts)).drop("__parts")
    copied = right.join(F.broadcast(crowded), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"]).drop("__part")
