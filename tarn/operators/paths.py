"""Ways along the flow, cell by cell, from a table function over tiles of the graph and the walkers that enter them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from tarn.operators.flow import tiles_of
from tarn.plans.state import join_dealt, settled, ship

#: Walkers of one tile that a task moves; rows that it hands on at a time.
CROWD, BATCH = 4096, 1 << 18
_CELL, _WALKER = 0, 1


class FlowPaths:
    """eval(TABLE(kind, a, b, step) PARTITION BY tile, part): cells (a, their receiver b) and walkers (at a, from b, after step).

    origin, step, n for each cell on a walker's way through the tile; `further` is where it leaves to, on its last row.
    """

    def __init__(self):
        self.held: list[pa.RecordBatch] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.held.append(rows)
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if not self.held:
            return
        table = pa.Table.from_batches(self.held)
        kind, a, b, step = (table.column(c).to_numpy() for c in ("kind", "a", "b", "step"))
        cells = np.flatnonzero(kind == _CELL)
        cells = cells[np.argsort(a[cells], kind="stable")]
        n, to = a[cells], b[cells]
        place = lambda of: np.minimum(np.searchsorted(n, of), max(len(n) - 1, 0))
        inner = n[place(to)] == to if len(n) else np.zeros(0, bool)
        next_ = np.where(inner, place(to), -1)
        walkers = np.flatnonzero(kind == _WALKER)
        at = place(a[walkers])
        some = n[at] == a[walkers] if len(n) else np.zeros(len(walkers), bool)  # a cell that isn't there ends the way
        at, origin, step, rounds = at[some], b[walkers][some], step[walkers][some].copy(), 0
        out, size = [], 0
        while len(at):
            if rounds > len(n):
                raise ValueError("the graph has a cycle")
            stays = next_[at] >= 0
            out.append((origin, step.copy(), n[at], np.where(stays, -1, to[at])))
            size += len(at)
            at, origin, step, rounds = next_[at[stays]], origin[stays], step[stays] + 1, rounds + 1
            if size > BATCH or not len(at):
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.table(dict(zip(("origin", "step", "n", "further"), columns, strict=True)))
                out, size = [], 0


def register(spark: SparkSession) -> None:
    """Makes the function known to SQL, as flow_paths(TABLE(rows) PARTITION BY (tile, part))."""
    ship(spark)
    spark.udtf.register("flow_paths", _function())


def _function():
    return arrow_udtf(FlowPaths, returnType="origin long, step long, n long, further long")


def flow_paths(graph: DataFrame, starts: DataFrame, ny: int, side: int = 256, most_rounds: int = 10_000) -> DataFrame:
    """id, step, n: every cell on the way of each start (id, n) along the graph (n, nxt), from step 0 on.

    Starts at one cell share a walker. Each round moves the walkers of a tile to where they end or leave it, a task for
    each tile and CROWD walkers in it, so a tile that a river passes is moved by many tasks; then those that left enter
    their next tile. Rounds are as many as the tiles that the longest way crosses. A cycle within a tile raises, one over
    several tiles does after most_rounds. Starts outside the graph and null ones have no way.
    """
    spark = graph.sparkSession
    ship(spark)
    walk, tile = _function(), tiles_of(ny, side=side)
    cells = settled(graph.select(F.col("n").cast("long").alias("a"), F.coalesce("nxt", F.lit(-1)).cast("long").alias("b")).withColumn("tile", tile(F.col("a"))))
    walkers = settled(starts.where("n is not null").select(F.col("n").cast("long").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("step"))).withColumn("tile", tile(F.col("a")))
    found = []
    for _ in range(most_rounds):
        if not walkers.limit(1).count():
            break
        parts = settled(walkers.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")))
        held = cells.join(parts, "tile").select(F.lit(_CELL).alias("kind"), "a", "b", F.lit(0).cast("long").alias("step"), "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        moving = walkers.join(parts, "tile").select(F.lit(_WALKER).alias("kind"), "a", "b", "step", "tile", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
        out = settled(walk(held.unionAll(moving).asTable().partitionBy("tile", "part")))
        found.append(out.select(F.col("origin").alias("start"), "step", "n"))
        walkers = out.where("further >= 0").select(F.col("further").alias("a"), F.col("origin").alias("b"), (F.col("step") + 1).alias("step")).withColumn("tile", tile(F.col("a")))
    else:
        raise ValueError("the graph has a cycle")
    none = spark.createDataFrame([], "start long, step long, n long")
    ways = reduce(DataFrame.unionAll, found, none)
    return join_dealt(starts.select("id", F.col("n").cast("long").alias("start")), ways, ["start"]).select("id", "step", "n")
