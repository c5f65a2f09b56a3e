"""Steps from each cell of a flat to where it drains; only flats are held, and only tiles that news reached work again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.stencil import TILE, in_tiles
from tarn.plans.model import Edge
from tarn.plans.state import settled, ship


def spread(h: np.ndarray, w: np.ndarray, mine: np.ndarray, shifts: list[tuple[int, int]]) -> None:
    """Lowers w to one more than the least of the cells beside of equal h, level by level; the arrays have a margin."""
    wide, h, w, mine = h.shape[1], h.ravel(), w.ravel(), mine.ravel()
    offsets = [dx * wide + dy for dx, dy in shifts]
    given = np.flatnonzero(np.isfinite(w))
    given = given[np.argsort(w[given], kind="stable")]
    levels, at, level, front = w[given], 0, 0.0, given[:0]
    while at < len(given) or len(front):
        if not len(front):
            level = max(level, levels[at])
        to = np.searchsorted(levels, level, side="right")
        front, at = np.concatenate((front, given[at:to])), max(at, to)
        front = front[w[front] == level]
        new = []
        for o in offsets:
            beside = front + o
            beside = beside[mine[beside] & (h[beside] == h[front]) & (w[beside] > level + 1)]
            w[beside] = level + 1
            new.append(beside)
        front, level = np.concatenate(new), level + 1


def flat_steps(raster: DataFrame, edge: Edge, v: str = "h", side: int = TILE, most_rounds: int = 10_000) -> DataFrame:
    """n, steps of the cells of flats: over cells of equal height to the nearest that has a lower neighbour or touches the
    border, which has none itself; infinite where there is none.

    Only cells with a neighbour of equal height are kept, which each tile finds after one shuffle. Each tile spreads steps
    by itself and tells what it has found along its edge; a round works on those tiles alone that another tile has told
    something. A flat over k tiles takes about k rounds, in which each tile works when the front passes it; rasters without
    wide flats take one.
    """
    ship(raster.sparkSession)
    h = F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias("h")
    cells = in_tiles(raster.select(F.col("n").cast("long").alias("n"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), h), 1, side)
    found = "n long, x int, y int, h double, w double, tx int, ty int"

    def level(key: tuple, table: pa.Table) -> pa.Table:
        """The tile's cells with a neighbour of equal height; 0 where one has a lower one or none at all."""
        n, x, y, h, own = (table.column(c).to_numpy() for c in ("n", "x", "y", "h", "__own"))
        x0, y0 = int(x.min()) - 1, int(y.min()) - 1
        around = np.full((int(x.max()) - x0 + 2, int(y.max()) - y0 + 2), np.nan)
        around[x - x0, y - y0] = h
        n, x, y, h = n[own], x[own], y[own], h[own]
        flat, drains = np.zeros(len(n), bool), np.zeros(len(n), bool)
        for dx, dy in edge.shifts:
            c = around[x - x0 + dx, y - y0 + dy]
            flat |= c == h
            drains |= np.isnan(c) | (c < h)
        tx, ty = (np.full(int(flat.sum()), k.as_py(), np.int32) for k in key)
        return pa.table({"n": n[flat], "x": x[flat], "y": y[flat], "h": h[flat], "w": np.where(drains[flat], 0.0, np.inf), "tx": tx, "ty": ty})

    flats = settled(cells.select("n", "x", "y", "h", "__own", "__tx", "__ty").groupBy("__tx", "__ty").applyInArrow(level, found))
    kinds = "n long, x int, y int, h double, w double"

    def worked(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        """The tile's cells and their steps, and what it had told before."""
        n, x, y, h, w = (np.concatenate([t.column(c).to_numpy().astype(k) for t in (left, right) if t.num_rows]) for c, k in (("n", np.int64), ("x", np.int64), ("y", np.int64), ("h", float), ("w", float)))
        x0, y0 = int(x.min()) - 1, int(y.min()) - 1
        shape = int(x.max()) - x0 + 2, int(y.max()) - y0 + 2
        height, steps, mine, told = np.full(shape, np.nan), np.full(shape, np.inf), np.zeros(shape, bool), np.full(shape, np.inf)
        at, k = (x - x0, y - y0), left.num_rows
        height[at] = h
        np.minimum.at(steps, at, w)
        mine[at[0][:k], at[1][:k]] = True
        if right.num_rows:
            told[at[0][k:], at[1][k:]] = w[k:]
        spread(height, steps, mine, edge.shifts)
        own = at[0][:k], at[1][:k]
        return n[:k], x[:k], y[:k], h[:k], steps[own], told[own]

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(("n", "x", "y", "h", "w"), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)})
        n, x, y, h, w, told = worked(left, right)
        edge_of_tile = (x % side == 0) | (x % side == side - 1) | (y % side == 0) | (y % side == side - 1)
        some = np.flatnonzero(edge_of_tile & (w < told))
        return pa.table({"n": n[some], "x": x[some].astype(np.int32), "y": y[some].astype(np.int32), "h": h[some], "w": w[some]})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"n": pa.array([], pa.int64()), "steps": pa.array([], pa.float64())})
        n, _, _, _, w, _ = worked(left, right)
        return pa.table({"n": n, "steps": w})

    def beside(told: DataFrame) -> DataFrame:
        return in_tiles(told, 1, side).select("n", "x", "y", "h", "w", F.col("__tx").alias("tx"), F.col("__ty").alias("ty"), "__own")

    by = lambda df: df.groupBy("tx", "ty")
    told = raster.sparkSession.createDataFrame([], kinds)
    news = settled(by(flats).cogroup(by(beside(told))).applyInArrow(tell, kinds))
    for _ in range(most_rounds):
        if not news.limit(1).count():
            return by(flats).cogroup(by(beside(told))).applyInArrow(finish, "n long, steps double")
        told = settled(told.unionAll(news).groupBy("n", "x", "y", "h").agg(F.min("w").alias("w")))
        reached = beside(news).where("NOT __own").select("tx", "ty").distinct()
        news = settled(by(flats.join(reached, ["tx", "ty"], "left_semi")).cogroup(by(beside(told).join(reached, ["tx", "ty"], "left_semi"))).applyInArrow(tell, kinds))
    raise ValueError("still moving")


def sloped(raster: DataFrame, rise: float, edge: Edge, v: str = "h", side: int = TILE) -> DataFrame:
    """The raster with `rise` added for each step."""
    found = flat_steps(raster, edge, v, side).where((F.col("steps") > 0) & (F.col("steps") < float("inf"))).withColumnRenamed("steps", "__steps")
    risen: Column = F.col(v) + rise * F.coalesce("__steps", F.lit(0.0))
    return raster.join(found, "n", "left").select(*(risen.alias(v) if c == v else F.col(c) for c in raster.columns))
