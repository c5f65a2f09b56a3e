"""Depressions filled over a graph of spill heights: tiles are flooded by themselves, then only their borders are joined."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.stencil import TILE, in_tiles
from tarn.plans.model import Edge
from tarn.plans.state import settled, ship

#: Tiles along each side of a group, groups along each side of a larger group, and so on.
FAN = 16
#: The number of what lies outside.
OUTSIDE = -1
_PERIMETER, _EDGE, _DRAIN = 0, 1, 2
_ROWS = "kind int, tx int, ty int, n long, x int, y int, a long, b long, w double"


def drained(count: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """To which kept node each node drains, over which height, and the edges (places in w) of the forest it takes.

    The way to the kept node is one whose highest edge is lowest. Components that have no kept node join along their
    lowest edge outwards, all at once; the edges' order makes heights distinct, so two components may only choose the
    same edge, and the smaller of them stays. A node without a way to any kept node ends at a node that isn't kept.
    """
    order = np.argsort(w, kind="stable")
    place, a, b, w = order, a[order], b[order], w[order]
    at, cost, done, used = np.arange(count), np.full(count, -np.inf), kept.copy(), []
    while True:
        ca, cb = at[a], at[b]
        live = np.flatnonzero((ca != cb) & ~(done[ca] & done[cb]))
        if not len(live):
            return at, cost, np.concatenate(used) if used else np.zeros(0, np.int64)
        place, a, b, w, ca, cb = place[live], a[live], b[live], w[live], ca[live], cb[live]
        number = np.arange(len(live))
        best = [np.full(count, len(live)) for _ in range(2)]
        for least, side in zip(best, (ca, cb), strict=True):
            least[side[::-1]] = number[::-1]  # the first of a component is written last
        best = np.minimum(*best)
        who = np.flatnonzero((best < len(live)) & ~done)
        edge = best[who]
        to, up, step = np.where(ca[edge] == who, cb[edge], ca[edge]), np.arange(count), np.full(count, -np.inf)
        up[who], step[who] = to, w[edge]
        stays = who[(up[to] == who) & (who < to)]
        up[stays], step[stays] = stays, -np.inf
        used.append(place[np.unique(edge)])
        while len(moving := np.flatnonzero(up[up] != up)):
            step[moving] = np.maximum(step[moving], step[up[moving]])
            up[moving] = up[up[moving]]
        cost, at = np.maximum(cost, step[at]), up[at]


def _lowest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the edges between two nodes only the lowest."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((w, high, low))
    low, high, w = low[order], high[order], w[order]
    first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(w)]
    return low[first], high[first], w[first]


def _reduced(count: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Owners and heights of all nodes, and a forest among the kept ones over which ways are as low as before."""
    owner, cost, _ = drained(count, a, b, w, kept)
    w = np.maximum(w, np.maximum(cost[a], cost[b]))
    a, b = owner[a], owner[b]
    some = (a != b) & kept[a] & kept[b]
    a, b, w = _lowest(a[some], b[some], w[some])
    _, _, used = drained(count, a, b, w, np.zeros(count, bool))
    return owner, cost, (a[used], b[used], w[used])


class _Tile:
    """A tile's cells by the minimum that they run down to, and the heights over which minima spill."""

    def __init__(self, table: pa.Table, edge: Edge):
        x, y, h, own = (table.column(c).to_numpy() for c in ("x", "y", "h", "__own"))
        self.x, self.y, self.h, self.n = x[own], y[own], h[own].astype(float), table.column("n").to_numpy()[own]
        if not len(self.x):
            self.ids = np.zeros(0, np.int64)
            return
        x0, y0 = int(self.x.min()) - 1, int(self.y.min()) - 1
        shape = int(self.x.max()) - x0 + 2, int(self.y.max()) - y0 + 2
        inside = (x >= x0) & (x < x0 + shape[0]) & (y >= y0) & (y < y0 + shape[1])
        around = np.full(shape, np.nan)
        around[x[inside] - x0, y[inside] - y0] = h[inside]
        place = np.full(shape, -1)
        mine = np.flatnonzero(~np.isnan(self.h))
        at = self.x[mine] - x0, self.y[mine] - y0
        place[at] = np.arange(len(mine))
        height = self.h[mine]
        beside = [(at[0] + dx, at[1] + dy) for dx, dy in edge.shifts]
        near = [(place[p], around[p]) for p in beside]
        # Down to the lowest neighbour, until there is none.
        low, to = height.copy(), np.arange(len(mine))
        for k, v in near:
            better = (k >= 0) & (v < low)
            low, to = np.where(better, v, low), np.where(better, k, to)
        while (to[to] != to).any():
            to = to[to]
        roots, node = np.unique(to, return_inverse=True)
        self.mine, self.node, self.ids = mine, node + 1, np.append(OUTSIDE, self.n[mine][roots])
        pairs = [(self.node[k >= 0], self.node[k[k >= 0]], np.maximum(height[k >= 0], v[k >= 0])) for k, v in near]
        border = np.logical_or.reduce([np.isnan(v) for _, v in near]) if near else np.ones(len(mine), bool)
        pairs.append((np.zeros(int(border.sum()), np.int64), self.node[border], height[border]))
        a, b, w = (np.concatenate(c) for c in zip(*pairs, strict=True))
        self.a, self.b, self.w = _lowest(a[a != b], b[a != b], w[a != b])
        self.perimeter = np.flatnonzero(np.logical_or.reduce([(k < 0) & ~np.isnan(v) for k, v in near]))
        self.kept = np.zeros(len(self.ids), bool)
        self.kept[0] = True
        self.kept[self.node[self.perimeter]] = True

    def reduced(self) -> tuple[np.ndarray, np.ndarray, tuple]:
        return _reduced(len(self.ids), self.a, self.b, self.w, self.kept)


def _table(*parts: tuple) -> pa.Table:
    """Rows of several kinds; each part gives kind, which has one number for each row, and the columns after it."""
    rows = [[np.broadcast_to(c, np.size(part[0])) for c in part] for part in parts]
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    kinds = [np.int32, np.int32, np.int32, np.int64, np.int32, np.int32, np.int64, np.int64, np.float64]
    return pa.table({f.split()[0]: c.astype(k) for f, c, k in zip(_ROWS.split(", "), columns, kinds, strict=True)})


def filled(raster: DataFrame, edge: Edge, v: str = "h", side: int = TILE, fan: int = FAN) -> DataFrame:
    """n, x, y, w: each cell's height once depressions are full, the lowest height from which water gets outside.

    (1) Each tile finds the minima that its cells run down to and the heights over which those spill into each other or
    outside, and hands on its outermost cells and a forest among the minima that reach them. (2) Groups of fan x fan
    tiles join these across tiles and hand on what reaches the group's border, and so on until one group is left, whose
    minima then know their level; levels go back down. (3) Each tile fills its own cells. Cells are shuffled twice,
    whatever the depressions' extent; a level of groups holds about 4 / side of the cells of the one before. Levels grow
    with the logarithm of the raster's extent to the base fan: one for each 16 x 16 tiles.
    """
    ship(raster.sparkSession)
    cells = raster.select(F.col("n").cast("long").alias("n"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias("h"))
    tiles = in_tiles(cells, 1, side).select("n", "x", "y", "h", "__own", "__tx", "__ty").groupBy("__tx", "__ty")

    def flood(key: tuple, table: pa.Table) -> pa.Table:
        t, (tx, ty), none = _Tile(table, edge), (k.as_py() for k in key), np.zeros(0, np.int64)
        if not len(t.ids):
            return _table((none,) * 9)
        _, _, (a, b, w) = t.reduced()
        p = t.mine[t.perimeter]
        return _table((_PERIMETER + 0 * p, tx, ty, t.n[p], t.x[p], t.y[p], t.ids[t.node[t.perimeter]], OUTSIDE, t.h[p]), (_EDGE + 0 * a, tx, ty, 0, 0, 0, t.ids[a], t.ids[b], w))

    def join(cells_in: int, cells_out: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            kind, tx, ty, n, x, y, a, b, w = (table.column(f.split()[0]).to_numpy() for f in _ROWS.split(", "))
            rim, given = kind == _PERIMETER, kind == _EDGE
            x, y, n, label, h, tx, ty = x[rim], y[rim], n[rim], a[rim], w[rim], tx[rim], ty[rim]
            order = np.lexsort((y, x))
            x, y, n, label, h, tx, ty = (c[order].astype(np.int64) if c is not h else c[order] for c in (x, y, n, label, h, tx, ty))
            key = x * (1 << 31) + y
            pairs, outer = [(a[given], b[given], w[given])], np.zeros(len(x), bool)
            for dx, dy in edge.shifts:
                other = (x + dx) * (1 << 31) + y + dy
                found = np.minimum(np.searchsorted(key, other), max(len(key) - 1, 0))
                across = ((x + dx) // cells_in != x // cells_in) | ((y + dy) // cells_in != y // cells_in)
                some = np.flatnonzero(across & (key[found] == other)) if len(key) else np.zeros(0, np.int64)
                pairs.append((label[some], label[found[some]], np.maximum(h[some], h[found[some]])))
                outer |= ((x + dx) // cells_out != x // cells_out) | ((y + dy) // cells_out != y // cells_out)
            a, b, w = (np.concatenate(c) for c in zip(*pairs, strict=True))
            ids = np.union1d(np.union1d(a, b), np.append(label, OUTSIDE))  # outside comes first
            a, b, w = _lowest(np.searchsorted(ids, a), np.searchsorted(ids, b), w)
            kept = ids == OUTSIDE
            if not last:
                kept[np.searchsorted(ids, label[outer])] = True
            owner, cost, (ra, rb, rw) = _reduced(len(ids), a, b, w, kept)
            home = np.zeros((len(ids), 2), np.int64)
            home[np.searchsorted(ids, label)] = np.stack((tx, ty), axis=1)
            gone = np.flatnonzero(~kept)
            tx0, ty0 = (int(c[0]) if len(c) else 0 for c in (tx, ty))
            keep = np.flatnonzero(outer) if not last else np.zeros(0, np.int64)
            return _table(
                (_PERIMETER + 0 * keep, tx[keep], ty[keep], n[keep], x[keep], y[keep], label[keep], OUTSIDE, h[keep]),
                (_EDGE + 0 * ra, tx0, ty0, 0, 0, 0, ids[ra], ids[rb], rw),
                (_DRAIN + 0 * gone, home[gone, 0], home[gone, 1], 0, 0, 0, ids[gone], ids[owner[gone]], cost[gone]),
            )

        return run

    held = settled(tiles.applyInArrow(flood, _ROWS))
    far = held.agg(F.max(F.greatest(F.abs("tx"), F.abs("ty")))).first()[0] or 0
    # Groups reach over both signs of coordinates, so that one is left in the end.
    rounds, ways = max(1, math.ceil(math.log(far + 1, fan) - 1e-9)) if far else 1, []
    for k in range(1, rounds + 1):
        last = k == rounds
        near = [F.lit(0) if last else F.floor(F.col(c) / fan**k) for c in ("tx", "ty")]
        run = join(side * fan ** (k - 1), side * fan**k, last)
        held = settled(held.where(F.col("kind") != _DRAIN).groupBy(near[0].alias("gx"), near[1].alias("gy")).applyInArrow(run, _ROWS))
        ways.append(held.where(F.col("kind") == _DRAIN).select("tx", "ty", F.col("a").alias("label"), F.col("b").alias("owner"), F.col("w").alias("level")))
    levels = ways[-1].select("tx", "ty", "label", "level")
    for way in reversed(ways[:-1]):
        above = levels.select(F.col("label").alias("owner"), F.col("level").alias("above"))
        lower = way.join(above, "owner", "left").select("tx", "ty", "label", F.greatest("level", F.coalesce("above", F.lit(float("-inf")))).alias("level"))
        levels = levels.unionAll(lower)

    def fill(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n, x, y, w = (np.zeros(0, k) for k in (np.int64, np.int32, np.int32, float))
        if left.num_rows:
            t = _Tile(left, edge)
            n, x, y, w = t.n, t.x, t.y, t.h
            if len(t.ids):
                owner, cost, _ = t.reduced()
                known = dict(zip(right.column("label").to_pylist(), right.column("level").to_pylist(), strict=True))
                level = np.array([known.get(i, -np.inf) for i in t.ids.tolist()])
                w = w.copy()
                w[t.mine] = np.maximum(w[t.mine], np.maximum(cost, level[owner])[t.node])
        return pa.table({"n": n, "x": x.astype(np.int32), "y": y.astype(np.int32), "w": w})

    back = levels.select(F.col("tx").alias("__tx"), F.col("ty").alias("__ty"), "label", "level").groupBy("__tx", "__ty")
    return tiles.cogroup(back).applyInArrow(fill, "n long, x int, y int, w double")
