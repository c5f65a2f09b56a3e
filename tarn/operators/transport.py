"""Particles that walk over fields and leave what they carry in the cells they enter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.values import over
from tarn.operators.stencil import neighbourhood, upwind_columns
from tarn.operators.terrain import EPS
from tarn.plans.model import Grid, Params
from tarn.plans.state import bucketed, settled, ship, shuffles_removed

#: Bytes of fields that every task may get; larger rasters are cut in tiles of so many cells a side, longer on narrow grids.
FIELD_BYTES, TILE = 64 << 20, 1024
#: Cells around a tile that it has copies of and walks over, so that a particle on a border doesn't change tiles at each step.
MARGIN = 64
#: Particles that a task walks at a time; particles that a tile walks in one task, beyond which it is walked in several.
PARTICLES, CROWD = 65536, 1 << 20
#: Rounds whose sums are kept apart before they are added up.
KEPT_ROUNDS = 8


def _uniform(n: np.ndarray, seed: int) -> np.ndarray:
    """The same as functions.values.uniform, so starts don't depend on partitions."""
    mask = np.uint64(4294967295)
    x = (n.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed * 40503)) & mask
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) & mask
    return (x ^ (x >> np.uint64(16))).astype(float) / 4294967296.0


class Tiles:
    """How a grid is cut: tiles of at most TILE cells along y and TILE ** 2 in all, each with the cells around it."""

    def __init__(self, grid: Grid):
        self.grid, self.wide = grid, min(TILE, grid.ny)
        self.long, self.around = TILE * TILE // self.wide, min(MARGIN, TILE)
        self.across = -(-grid.ny // self.wide)
        self.count = -(-grid.nx // self.long) * self.across

    def of(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return np.floor(px).astype(int) // self.long * self.across + np.floor(py).astype(int) // self.wide

    def reach(self, tile: int) -> tuple[int, int, int, int]:
        """The cells that a tile has, with those around it: from x, from y, to x, to y."""
        x, y, m = tile // self.across * self.long, tile % self.across * self.wide, self.around
        return max(x - m, 0), max(y - m, 0), min(x + self.long + m, self.grid.nx), min(y + self.wide + m, self.grid.ny)

    def holding(self, x: Column, y: Column) -> Column:
        """The tiles that have a cell."""
        at = lambda c, d, n: F.least(F.greatest(c + d, F.lit(0)), F.lit(n - 1))
        ways = (-self.around, 0, self.around)
        return F.array_distinct(F.array(*(F.floor(at(x, dx, self.grid.nx) / self.long) * self.across + F.floor(at(y, dy, self.grid.ny) / self.wide) for dx in ways for dy in ways)))


class Field:
    """Columns of the cells of a grid or of one tile of it, with the cells around the tile."""

    def __init__(self, grid: Grid, table: pa.Table, columns: list[str], tile: int | None = None, tiles: Tiles | None = None):
        self.grid = grid
        self.x0, self.y0, x1, y1 = (0, 0, grid.nx, grid.ny) if tile is None else tiles.reach(tile)
        # The last cells need their neighbours, unless the grid ends there.
        self.own = (self.x0, self.y0, x1 - (x1 < grid.nx), y1 - (y1 < grid.ny))
        wide, self.ny = x1 - self.x0, y1 - self.y0
        n = table.column("n").to_numpy()
        at = (n // grid.ny - self.x0) * self.ny + n % grid.ny - self.y0
        self.values = {}
        for c in columns:
            self.values[c] = np.full(wide * self.ny, np.nan)
            self.values[c][at] = table.column(c).to_numpy().astype(float)

    def at(self, column: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.values[column][(i - self.x0) * self.ny + j - self.y0]

    def of(self, column: str, cell: np.ndarray) -> np.ndarray:
        return self.at(column, cell // self.grid.ny, cell % self.grid.ny)

    def owns(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = self.own
        return (px >= x0) & (py >= y0) & (px < x1) & (py < y1)

    def between(self, column: str, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """The value between four cells; NaN beyond the last cell's corner."""
        g = self.grid
        i, j = np.floor(px).astype(int), np.floor(py).astype(int)
        a, b = np.where(i >= g.nx - 1, 0, px - i), np.where(j >= g.ny - 1, 0, py - j)
        i2, j2 = np.minimum(i + 1, g.nx - 1), np.minimum(j + 1, g.ny - 1)
        at = lambda x, y: self.at(column, x, y)
        v = (at(i, j) * (1 - b) + at(i, j2) * b) * (1 - a) + (at(i2, j) * (1 - b) + at(i2, j2) * b) * a
        return np.where((px > g.nx - 1) | (py > g.ny - 1), np.nan, v)


def _stepsize(px: np.ndarray, py: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The mean of the ways to the next border along x and along y, each at most sqrt(2)."""
    ways = []
    for p, d in ((px, dx), (py, dy)):
        low = np.floor(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            ways.append(np.fmin(np.fmax((low - p) / d, (low + 1 - p) / d), np.sqrt(2)))
    return (ways[0] + ways[1]) / 2


def _norm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By operations that round alike everywhere, as errors grow along a path."""
    return np.sqrt(x * x + y * y)


def _cell(grid: Grid, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    return np.floor(px).astype(int) * grid.ny + np.floor(py).astype(int)


def _inside(grid: Grid, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """False also where the place is NaN."""
    return (px >= 0) & (py >= 0) & (px < grid.nx) & (py < grid.ny)


class Walk:
    """How one kind of particle begins and steps.

    A particle's state is a column of numbers: place (2), last cell, steps so far, then what the kind needs.
    """

    fields: list[str]
    names: list[str]
    limit: int

    def __init__(self, grid: Grid, seed: int):
        self.grid, self.seed = grid, seed

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """0.5 to n - 0.5 along each axis, from the particle's number alone."""
        u, v = 1 - _uniform(ids * 2, self.seed), 1 - _uniform(ids * 2 + 1, self.seed)
        return 0.5 + u * (self.grid.nx - 1), 0.5 + v * (self.grid.ny - 1)

    def begin(self, f: Field, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def step(self, f: Field, state: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state one step on from `cell`, and which particles go on."""
        raise NotImplementedError

    def left(self, state: np.ndarray) -> np.ndarray:
        """What a particle leaves in a cell that it enters, a row for each name."""
        raise NotImplementedError

    def run(self, f: Field, state: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Walks particles while the field owns their places, adding what they leave to total; returns those that left."""
        gone = [state[:, :0]]
        place = lambda cell: (cell // self.grid.ny - f.x0) * f.ny + cell % self.grid.ny - f.y0
        while state.shape[1]:
            here = f.owns(state[0], state[1])
            gone.append(state[:, ~here])
            state = state[:, here]
            cell = _cell(self.grid, state[0], state[1])
            new = cell != state[2]
            if new.any():
                for row, v in zip(total, self.left(state[:, new]), strict=True):
                    np.add.at(row, place(cell[new]), v)
            with np.errstate(all="ignore"):
                state, keep = self.step(f, state, cell)
            state[2], state[3] = cell, state[3] + 1
            state = state[:, keep & (state[3] < self.limit) & _inside(self.grid, state[0], state[1])]
        return np.concatenate(gone, axis=1)


def _walked(cells: DataFrame, grid: Grid, walk: Walk, count: int) -> DataFrame:
    """n and the names' sums over `count` particles. Tasks sum what their particles leave before the shuffle.

    Fields of up to FIELD_BYTES go to every task. Larger ones stay distributed: each round, every tile meets the
    particles on it, walks them to its border, and the next round begins where they went on.
    """
    ship(cells.sparkSession)
    flux = _walked_whole(cells, grid, walk, count) if grid.cells * 8 * len(walk.fields) <= FIELD_BYTES else _walked_tiled(cells, grid, walk, count)
    return flux.groupBy("n").agg(*(F.sum(c).alias(c) for c in walk.names))


def _parts(cells: DataFrame, count: int) -> int:
    return max(1, min(cells.sparkSession.sparkContext.defaultParallelism * 2, count // 4096))


def _walked_whole(cells: DataFrame, grid: Grid, walk: Walk, count: int) -> DataFrame:
    spark = cells.sparkSession
    with shuffles_removed(spark):
        table = cells.select("n", *walk.fields).toArrow()
    shared = spark.sparkContext.broadcast(Field(grid, table, walk.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        total = np.zeros((len(walk.names), grid.cells))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k in range(0, len(ids), PARTICLES):
                px, py = walk.places(ids[k : k + PARTICLES])
                ok = _inside(grid, px, py)
                with np.errstate(all="ignore"):
                    state = walk.begin(f, px[ok], py[ok])
                walk.run(f, state, total)
        hit = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), *(pa.array(t[hit]) for t in total)], names=["n", *walk.names])

    return spark.range(0, count, 1, _parts(cells, count)).mapInArrow(run, "n long, " + ", ".join(f"{c} double" for c in walk.names))


def _walked_tiled(cells: DataFrame, grid: Grid, walk: Walk, count: int) -> DataFrame:
    """Cells are dealt to their tiles once, in buckets of files that no round shuffles again; what is shuffled are particles.

    A particle changes tiles where it has left the cells around its own, so rounds follow the length of ways, not how often
    they cross a border.
    """
    spark, tiles = cells.sparkSession, Tiles(grid)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py = walk.places(batch.column(0).to_numpy())
            ok = _inside(grid, px, py)
            yield rows(tiles.of(px[ok], py[ok]), np.stack([px[ok], py[ok]]))

    def rows(key: np.ndarray, values: np.ndarray, kind: int = 1) -> pa.RecordBatch:
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * len(values), pa.int32()), pa.array(values.T.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), each], names=["kind", "key", "values"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [rows(np.zeros(0), np.zeros((1, 0)))]
        if left.num_rows and right.num_rows:
            f = Field(grid, left, walk.fields, left.column("key")[0].as_py(), tiles)
            total = np.zeros((len(walk.names), len(f.values[walk.fields[0]])))
            given = right.column("values").combine_chunks()
            given = given.chunk(0) if isinstance(given, pa.ChunkedArray) else given
            given = given.flatten().to_numpy().reshape(len(given), -1).T
            for k in range(0, given.shape[1], PARTICLES):
                state = given[:, k : k + PARTICLES].copy()
                if len(state) == 2:
                    with np.errstate(all="ignore"):
                        state = walk.begin(f, state[0], state[1])
                gone = walk.run(f, state, total)
                out.append(rows(tiles.of(gone[0], gone[1]), gone))
            hit = np.flatnonzero(total.any(axis=0))
            out.append(rows((hit // f.ny + f.x0) * grid.ny + hit % f.ny + f.y0, total[:, hit], 0))
        return pa.Table.from_batches(out)

    each = cells.select("n", *walk.fields, F.explode(tiles.holding(F.col("x"), F.col("y"))).alias("key"))
    schema = "kind int, key long, values array<double>"
    parts, live = [], settled(spark.range(0, count, 1, _parts(cells, count)).mapInArrow(start, schema))
    with bucketed(each, "key", min(tiles.count * 4, 1024)) as dealt:
        while True:
            # Flow gathers particles: a crowded tile goes to several tasks, a tile without particles to none.
            crowds = settled(live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("tasks")))
            found = crowds.collect()  # a row for each tile that has particles
            if not found:
                break
            held, asked, keys = dealt.where(F.col("key").isin([r["key"] for r in found])), live, ["key"]
            if max(r["tasks"] for r in found) > 1:
                held, keys = held.join(F.broadcast(crowds), "key").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))), ["key", "task"]
                asked = live.join(F.broadcast(crowds), "key").withColumn("task", F.pmod(F.xxhash64("values"), F.col("tasks")).cast("int"))
            held, asked = held.select(*keys, "n", *walk.fields), asked.select(*keys, "values")
            done = settled(held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, schema))
            parts.append(done.where("kind = 0").select(F.col("key").alias("n"), *(F.col("values")[k].alias(c) for k, c in enumerate(walk.names))))
            if len(parts) > KEPT_ROUNDS:
                parts = [settled(reduce(DataFrame.unionAll, parts).groupBy("n").agg(*(F.sum(c).alias(c) for c in walk.names)))]
            live = done.where("kind = 1")
    if not parts:
        return spark.createDataFrame([], "n long, " + ", ".join(f"{c} double" for c in walk.names))
    return reduce(DataFrame.unionAll, parts)


class UniformWalk(Walk):
    def __init__(self, grid: Grid, seed: int, sources: list[str]):
        super().__init__(grid, seed)
        self.sources, self.fields, self.names = sources, ["vx", "vy", "decay", *sources], [f"flux_{s}" for s in sources]
        self.limit, self.length = grid.nx + grid.ny, (grid.sx**2 + grid.sy**2) ** 0.5

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (1 - _uniform(ids * 2, self.seed)) * self.grid.nx, (1 - _uniform(ids * 2 + 1, self.seed)) * self.grid.ny

    def begin(self, f: Field, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        cell, whole = _cell(self.grid, px, py), self.grid.sx * self.grid.sy * self.grid.cells
        carried = [f.of(s, cell) * whole for s in self.sources]
        state = np.stack([px, py, cell.astype(float), np.zeros(len(px)), np.ones(len(px)), *carried])
        return state[:, (np.abs(state[5:]) >= 1e-16).any(axis=0)]

    def left(self, state: np.ndarray) -> np.ndarray:
        return state[5:] * state[4]

    def step(self, f: Field, state: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        px, py, att = state[0], state[1], state[4]
        vx, vy = f.between("vx", px, py), f.between("vy", px, py)
        speed = _norm(vx, vy)
        step = _stepsize(px, py, vx / speed, vy / speed)
        att = att * np.exp(-step * self.length / speed * f.of("decay", cell))
        state = np.concatenate([np.stack([px + step * vx / speed, py + step * vy / speed]), state[2:4], att[None], state[5:]])
        return state, (speed >= 1e-16) & (np.abs(att) > 1e-16)


def solve_uniform(cells: DataFrame, grid: Grid, count: int, sources: list[str], seed: int = 0) -> DataFrame:
    """n and flux_<source>: what particles from uniform starts carry along the flow (vx, vy), losing `decay` on the way.

    cells: n, x, y, vx, vy, decay and one or two sources. A start cell gets nothing, as its own source is added at the
    end; where there is no flow the result is NULL.
    """
    if len(sources) not in (1, 2):
        raise ValueError("one or two channels")
    walk = UniformWalk(grid, seed, sources)
    flux = _walked(cells, grid, walk, count)
    speed = F.abs("vx") * grid.sy + F.abs("vy") * grid.sx
    rows = cells.select("n", "vx", "vy", *sources).join(flux, "n", "left")
    return rows.select("n", *(over(F.col(s) * (grid.sx * grid.sy) + F.coalesce(k, F.lit(0.0)) / count, speed).alias(k) for s, k in zip(sources, walk.names, strict=True)))


def _sloped(cells: DataFrame, grid: Grid, p: Params) -> DataFrame:
    ux, uy = upwind_columns(grid.sx, grid.sy, grid.sz, p.exit_slope)
    rows = neighbourhood(cells, ["bedrock", "sediment"])
    return rows.select(*cells.columns, ux.alias("ux"), uy.alias("uy"))


class SlopeWalk(Walk):
    """Particles that the slope drives; a kind says what slows them and what they carry."""

    def __init__(self, grid: Grid, seed: int, samples: int, p: Params, velocity: tuple[str, str], viscosity: float, force: tuple[float, float]):
        super().__init__(grid, seed)
        self.p, self.velocity, self.viscosity, self.force = p, velocity, viscosity, force
        self.limit, self.length = p.maxage - 1, (grid.sx**2 + grid.sy**2) ** 0.5
        self.share = grid.sx * grid.sy * grid.cells / samples

    def pull(self, f: Field, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(-self.p.gravity * f.of(u, cell) + self.viscosity * f.of(v, cell) for u, v in zip(("ux", "uy"), self.velocity, strict=True))

    def steepness(self, f: Field, cell: np.ndarray) -> np.ndarray:
        return _norm(f.of("ux", cell), f.of("uy", cell))

    def sources(self, f: Field, cell: np.ndarray, pull: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def begin(self, f: Field, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        cell = _cell(self.grid, px, py)
        pull = self.pull(f, cell)
        sx, sy = pull[0] + self.force[0], pull[1] + self.force[1]
        root = np.sqrt(_norm(self.grid.sx * sx, self.grid.sy * sy))
        sx, sy = sx / root, sy / root
        kinds = np.ones((self.shares, len(px)))
        state = np.concatenate([np.stack([px, py, cell.astype(float), np.zeros(len(px)), sx, sy]), kinds, self.sources(f, cell, pull)])
        return state[:, np.hypot(sx, sy) >= EPS]

    def left(self, state: np.ndarray) -> np.ndarray:
        return state[6 + self.shares :] * state[6 : 6 + self.shares][self.kind]

    def step(self, f: Field, state: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        px, py, sx, sy = state[0], state[1], state[4], state[5]
        att, source = state[6 : 6 + self.shares], state[6 + self.shares :]
        speed = _norm(sx, sy)
        step = _stepsize(px, py, sx / speed, sy / speed)
        way = step * self.length
        slow, fade = self.losses(f, cell, att, source, speed, way)
        pull = self.pull(f, cell)
        ahead = [(s + way * (a + e)) / (1 + way * slow) for s, a, e in zip((sx, sy), pull, self.force, strict=True)]
        moved = np.stack([px + step * sx / speed, py + step * sy / speed])
        return np.concatenate([moved, state[2:4], np.stack(ahead), att * fade, source]), (speed >= EPS) & np.isfinite(fade).all(axis=0)


class WaterWalk(SlopeWalk):
    fields = ["ux", "uy", "rain", "water", "vx", "vy", "r", "g", "b"]
    names = ["f_w", "f_m", "f_x", "f_y", "f_r", "f_g", "f_b"]
    shares, kind = 3, np.array([0, 1, 2, 2, 1, 1, 1])  # of water, mass, velocity

    def sources(self, f: Field, cell: np.ndarray, pull: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        p = self.p
        shear = 0.125 * p.friction_factor / 8 * p.density_water * (f.of("vx", cell) ** 2 + f.of("vy", cell) ** 2)
        mass = self.share * p.suspension_fluvial / 64 * (shear * self.steepness(f, cell)) ** p.fluvial_exponent
        return np.stack([self.share * p.rainfall * f.of("rain", cell), mass, self.share * pull[0], self.share * pull[1], *(mass * f.of(c, cell) for c in "rgb")])

    def losses(self, f: Field, cell, att, source, speed, way) -> tuple[float, np.ndarray]:
        p, time = self.p, way / speed
        drag = 0.125 * p.friction_factor / 8 / (EPS + f.of("water", cell))
        return p.bed_shear_water + p.viscosity_water, np.stack([np.exp(-time * p.evap_rate), np.exp(-time * p.deposition_fluvial * 1.33), np.exp(-way * drag)])


class DebrisWalk(SlopeWalk):
    fields = ["ux", "uy", "dvx", "dvy", "r", "g", "b"]
    names = ["f_d", "f_x", "f_y", "f_r", "f_g", "f_b"]
    shares, kind = 2, np.array([0, 1, 1, 0, 0, 0])  # of debris, velocity

    def sources(self, f: Field, cell: np.ndarray, pull: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        load = self.share * np.maximum(0, self.p.landslide_rate * (self.steepness(f, cell) - self.p.crit_slope_bedrock))
        return np.stack([load, self.share * pull[0], self.share * pull[1], *(load * f.of(c, cell) for c in "rgb")])

    def losses(self, f: Field, cell, att, source, speed, way) -> tuple[np.ndarray, np.ndarray]:
        p, height = self.p, EPS + att[0] * source[0]
        slow = p.viscosity_debris + p.bed_shear_debris / height
        stress = p.gravity * (self.steepness(f, cell) - p.crit_slope_bedrock - p.yield_stress / height)
        rate = np.where(stress < 0, p.deposition_debris, p.suspension_debris)
        return slow, np.stack([np.exp(way / speed * rate * stress / speed), np.exp(-way * slow)])


def transport_fluvial(cells: DataFrame, grid: Grid, samples: int, param: Params = Params(), seed: int = 0) -> DataFrame:
    """n, water, mass, vx, vy, albedo_r, albedo_g, albedo_b after one round of particles.

    cells: n, x, y, bedrock, sediment, rain, water, vx, vy, r, g, b. Each particle takes its start's sources along a
    path that slope, drag and the body force bend. Particles whose speed is no number end.
    """
    p, area = param, grid.sx * grid.sy
    rows = _sloped(cells, grid, p)
    flux = _walked(rows, grid, WaterWalk(grid, seed, samples, p, ("vx", "vy"), p.viscosity_water, p.force), samples)
    rows = rows.join(flux, "n", "left").fillna(0.0, WaterWalk.names)
    coloured = (F.col("f_m") > 0) & (F.abs("f_r") + F.abs("f_g") + F.abs("f_b") > 0)
    return rows.select(
        "n", ((area * p.rainfall * F.col("rain") + F.col("f_w")) / grid.sy).alias("water"), (F.col("f_m") / grid.sy).alias("mass"),
        *(((area * (-p.gravity * F.col(u) + force) + F.col(k)) / grid.sy).alias(v) for u, k, v, force in (("ux", "f_x", "vx", p.force[0]), ("uy", "f_y", "vy", p.force[1]))),
        *(F.when(coloured, over(F.col(f"f_{c}"), F.col("f_m"))).otherwise(F.col(c)).alias(f"albedo_{c}") for c in "rgb"),
    )


def transport_debris(cells: DataFrame, grid: Grid, samples: int, param: Params = Params(), seed: int = 1) -> DataFrame:
    """n, debris, dvx, dvy, albedo_r, albedo_g, albedo_b after one round of particles.

    cells: n, x, y, bedrock, sediment, dvx, dvy, r, g, b. Starts steeper than the critical slope let debris go; on the
    way it may take up more than it began with.
    """
    p, area = param, grid.sx * grid.sy
    rows = _sloped(cells, grid, p)
    flux = _walked(rows, grid, DebrisWalk(grid, seed, samples, p, ("dvx", "dvy"), p.viscosity_debris, (0.0, 0.0)), samples)
    rows = rows.join(flux, "n", "left").fillna(0.0, DebrisWalk.names)
    return rows.select(
        "n", (F.col("f_d") / grid.sy).alias("debris"), ((-area * p.gravity * F.col("ux") + F.col("f_x")) / grid.sy).alias("dvx"), ((-area * p.gravity * F.col("uy") + F.col("f_y")) / grid.sy).alias("dvy"),
        *(F.when(F.col("f_d") > 0, over(F.col(f"f_{c}"), F.col("f_d"))).otherwise(F.col(c)).alias(f"albedo_{c}") for c in "rgb"),
    )
