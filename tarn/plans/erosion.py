"""The erosion loop: transport, exchange, creep, then the layers are updated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import raster, terrain, transport
from tarn.plans.model import Grid, Params
from tarn.plans.state import forget, scratch, settled


def erosion_step(cells: DataFrame, grid: Grid, samples: int, param: Params = Params(), seed: int = 0) -> DataFrame:
    """One step. cells: n, x, y, bedrock, sediment, rain, uplift, water, mass, vx, vy, debris, dvx, dvy, r, g, b."""
    with scratch() as keep:
        return keep(_step(cells, grid, samples, param, seed))


def _step(cells: DataFrame, grid: Grid, samples: int, param: Params, seed: int) -> DataFrame:
    fluvial = settled(transport.transport_fluvial(cells, grid, samples, param, seed).select("n", "water", "mass", "vx", "vy"))
    slides = settled(transport.transport_debris(cells, grid, samples, param, seed + 1).select("n", "debris", "dvx", "dvy"))
    rest = cells.select("n", "x", "y", "bedrock", "sediment", "rain", "uplift", "r", "g", "b")
    state = fluvial.join(slides, "n")
    layers = cells.select("n", "x", "y", "bedrock", "sediment")
    moved = terrain.mass_transfer(layers, state, cells.select("n", "uplift"), grid, param)
    crept = terrain.mass_creep(layers, grid, param).select("n", F.col("d_sediment").alias("creep"))
    delta = moved.join(crept, "n").select("n", "d_bedrock", (F.col("d_sediment") + F.col("creep")).alias("d_sediment"))
    return settled(terrain.apply_delta(rest, delta).join(state, "n"))


def erode(cells: DataFrame, grid: Grid, samples: int, steps: int, param: Params = Params(), seed: int = 0) -> DataFrame:
    """So many steps; a step's tables are removed once the next one has its own."""
    for k in range(steps):
        before, cells = cells, erosion_step(cells, grid, samples, param, seed + 2 * k)
        if k:
            forget(before)
    return cells


def erode_levels(cells: DataFrame, grid: Grid, levels: list[tuple[Grid, int]], samples: int, param: Params = Params(), seed: int = 0) -> DataFrame:
    """Erosion on ever finer grids: on each level the state of the one before is resized and takes so many steps."""
    made = False
    for k, (level, steps) in enumerate(levels):
        columns = [c for c in cells.columns if c not in ("n", "x", "y")]
        if (level.nx, level.ny) != (grid.nx, grid.ny):
            before, cells = cells, settled(raster.resize_bilinear(cells, grid, level, columns))
            if made:
                forget(before)
            made = True
        grid = level
        if steps:
            before, cells = cells, erode(cells, grid, samples, steps, param, seed + 1000 * k)
            if made:
                forget(before)
            made = True
    return cells
