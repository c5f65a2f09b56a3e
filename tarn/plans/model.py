"""Rasters as tables of cells, neighbourhoods and parameters."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Edge(Enum):
    """Neighbourhoods; the order of shifts decides ties."""

    D4 = 0
    D8 = 1

    @property
    def shifts(self) -> list[tuple[int, int]]:
        straight = [(-1, 0), (0, -1), (0, 1), (1, 0)]
        return straight if self is Edge.D4 else [*straight, (-1, -1), (-1, 1), (1, -1), (1, 1)]


def edge_of(edge: Edge | str | int) -> Edge:
    """An Edge, its name or its number; anything else raises."""
    if isinstance(edge, Edge):
        return edge
    try:
        return Edge[edge.upper()] if isinstance(edge, str) else Edge(edge)
    except (KeyError, ValueError):
        raise ValueError(f"unknown edge {edge!r}") from None


@dataclass(frozen=True)
class Grid:
    """Extents and cell scale; cell n of an nx by ny raster is n = x * ny + y."""

    nx: int
    ny: int
    sx: float = 1.0
    sy: float = 1.0
    sz: float = 1.0

    @property
    def cells(self) -> int:
        return self.nx * self.ny


@dataclass(frozen=True)
class Params:
    """Erosion parameters; `lrate` and `density_debris` are accepted and unused."""

    maxage: int = 512
    lrate: float = 1.0
    time_step: float = 250.0
    exit_slope: float = 0.02
    uplift: float = 0.001
    rainfall: float = 1.0
    gravity: float = 9.81
    evap_rate: float = 0.0002
    friction_factor: float = 0.06
    fluvial_exponent: float = 2.0
    suspension_fluvial: float = 4.5e-8
    deposition_fluvial: float = 0.04
    suspension_debris: float = 0.001
    deposition_debris: float = 0.01
    landslide_rate: float = 0.003
    crit_slope_bedrock: float = 0.57
    crit_slope_sediment: float = 0.3
    yield_stress: float = 0.001
    viscosity_water: float = 1e-6
    bed_shear_water: float = 0.0075
    density_water: float = 1.0
    viscosity_debris: float = 0.0
    bed_shear_debris: float = 0.99
    density_debris: float = 2.0
    force: tuple[float, float] = (0.0, 0.0)


@dataclass(frozen=True)
class NoiseParams:
    frequency: float = 1.0
    octaves: int = 8
    gain: float = 0.6
    lacunarity: float = 2.0
    seed: int = 0
    ext: tuple[float, float] = (512.0, 512.0)


def with_cells(df: DataFrame, n: Column, ny: int) -> DataFrame:
    """Adds n, x and y."""
    n = n.cast("long")
    return df.withColumns({"n": n, "x": F.floor(n / ny).cast("int"), "y": (n % ny).cast("int")})


def dense(raster: DataFrame, grid: Grid, fill: dict[str, float] | None = None) -> DataFrame:
    """One row for each cell of the grid; cells that the raster lacks have NULL or the given values."""
    spark = raster.sparkSession
    cells = with_cells(spark.range(grid.cells).withColumnRenamed("id", "n"), F.col("n"), grid.ny)
    out = cells.join(raster.drop("x", "y"), "n", "left")
    return out.fillna(fill) if fill else out


def constant(spark: SparkSession, grid: Grid, value: float, name: str = "h") -> DataFrame:
    return with_cells(spark.range(grid.cells).withColumnRenamed("id", "n"), F.col("n"), grid.ny).withColumn(name, F.lit(float(value)))
