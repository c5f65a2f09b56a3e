"""Fractal value noise over integer-hashed lattice points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.values import uniform
from tarn.plans.model import Grid, NoiseParams, with_cells


def _lattice(i: Column, j: Column, seed: int) -> Column:
    """The value at a lattice point, in [-1, 1)."""
    return uniform((i.cast("long") % 32768) * 32768 + j.cast("long") % 32768, seed) * 2 - 1


def noise(spark: SparkSession, grid: Grid, param: NoiseParams = NoiseParams()) -> DataFrame:
    """n, x, y and h: octaves of smoothed value noise at (x / ext0, y / ext1), scaled to the sum of their gains."""
    cells = with_cells(spark.range(grid.cells).withColumnRenamed("id", "n"), F.col("n"), grid.ny)
    total, weight, frequency, bound = F.lit(0.0), 1.0, param.frequency, 0.0
    for k in range(param.octaves):
        u, v = F.col("x") * (frequency / param.ext[0]), F.col("y") * (frequency / param.ext[1])
        i, j = F.floor(u), F.floor(v)
        a, b = u - i, v - j
        a, b = a * a * (3 - 2 * a), b * b * (3 - 2 * b)
        p = [[_lattice(i + di, j + dj, param.seed + k) for dj in (0, 1)] for di in (0, 1)]
        low, high = p[0][0] * (1 - b) + p[0][1] * b, p[1][0] * (1 - b) + p[1][1] * b
        total = total + (low * (1 - a) + high * a) * weight
        bound, weight, frequency = bound + weight, weight * param.gain, frequency * param.lacunarity
    return cells.withColumn("h", total / bound)


#: Skew of a lattice of cubes along its diagonal that makes six equal tetrahedra of each, and back: fixed values.
SKEW, UNSKEW = 1 / 3, 1 / 6


def _gradient(g: Column, x: Column, y: Column, z: Column) -> Column:
    """The vector (x, y, z) along one of the twelve directions to the middles of a cube's edges."""
    first = F.when(g < 8, x).otherwise(y)
    second = F.when(g < 4, y).otherwise(z)
    return F.when(g % 2 == 0, first).otherwise(-first) + F.when(F.floor(g / 2) % 2 == 0, second).otherwise(-second)


def simplex_noise(cells: DataFrame, param: NoiseParams = NoiseParams(), into: str = "h") -> DataFrame:
    """The cells (x, y and any other columns) with octaves of gradient noise at (x / ext0, y / ext1, seed), over the sum of
    their gains.

    Space is cut in tetrahedra by a skewed lattice; each of the four corners around a point adds its gradient along the
    way to the point, weighed by (0.6 - distance^2)^4, times 32. Gradients come from the integer hash, with another
    seed for each octave. Columns are added octave by octave, so that nothing is computed twice; no shuffle, no Python.
    """
    rows, total, bound, weight, frequency = cells, F.lit(0.0), 0.0, 1.0, param.frequency
    for octave in range(param.octaves):
        at = {"__u": F.col("x") * (frequency / param.ext[0]), "__v": F.col("y") * (frequency / param.ext[1]), "__w": F.lit(param.seed * frequency)}
        rows = rows.withColumns(at).withColumn("__s", (F.col("__u") + F.col("__v") + F.col("__w")) * SKEW)
        rows = rows.withColumns({k: F.floor(F.col(c) + F.col("__s")) for k, c in (("__i", "__u"), ("__j", "__v"), ("__k", "__w"))})
        rows = rows.withColumn("__t", (F.col("__i") + F.col("__j") + F.col("__k")) * UNSKEW)
        rows = rows.withColumns({d: F.col(c) - F.col(k) + F.col("__t") for d, c, k in (("__x", "__u", "__i"), ("__y", "__v", "__j"), ("__z", "__w", "__k"))})
        x, y, z = (F.col(c) for c in ("__x", "__y", "__z"))
        # The rank of each offset, 2 for the largest, says when the walk from corner to corner steps along its axis.
        one = lambda c: c.cast("int")
        rows = rows.withColumns({"__rx": one(x >= y) + one(x >= z), "__ry": one(y > x) + one(y >= z), "__rz": one(z > x) + one(z > y)})
        parts = []
        for corner in range(4):
            step = [one(F.col(r) >= 3 - corner) for r in ("__rx", "__ry", "__rz")]
            d = [c - s + corner * UNSKEW for c, s in zip((x, y, z), step, strict=True)]
            cell = [F.pmod(F.col(c) + s, F.lit(1024)) for c, s in zip(("__i", "__j", "__k"), step, strict=True)]
            g = F.floor(uniform((cell[0] * 1024 + cell[1]) * 1024 + cell[2], param.seed + octave) * 12)
            near, along = f"__n{corner}", f"__a{corner}"
            rows = rows.withColumns({f"__g{corner}": g, near: F.greatest(0.6 - d[0] * d[0] - d[1] * d[1] - d[2] * d[2], F.lit(0.0))})
            rows = rows.withColumn(along, _gradient(F.col(f"__g{corner}"), *d))
            parts.append(F.col(near) * F.col(near) * F.col(near) * F.col(near) * F.col(along))
        rows = rows.withColumn(f"__o{octave}", (parts[0] + parts[1] + parts[2] + parts[3]) * 32)
        total = total + F.col(f"__o{octave}") * weight
        bound, weight, frequency = bound + weight, weight * param.gain, frequency * param.lacunarity
    return rows.select(*(F.col(f"`{c}`") for c in cells.columns if c != into), (total / bound).alias(into))
