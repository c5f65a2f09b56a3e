"""Points between cells, and sequences of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.values import uniform
from tarn.plans.model import Grid


def at_points(points: DataFrame, raster: DataFrame, grid: Grid, v: str = "h") -> DataFrame:
    """id, value, gx, gy of each point (id, px, py): bilinear between the four cells around, and its slopes.

    At the last row or column the weight of what lies beyond is zero; points outside the grid, and points of which a
    cell is missing or NaN, give NULL. One join: each point asks for its four cells.
    """
    px, py = F.col("px"), F.col("py")
    i, j = F.floor(px), F.floor(py)
    a, b = F.when(i >= grid.nx - 1, F.lit(0.0)).otherwise(px - i), F.when(j >= grid.ny - 1, F.lit(0.0)).otherwise(py - j)
    inside = (px >= 0) & (py >= 0) & (px <= grid.nx - 1) & (py <= grid.ny - 1)
    corners = []
    for di in (0, 1):
        for dj in (0, 1):
            x, y = F.least(i + di, F.lit(grid.nx - 1)), F.least(j + dj, F.lit(grid.ny - 1))
            wa, wb = (a if di else 1 - a), (b if dj else 1 - b)
            corners.append(F.struct((x * grid.ny + y).alias("n"), (wa * wb).alias("w"), ((1 if di else -1) * wb).alias("u"), ((1 if dj else -1) * wa).alias("t")))
    asked = points.where(inside).select("id", F.explode(F.array(*corners)).alias("c")).select("id", "c.*")
    known = F.when(~F.isnan(v), F.col(v))
    got = asked.join(raster.select("n", known.alias("v")), "n").groupBy("id").agg(
        F.count("v").alias("k"), *(F.sum(F.col(w) * F.col("v")).alias(c) for w, c in (("w", "value"), ("u", "gx"), ("t", "gy"))))
    full = [F.when(F.col("k") == 4, F.col(c)).alias(c) for c in ("value", "gx", "gy")]
    return points.select("id").join(got, "id", "left").select("id", *full)


def at_line(points: DataFrame, line: DataFrame, cells: int, v: str = "h") -> DataFrame:
    """id, value, slope of each point (id, p): linear between the two cells (i, v) around; NULL beyond the line or by a
    missing cell. Past the last cell's start the weight of what lies beyond is zero."""
    i = F.floor("p")
    inside = (F.col("p") >= 0) & (F.col("p") <= cells - 1)
    a = F.when(i >= cells - 1, F.lit(0.0)).otherwise(F.col("p") - i)
    ends = F.array(F.struct(i.alias("i"), (1 - a).alias("w"), F.lit(-1.0).alias("u")), F.struct(F.least(i + 1, F.lit(cells - 1)).alias("i"), a.alias("w"), F.lit(1.0).alias("u")))
    asked = points.where(inside).select("id", F.explode(ends).alias("c")).select("id", "c.*")
    known = F.when(~F.isnan(v), F.col(v))
    got = asked.join(line.select("i", known.alias("v")), "i").groupBy("id").agg(F.count("v").alias("k"), F.sum(F.col("w") * F.col("v")).alias("value"), F.sum(F.col("u") * F.col("v")).alias("slope"))
    return points.select("id").join(got, "id", "left").select("id", *(F.when(F.col("k") == 2, F.col(c)).alias(c) for c in ("value", "slope")))


def radical_inverse(k: Column, base: int, digits: int = 20) -> Column:
    """The digits of k in a base, mirrored behind the point."""
    steps = F.sequence(F.lit(1), F.lit(digits))
    return F.aggregate(steps, F.struct(k.cast("long").alias("k"), F.lit(0.0).alias("s"), F.lit(1.0 / base).alias("w")), lambda a, _: F.struct(F.floor(a["k"] / base).alias("k"), (a["s"] + (a["k"] % base) * a["w"]).alias("s"), (a["w"] / base).alias("w")))["s"]


def halton(spark: SparkSession, grid: Grid, count: int) -> DataFrame:
    """id, px, py: a Halton sequence (bases 2 and 3) over the grid."""
    k = F.col("id") + 1
    return spark.range(count).select("id", (radical_inverse(k, 2) * (grid.nx - 1)).alias("px"), (radical_inverse(k, 3) * (grid.ny - 1)).alias("py"))


def random_points(spark: SparkSession, grid: Grid, count: int, seed: int = 0) -> DataFrame:
    """id, px, py: points from the portable hash."""
    return spark.range(count).select("id", (uniform(F.col("id") * 2, seed) * (grid.nx - 1)).alias("px"), (uniform(F.col("id") * 2 + 1, seed) * (grid.ny - 1)).alias("py"))


def select_cells(raster: DataFrame, cells: DataFrame) -> DataFrame:
    return raster.join(cells.select("n"), "n", "left_semi")
