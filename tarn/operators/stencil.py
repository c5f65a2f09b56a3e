"""Operators over a cell and its neighbours."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.values import known, norm2
from tarn.plans.model import Edge

#: Rows and columns of a tile; the cells around it are copied into it.
TILE = 256


def in_tiles(raster: DataFrame, radius: int, side: int) -> DataFrame:
    """The cells dealt into square tiles of the grid, each with copies of the cells up to `radius` around it.

    So a task holds a few tiles, however wide the raster is. A tile's own cells have __own.
    """
    if radius > side:
        raise ValueError("a tile must be as wide as what it looks at")

    def near(c: str) -> Column:
        # Constant arrays: a lambda for each cell would cost more than the shuffle.
        at = F.col(c) % side
        low, high, to = at < radius, at >= side - radius, lambda *steps: F.array(*(F.lit(k) for k in steps))
        return F.explode(F.when(low & high, to(0, -1, 1)).when(low, to(0, -1)).when(high, to(0, 1)).otherwise(to(0)))

    rows = raster.withColumn("__bx", near("x")).withColumn("__by", near("y"))
    tile = {"__tx": F.floor(F.col("x") / side).cast("int") + F.col("__bx"), "__ty": F.floor(F.col("y") / side).cast("int") + F.col("__by")}
    return rows.withColumns(tile | {"__own": (F.col("__bx") == 0) & (F.col("__by") == 0)}).repartition("__tx", "__ty")


def neighbourhood(raster: DataFrame, columns: list[str], side: int = TILE) -> DataFrame:
    """The rows with what `neighbour` reads: the columns of the eight cells around each, NULL outside.

    Tiles get copies of the cells beside them, and one shuffle by tile serves both windows: along x, then, with what
    that found, along y. Needs a dense grid; the columns keep NaN.
    """
    rows = in_tiles(raster.withColumn("__v", F.struct(*columns)), 1, side)
    along = Window.partitionBy("__tx", "__ty", "y").orderBy("x")
    pick = lambda f, w, c, v, d: F.when(f(c, 1).over(w) == F.col(c) + d, f(v, 1).over(w))
    rows = rows.withColumns({"__up": pick(F.lag, along, "x", "__v", -1), "__down": pick(F.lead, along, "x", "__v", 1)})
    rows = rows.withColumn("__c", F.struct("__up", "__v", "__down"))
    across = Window.partitionBy("__tx", "__ty", "x").orderBy("y")
    rows = rows.withColumns({"__left": pick(F.lag, across, "y", "__c", -1), "__right": pick(F.lead, across, "y", "__c", 1)})
    return rows.where("__own")


def neighbour(dx: int, dy: int, column: str) -> Column:
    """A neighbour's value in a neighbourhood."""
    name = {-1: "__up", 0: "__v", 1: "__down"}[dx]
    return F.col(name if dy == 0 else f"{'__left' if dy < 0 else '__right'}.{name}")[column]


def _plain(rows: DataFrame, *added: Column) -> DataFrame:
    return rows.select(*(c for c in rows.columns if not c.startswith("__")), *added)


def gradient(raster: DataFrame, sx: float = 1.0, sy: float = 1.0, v: str = "h") -> DataFrame:
    """gx, gy: central differences, one-sided where a neighbour is missing, else zero; a missing cell may have one."""
    rows, own = neighbourhood(raster, [v]), known(F.col(v))

    def along(dx: int, dy: int, s: float) -> Column:
        low, high = known(neighbour(-dx, -dy, v)), known(neighbour(dx, dy, v))
        return F.coalesce(0.5 * (high - low) / s, (own - low) / s, (high - own) / s, F.lit(0.0))

    return _plain(rows, along(1, 0, sx).alias("gx"), along(0, 1, sy).alias("gy"))


def along(gradients: DataFrame, dx: float, dy: float) -> DataFrame:
    """along: the slope in the direction (dx, dy), from gx and gy."""
    size = math.hypot(dx, dy)
    return gradients.withColumn("along", F.col("gx") * (dx / size) + F.col("gy") * (dy / size))


def negslope(raster: DataFrame, sx: float = 1.0, sy: float = 1.0, v: str = "h") -> DataFrame:
    """slope: the length of the steepest descent along x and y; zero in pits."""
    rows, own = neighbourhood(raster, [v]), known(F.col(v))
    down = lambda dx, dy, s: F.greatest(F.lit(0.0), (own - known(neighbour(-dx, -dy, v))) / s, (own - known(neighbour(dx, dy, v))) / s)
    return _plain(rows, norm2(down(1, 0, sx), down(0, 1, sy)).alias("slope"))


def laplacian(raster: DataFrame, columns: list[str], sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """l_<column> for one or two columns: half the straight, half the diagonal stencil; outside counts as the cell."""
    if len(columns) not in (1, 2):
        raise ValueError("one or two channels")
    hx, hy = 1 / sx**2, 1 / sy**2
    rows = neighbourhood(raster, columns)

    def of(c: str) -> Column:
        d = lambda dx, dy: F.coalesce(neighbour(dx, dy, c), F.col(c)) - F.col(c)
        straight = (d(-1, 0) + d(1, 0)) * hx + (d(0, -1) + d(0, 1)) * hy
        diagonal = 0.5 * (d(-1, -1) * hx + d(1, 1) * hx + d(1, -1) * hy + d(-1, 1) * hy)
        return 0.5 * straight + 0.5 * diagonal

    return _plain(rows, *(of(c).alias(f"l_{c}") for c in columns))


def normal(raster: DataFrame, sx: float = 1.0, sy: float = 1.0, sz: float = 1.0, v: str = "h") -> DataFrame:
    """nx, ny, nz: the surface's unit normal."""
    g = gradient(raster, sx, sy, v)
    a, b = F.col("gx") * sz, F.col("gy") * sz
    size = F.sqrt(a * a + b * b + 1)
    return g.select(*raster.columns, (-a / size).alias("nx"), (-b / size).alias("ny"), (1 / size).alias("nz"))


def relief_shade(normals: DataFrame) -> DataFrame:
    """shade: the normal along the light (-1, 2, 1) / sqrt(6)."""
    return normals.withColumn("shade", (-F.col("nx") + 2 * F.col("ny") + F.col("nz")) / 6**0.5)


def upwind(h: Column, low: Column, high: Column, scale: float, exit_slope: float) -> Column:
    """The steeper of the two one-sided slopes (the lower side on ties); missing neighbours count as exits."""
    fall = F.greatest(F.lit(0.0), F.coalesce((h - known(low)) * scale, F.lit(exit_slope)))
    rise = F.least(F.lit(0.0), F.coalesce((known(high) - h) * scale, F.lit(-exit_slope)))
    return F.when(F.abs(rise) > F.abs(fall), rise).otherwise(fall)


def upwind_gradient(layers: DataFrame, sx: float = 1.0, sy: float = 1.0, sz: float = 1.0, exit_slope: float = 0.02) -> DataFrame:
    """ux, uy of bedrock + sediment."""
    rows = neighbourhood(layers, ["bedrock", "sediment"])
    return _plain(rows, *(g.alias(n) for g, n in zip(upwind_columns(sx, sy, sz, exit_slope), ("ux", "uy"), strict=True)))


def upwind_columns(sx: float, sy: float, sz: float, exit_slope: float) -> tuple[Column, Column]:
    at = lambda dx, dy: neighbour(dx, dy, "bedrock") + neighbour(dx, dy, "sediment")
    return upwind(at(0, 0), at(-1, 0), at(1, 0), sz / sx, exit_slope), upwind(at(0, 0), at(0, -1), at(0, 1), sz / sy, exit_slope)


def drops(edge: Edge, v: str = "h") -> list[Column]:
    """For each shift, the drop to that neighbour over the distance in cells; NULL without a neighbour, NaN kept."""
    return [(F.col(v) - neighbour(dx, dy, v)) / ((dx * dx + dy * dy) ** 0.5) for dx, dy in edge.shifts]


def gaussian_blur(raster: DataFrame, columns: list[str], sigma: float, radius: int = 16, normalize: bool = False, side: int = TILE) -> DataFrame:
    """The columns blurred along x, then y: 2 * radius + 1 taps, edges repeated; weights don't sum to one by default."""
    if len(columns) not in (1, 2):
        raise ValueError("one or two channels")
    weights = [_tap(k, sigma) for k in range(-radius, radius + 1)]
    if normalize:
        weights = [w / sum(weights) for w in weights]
    # A tile's own cells only lack neighbours where the grid ends, so what they repeat is the grid's edge.
    out = in_tiles(raster, radius, max(side, radius))
    for fixed, moving in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("__tx", "__ty", fixed).orderBy(moving)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def tap(c: str, k: int, w=w, whole=whole) -> Column:
            if k == 0:
                return F.col(c)
            return F.coalesce(F.lag(c, -k).over(w), F.first(c).over(whole)) if k < 0 else F.coalesce(F.lead(c, k).over(w), F.last(c).over(whole))

        out = out.withColumns({c: reduce(operator.add, (tap(c, k) * w_ for k, w_ in zip(range(-radius, radius + 1), weights, strict=True))) for c in columns})
    return _plain(out.where("__own"))


def _tap(k: int, sigma: float) -> float:
    return math.exp(-0.5 * (k / sigma) ** 2) / (math.sqrt(2 * math.pi) * sigma)
