"""Whole-raster operations: arithmetic, extents, mosaics, resampling and meshes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.plans.model import Grid


def arithmetic(a: DataFrame, b: DataFrame, how: str, v: str = "h") -> DataFrame:
    """n, v of two rasters on one grid: add, multiply or set (b's value where it has one)."""
    rows = a.select("n", F.col(v).alias("__a")).join(b.select("n", F.col(v).alias("__b")), "n", "left")
    ops = {"add": F.col("__a") + F.col("__b"), "multiply": F.col("__a") * F.col("__b"), "set": F.coalesce("__b", "__a")}
    if how not in ops:
        raise ValueError(f"unknown operation {how!r}")
    return rows.select("n", ops[how].alias(v))


def concat(*rasters: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rasters)


def shown_discharge(raster: DataFrame, q: str = "q") -> DataFrame:
    """shown: the logarithm of one plus the discharge, as plots have it."""
    return raster.withColumn("shown", F.log(1 + F.col(q)))


def has_sediment(layers: DataFrame, least: float = 1e-4) -> DataFrame:
    return layers.withColumn("covered", F.col("sediment") > least)


def clamp(raster: DataFrame, low: float, high: float, v: str = "h") -> DataFrame:
    return raster.withColumn(v, F.greatest(F.lit(low), F.least(F.col(v), F.lit(high))))


def nodata_to_nan(raster: DataFrame, nodata: float, v: str = "h") -> DataFrame:
    return raster.withColumn(v, F.when(F.col(v) == nodata, F.lit(float("nan"))).otherwise(F.col(v)))


def nan_to_nodata(raster: DataFrame, nodata: float, v: str = "h") -> DataFrame:
    return raster.withColumn(v, F.when(F.isnan(v), F.lit(nodata)).otherwise(F.col(v)))


def world(raster: DataFrame, origin: tuple[float, float], scale: tuple[float, float]) -> DataFrame:
    """wx, wy: where each cell lies."""
    return raster.withColumns({"wx": origin[0] + scale[0] * F.col("x"), "wy": origin[1] + scale[1] * F.col("y")})


def extent(raster: DataFrame, v: str = "h") -> DataFrame:
    """One row: the extents and the range of known values."""
    known = F.when(~F.isnan(v), F.col(v))
    return raster.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(known).alias("low"), F.max(known).alias("high"))


def mosaic(tiles: DataFrame, scale: tuple[float, float], v: str = "h") -> DataFrame:
    """x, y, v of tiles laid over each other in world space (tile, wx, wy, v); the last tile with a known value wins."""
    x, y = F.floor(F.col("wx") / scale[0]).cast("int"), F.floor(F.col("wy") / scale[1]).cast("int")
    known = tiles.where(F.col(v).isNotNull() & ~F.isnan(v)).select(x.alias("x"), y.alias("y"), F.struct("tile", "wx", "wy", F.col(v).alias("v")).alias("s"))
    return known.groupBy("x", "y").agg(F.max("s")["v"].alias(v))


def resize_nearest(raster: DataFrame, old: Grid, new: Grid, v: str = "h") -> DataFrame:
    """n, x, y, v on another grid; each cell takes the old cell that it begins in."""
    x, y = F.floor(F.col("x") * old.nx / new.nx).cast("int"), F.floor(F.col("y") * old.ny / new.ny).cast("int")
    cells = _cells(raster, new).select("n", "x", "y", (x.cast("long") * old.ny + y).alias("__o"))
    return cells.join(raster.select(F.col("n").alias("__o"), v), "__o", "left").select("n", "x", "y", v)


def resize_bilinear(raster: DataFrame, old: Grid, new: Grid, v: str | list[str] = "h") -> DataFrame:
    """n, x, y, v on another grid, by the four old cells around; one join, on cells that each give four corners."""
    columns = [v] if isinstance(v, str) else v
    u, w = F.col("x") * (old.nx / new.nx), F.col("y") * (old.ny / new.ny)
    cells = _cells(raster, new).withColumns({"__u": u, "__w": w})
    corners = [(F.least(F.floor("__u") + i, F.lit(old.nx - 1)), F.least(F.floor("__w") + j, F.lit(old.ny - 1)), (F.col("__u") - F.floor("__u") if i else 1 - (F.col("__u") - F.floor("__u"))) * (F.col("__w") - F.floor("__w") if j else 1 - (F.col("__w") - F.floor("__w")))) for i in (0, 1) for j in (0, 1)]
    each = F.explode(F.array(*(F.struct((i.cast("long") * old.ny + j.cast("long")).alias("o"), k.alias("k")) for i, j, k in corners)))
    rows = cells.select("n", "x", "y", each.alias("c")).select("n", "x", "y", F.col("c.o").alias("__o"), F.col("c.k").alias("__k"))
    rows = rows.join(raster.select(F.col("n").alias("__o"), *columns), "__o")
    return rows.groupBy("n", "x", "y").agg(*(F.sum(F.col("__k") * F.col(c)).alias(c) for c in columns))


def map_values(raster: DataFrame, expression: str | Column, v: str = "h") -> DataFrame:
    """The raster with its values by any SQL expression or column over n, x, y and the values; Catalyst compiles it."""
    return raster.withColumn(v, F.expr(expression) if isinstance(expression, str) else expression)


def _cells(raster: DataFrame, grid: Grid) -> DataFrame:
    n = F.col("id")
    return raster.sparkSession.range(grid.cells).select(n.alias("n"), F.floor(n / grid.ny).cast("int").alias("x"), (n % grid.ny).cast("int").alias("y"))


def mesh(raster: DataFrame, grid: Grid, v: str = "h", center: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (id, x, y, z) of known cells and faces (id, a, b, c): two triangles for each square of four of them.

    Ids count in cell order. Numbers come from sums over rows of the grid, then a count within the row, so no task
    holds more than a row.
    """
    known = raster.where(F.col(v).isNotNull() & ~F.isnan(v)).select("n", F.col("x").alias("i"), F.col("y").alias("j"), F.col(v).alias("v"))
    numbered = _numbered(known, F.col("i"), F.col("j"))
    place = [F.col("i").cast("double") * grid.sx, F.col("j").cast("double") * grid.sy, F.col("v") * grid.sz]
    vertices = numbered.select("id", *(p.alias(c) for p, c in zip(place, "xyz", strict=True)))
    if center:
        middle = vertices.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xyz"))
        vertices = vertices.join(F.broadcast(middle)).select("id", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))
    along = Window.partitionBy("i").orderBy("j")
    side = numbered.select("i", "j", "id", F.when(F.lead("j").over(along) == F.col("j") + 1, F.lead("id").over(along)).alias("right")).where("right is not null")
    below = side.select((F.col("i") - 1).alias("i"), "j", F.col("id").alias("id10"), F.col("right").alias("id11"))
    squares = _numbered(side.join(below, ["i", "j"]).withColumnsRenamed({"id": "id00", "right": "id01"}), F.col("i"), F.col("j"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("id01").alias("a"), F.col("id00").alias("b"), F.col("id10").alias("c")), F.struct(F.lit(1).alias("k"), F.col("id01").alias("a"), F.col("id10").alias("b"), F.col("id11").alias("c"))))
    faces = squares.select("id", two.alias("f")).select((F.col("id") * 2 + F.col("f.k")).alias("id"), "f.a", "f.b", "f.c")
    return vertices, faces


#: Rows of the grid whose counts are summed in one task.
NUMBERED = 4096


def _numbered(rows: DataFrame, i: Column, j: Column) -> DataFrame:
    """id: the place of each row in the order of i, j; from counts by i, summed within blocks of i and over blocks."""
    counts = rows.groupBy(i.alias("i")).agg(F.count(F.lit(1)).alias("k")).withColumn("block", F.floor(F.col("i") / NUMBERED))
    earlier = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("k").alias("k")).select("block", earlier(Window.orderBy("block")).alias("base"))  # a row for NUMBERED rows of the grid
    before = counts.withColumn("own", earlier(Window.partitionBy("block").orderBy("i"))).join(blocks, "block").select("i", (F.col("base") + F.col("own")).alias("before"))
    return rows.join(before, "i").withColumn("id", F.col("before") + F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1).drop("before")
