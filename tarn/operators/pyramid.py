"""Statistics of a raster by tiles of growing side: cells once, then sums and sketches of tiles merged upwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_pyramid(raster: DataFrame, levels: int, side: int = 16, v: str = "h", key: Column | None = None, bits: int = 12) -> DataFrame:
    """level, tx, ty, cells, known, total, low, high of each tile; level k has tiles of side * 2 ** k cells.

    With a key also `distinct`, an estimate of how many keys the tile has, and `sketch`, which may be stored and merged with
    that of other tiles or rasters. Cells are aggregated once, into the smallest tiles; grouping sets over those, a table
    smaller by side * side, give all levels in one pass. Null and NaN cells count as cells, not as known ones.
    """
    value = F.when(~F.isnan(v), F.col(v).cast("double"))
    at = [F.floor(F.col(c) / side).cast("long") for c in "xy"]
    aggregates = [F.count(F.lit(1)).alias("cells"), F.count(value).alias("known"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")]
    merged = [*(F.sum(c).alias(c) for c in ("cells", "known", "total")), F.min("low").alias("low"), F.max("high").alias("high")]
    if key is not None:
        aggregates.append(F.hll_sketch_agg(key, bits).alias("sketch"))
        merged.append(F.hll_union_agg("sketch").alias("sketch"))
    tiles = raster.groupBy(at[0].alias("x0"), at[1].alias("y0")).agg(*aggregates)
    names = [(f"x{k}", f"y{k}") for k in range(levels)]
    # Floors of halves are those of the whole, below zero too.
    tiles = tiles.withColumns({c: F.floor(F.col(f"{c[0]}0") / 2**k).cast("long") for k, pair in enumerate(names) for c in pair if k})
    rows = tiles.groupingSets([list(pair) for pair in names], *(c for pair in names for c in pair)).agg(F.grouping_id().alias("set"), *merged)
    # Of the bits of the set, one for each name, only those of the level's two names are clear.
    whole = 4**levels - 1
    level = F.coalesce(*(F.when(F.col("set") == whole - 3 * 4 ** (levels - 1 - k), k) for k in range(levels)))
    out = rows.select(level.alias("level"), *(F.coalesce(*(F.col(pair[i]) for pair in names)).alias(c) for i, c in enumerate(("tx", "ty"))), *(F.col(c) for c in rows.columns if c in ("cells", "known", "total", "low", "high", "sketch")))
    return out.withColumn("distinct", F.hll_sketch_estimate("sketch")) if key is not None else out
