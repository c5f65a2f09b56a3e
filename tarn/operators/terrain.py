"""Layered terrain: exchange between water, debris and ground, creep, and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.values import norm2
from tarn.operators.stencil import neighbour, neighbourhood, upwind_columns
from tarn.plans.model import Grid, Params

#: The slope that deposits may fill up to, as a fixed number.
DEPOSIT_SLOPE = 0.3
EPS = 1e-12
COLOURS = ("r", "g", "b")


def layer_merge(layers: DataFrame) -> DataFrame:
    return layers.withColumn("height", F.col("bedrock") + F.col("sediment"))


def apply_delta(layers: DataFrame, delta: DataFrame) -> DataFrame:
    """The layers plus d_bedrock and d_sediment; cells without a delta stay."""
    rows = layers.join(delta.select("n", "d_bedrock", "d_sediment"), "n", "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"d_{c}", F.lit(0.0)) for c in ("bedrock", "sediment")}).drop("d_bedrock", "d_sediment")


def _excess(p: Params) -> Column:
    return F.col("slope") - p.crit_slope_bedrock


def suspension(p: Params) -> Column:
    """What flowing water takes up in a unit of time, by its speed and the slope."""
    return p.suspension_fluvial / 64 * F.pow(0.125 * (p.friction_factor / 8) * p.density_water * F.col("speed") * F.col("speed") * F.col("slope"), F.lit(float(p.fluvial_exponent)))


def exchange(g: Grid, p: Params) -> Column:
    """What a step puts down (above zero) or takes up, within limits; reads slope, speed, mass and debris."""
    length = (g.sx**2 + g.sy**2) ** 0.5
    up = suspension(p)
    down = p.deposition_fluvial * 1.33 * F.col("mass")
    shear = p.gravity * (F.col("debris") * _excess(p) - p.yield_stress)
    slide = F.greatest(F.lit(0.0), p.landslide_rate * _excess(p)) + p.suspension_debris * F.greatest(F.lit(0.0), shear)
    settle = F.least(F.col("debris"), F.greatest(F.lit(0.0), -p.deposition_debris * shear))
    change = p.time_step * (down - up + settle - slide)
    return F.greatest(-0.25 * length * F.col("slope"), F.least(change, F.lit(0.25 * length * DEPOSIT_SLOPE)))


def mass_transfer(layers: DataFrame, state: DataFrame, uplift: DataFrame, grid: Grid, param: Params = Params()) -> DataFrame:
    """n, transfer, d_bedrock, d_sediment of one step.

    state: n, mass, vx, vy, debris; uplift: n, uplift. Uplift raises the bedrock; what is put down is sediment; what
    is taken up comes from the sediment down to none, then from the bedrock.
    """
    ux, uy = upwind_columns(grid.sx, grid.sy, grid.sz, param.exit_slope)
    rows = neighbourhood(layers, ["bedrock", "sediment"]).select("n", "sediment", norm2(ux, uy).alias("slope"))
    rows = rows.join(state.select("n", "mass", norm2(F.col("vx"), F.col("vy")).alias("speed"), "debris"), "n").join(uplift.select("n", "uplift"), "n")
    rows = rows.withColumn("transfer", exchange(grid, param))
    t = F.col("transfer") / grid.sz
    loose = F.when(t > 0, t).otherwise(F.greatest(t, -F.col("sediment")))
    raised = param.time_step * param.uplift * F.col("uplift") / grid.sz
    return rows.select("n", "transfer", (raised + F.when(t < 0, t - loose).otherwise(F.lit(0.0))).alias("d_bedrock"), loose.alias("d_sediment"))


def surface_albedo(cells: DataFrame, grid: Grid) -> DataFrame:
    """sr, sg, sb after a transfer: bare cells take the bedrock's colour, covered ones blend in what is put down.

    cells: sediment, mass, debris, transfer, and colours b_*, s_* (surface), w_* (carried by water), d_* (by debris).
    """
    total = F.col("mass") + F.col("debris")
    share = F.least(F.try_divide(F.col("mass"), total), F.lit(1.0))
    depth = F.least(F.lit(1.0), F.col("sediment") * grid.sz)
    blend = F.least(F.try_divide(F.col("transfer"), F.col("transfer") + depth), F.lit(1.0))

    def colour(c: str) -> Column:
        carried = share * F.col(f"w_{c}") + (1 - share) * F.col(f"d_{c}")
        mixed = blend * F.least(F.lit(1.0), carried) + (1 - blend) * F.least(F.lit(1.0), F.col(f"s_{c}"))
        return F.when(F.col("sediment") == 0, F.col(f"b_{c}")).when((total > 0) & (F.col("transfer") > EPS), mixed).otherwise(F.col(f"s_{c}"))

    return cells.withColumns({f"out_{c}": colour(c) for c in COLOURS})


def mass_creep(layers: DataFrame, grid: Grid, param: Params = Params()) -> DataFrame:
    """n, d_sediment: loose ground moves to lower neighbours where the slope passes the critical one; sums to zero."""
    rows = neighbourhood(layers, ["bedrock", "sediment"])
    sed = F.col("sediment")
    own = (F.col("bedrock") + sed) * grid.sz
    moved = F.lit(0.0)
    for dx, dy in ((-1, 0), (0, -1), (0, 1), (1, 0)):
        s = F.coalesce(neighbour(dx, dy, "sediment"), sed)
        other = F.coalesce(neighbour(dx, dy, "bedrock") + neighbour(dx, dy, "sediment"), F.col("bedrock") + sed) * grid.sz
        keep = param.crit_slope_sediment * (grid.sx if dx else grid.sy)
        out = F.greatest(F.lit(0.0), F.least(sed * grid.sz, 0.5 * (own - other - keep)))
        back = F.greatest(F.lit(0.0), F.least(s * grid.sz, 0.5 * (other - own - keep)))
        moved = moved + F.when(own > other, -out).otherwise(back)
    return rows.select("n", (0.25 * moved / grid.sz).alias("d_sediment"))


def albedo_layer(cells: DataFrame, scale_sediment: float, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """out_*: bedrock colour (b_*) fading to the shifted sediment colour (s_*) with depth."""
    b = 1 / (1 + scale_sediment * F.col("sediment"))
    return cells.withColumns({f"out_{c}": b * F.col(f"b_{c}") + (1 - b) * F.least(F.lit(1.0), F.col(f"s_{c}") + d) for c, d in zip(COLOURS, shift, strict=True)})


def albedo_stratum(cells: DataFrame, age: float, frequency: float, a: tuple[float, float, float], b: tuple[float, float, float], grid: Grid, param: Params = Params()) -> DataFrame:
    """out_*: one of two colours by the stratum that the surface cuts. cells: bedrock, uplift."""
    depth = F.greatest(F.lit(0.0), age * param.uplift * F.col("uplift") - F.col("bedrock") * grid.sz)
    even = F.pmod(F.floor(depth / frequency), F.lit(2)) == 0
    return cells.withColumns({f"out_{c}": F.when(even, F.lit(x)).otherwise(F.lit(y)) for c, x, y in zip(COLOURS, a, b, strict=True)})


def albedo_discharge(cells: DataFrame, scale: float, extinction: float, colour: tuple[float, float, float]) -> DataFrame:
    """out_*: colours (s_*) tinted by discharge q."""
    b = scale * (1 - F.exp(-extinction * F.greatest(F.lit(0.0), F.col("q"))))
    return cells.withColumns({f"out_{c}": b * x + (1 - b) * F.col(f"s_{c}") for c, x in zip(COLOURS, colour, strict=True)})
