"""Named queries over the raster operators, with the SQL that states the same."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.noise import noise
from tarn.functions.values import uniform, uniform_sql
from tarn.operators import flow, raster, sampling, stencil, terrain, transport
from tarn.plans.erosion import erosion_step
from tarn.plans.model import Edge, Grid, NoiseParams, Params, with_cells
from tarn.plans.state import files_folder
from tarn.sources import tiff
from tarn.streaming.cells import cell_sums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NY, TILT, SIGMA, P = 100, 20.0, 2.0, Params()
#: A factor of many digits, so that no result lies half way between two rounded ones.
KEPT = 0.98765432101
A, B = (0.8, 0.6, 0.4), (0.3, 0.35, 0.5)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- rasters made of the provided tables, and the same in SQL


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("h"), "o_orderstatus")
    return with_cells(t, F.col("o_orderkey"), NY).select("n", "x", "y", "h", F.col("o_orderstatus").alias("status"))


def height(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("n", "x", "y", "h")


def tilted(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("n", "x", "y", (F.col("h") * 0.0001 + F.col("x") * TILT).alias("h"))


def holes(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("n", "x", "y", F.when(F.col("status") == "P", F.lit(float("nan"))).otherwise(F.col("h")).alias("h"))


def per_order(spark: SparkSession, d: str) -> DataFrame:
    """n, rain (lineitems), decay, quantity of each order."""
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("n")).agg(
        F.count(F.lit(1)).cast("double").alias("rain"), ((1 - F.avg(F.col("l_discount").cast("double"))) * KEPT).alias("decay"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))
    return height(spark, d).select("n").join(lines, "n", "left").select("n", F.coalesce("rain", F.lit(0.0)).alias("rain"), F.coalesce("decay", F.lit(1.0)).alias("decay"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    rows = height(spark, d).join(per_order(spark, d), "n")
    return rows.select("n", "x", "y", (F.col("h") / 1e5).alias("bedrock"), (F.col("quantity") / 100).alias("sediment"), "rain", "decay")


def grid_of(spark: SparkSession, d: str) -> Grid:
    return Grid(int(height(spark, d).agg(F.max("x")).first()[0]) + 1, NY)


_ORDERS = "SELECT CAST(o_orderkey AS BIGINT) AS n, CAST(o_orderkey // 100 AS INTEGER) AS x, CAST(o_orderkey % 100 AS INTEGER) AS y, CAST(o_totalprice AS DOUBLE) AS h, o_orderstatus AS status FROM orders"
_TILT = f"SELECT n, x, y, h * 0.0001::DOUBLE + x * {TILT}::DOUBLE AS h FROM ({_ORDERS})"
_HOLES = f"SELECT n, x, y, CASE WHEN status = 'P' THEN NULL ELSE h END AS h FROM ({_ORDERS})"
_PER = f"SELECT o.n, coalesce(rain, 0)::DOUBLE AS rain, coalesce(decay, 1)::DOUBLE AS decay, coalesce(quantity, 0)::DOUBLE AS quantity FROM ({_ORDERS}) o LEFT JOIN (SELECT l_orderkey AS n, count(*) AS rain, (1 - avg(CAST(l_discount AS DOUBLE))) * {KEPT}::DOUBLE AS decay, sum(CAST(l_quantity AS DOUBLE)) AS quantity FROM lineitem GROUP BY 1) l ON o.n = l.n"
_LAYERS = f"SELECT o.n, o.x, o.y, h / 1e5::DOUBLE AS bedrock, quantity / 100 AS sediment, rain, decay FROM ({_ORDERS}) o JOIN ({_PER}) p ON o.n = p.n"
_SHIFTS = Edge.D8.shifts


def _tag(dx: int, dy: int) -> str:
    return "nop"[dx + 1].replace("o", "0") + "nop"[dy + 1].replace("o", "0")


def around(base: str, columns: list[str]) -> str:
    """SQL of the base with each column of the eight neighbours, as column_tag."""
    joins = "".join(f" LEFT JOIN base k{_tag(*s)} ON k{_tag(*s)}.x = c.x + ({s[0]}) AND k{_tag(*s)}.y = c.y + ({s[1]})" for s in _SHIFTS)
    cols = ", ".join(f"k{_tag(*s)}.{c} AS {c}_{_tag(*s)}" for s in _SHIFTS for c in columns)
    return f"(WITH base AS ({base}) SELECT c.*, {cols} FROM base c{joins})"


def _drops_sql(base: str, k: int) -> str:
    cols = ", ".join(f"(h - h_{_tag(*s)}) / {math.sqrt(s[0] ** 2 + s[1] ** 2)!r}::DOUBLE AS d{i}" for i, s in enumerate(_SHIFTS[:k]))
    return f"(SELECT *, greatest({', '.join(f'd{i}' for i in range(k))}) AS best FROM (SELECT n, x, y, {cols} FROM {around(base, ['h'])}))"


def _direction_sql(base: str, k: int) -> str:
    pick = " ".join(f"WHEN d{i} = best THEN {i}" for i in range(k))
    return f"(SELECT n, x, y, CAST(CASE WHEN best IS NULL OR best <= 0 THEN -1 {pick} END AS INTEGER) AS k FROM {_drops_sql(base, k)})"


def _receiver(k: str) -> str:
    return f"CAST(CASE {' '.join(f'WHEN {k} = {i} THEN n + ({dx * NY + dy})' for i, (dx, dy) in enumerate(_SHIFTS))} ELSE -1 END AS BIGINT)"


def _graph_sql(base: str, k: int = 8) -> str:
    return f"(SELECT n, x, y, {_receiver('k')} AS nxt FROM {_direction_sql(base, k)})"


def _summed_sql(graph: str, weight: str = "1.0::DOUBLE", source: str = "1.0::DOUBLE", extra: str = "", digits: int = 6) -> str:
    """Totals along a graph by following each cell's path; `graph` has n, nxt and what weight and source name."""
    return f"""WITH RECURSIVE g AS MATERIALIZED (SELECT n, nxt, {weight} AS w, {source} AS s FROM {graph} {extra}),
walk AS (SELECT n AS cur, s AS v FROM g UNION ALL SELECT g.nxt, walk.v * g.w FROM walk JOIN g ON walk.cur = g.n WHERE g.nxt >= 0)
SELECT cur AS n, round(sum(v), {digits}) AS total FROM walk GROUP BY cur"""


def _r(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


def _rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) AS {c}" for c, e in (x.split("=", 1) if "=" in x else (x, x) for x in columns))


# ---- flow

for _edge, _k in ((Edge.D4, 4), (Edge.D8, 8)):
    _name = _edge.name.lower()

    @query(f"direction_{_name}", f"SELECT * FROM {_direction_sql(_ORDERS, _k)}")
    def _direction(spark, d, edge=_edge):
        return flow.direction(height(spark, d), edge)

    @query(f"steepest_{_name}", f"SELECT * FROM {_graph_sql(_ORDERS, _k)}")
    def _steepest(spark, d, edge=_edge):
        return flow.steepest(height(spark, d), NY, edge)

    @query(f"accumulate_{_name}", _summed_sql(_graph_sql(_TILT, _k)))
    def _accumulate(spark, d, edge=_edge):
        return flow.accumulate(flow.steepest(tilted(spark, d), NY, edge), ny=NY).select("n", *_r("total"))


@query("steepest_holes", f"SELECT * FROM {_graph_sql(_HOLES)}")
def _steepest_holes(spark, d):
    return flow.steepest(holes(spark, d), NY)


@query("slope_d8", f"SELECT g.n, round(CASE WHEN nxt < 0 THEN 0 ELSE (t.h - o.h) / sqrt(power((t.x - o.x) * 2.0, 2) + power((t.y - o.y) * 3.0, 2)) END, 6) AS slope FROM {_graph_sql(_ORDERS)} g JOIN ({_ORDERS}) o ON g.n = o.n LEFT JOIN ({_ORDERS}) t ON t.n = g.nxt")
def _slope(spark, d):
    h = height(spark, d)
    return flow.slope(h, flow.steepest(h, NY), Grid(0, NY, 2.0, 3.0)).select("n", *_r("slope"))


def _drawn_sql(base: str, temperature: float, seed: int, runs: int) -> str:
    w = [f"CASE WHEN d{i} > 0 THEN exp((d{i} - best) / {temperature}::DOUBLE) ELSE 0 END" for i in range(8)]
    cum = [f"({' + '.join(f'w{j}' for j in range(i + 1))})" for i in range(8)]
    pick = " ".join(f"WHEN u * {cum[7]} < {cum[i]} THEN {i}" for i in range(8))
    return f"""(SELECT n, x, y, run, {_receiver('k')} AS nxt FROM (SELECT *, CASE {pick} ELSE -1 END AS k FROM
(SELECT *, {', '.join(f'{e} AS w{i}' for i, e in enumerate(w))}, {uniform_sql('(n * 1009 + run)', seed)} AS u FROM {_drops_sql(base, 8)}, (SELECT CAST(range AS INTEGER) AS run FROM range({runs})))))"""


@query("random_weighted_d8", f"SELECT n, x, y, nxt FROM {_drawn_sql(_TILT, 10.0, 7, 1)}")
def _random(spark, d):
    return flow.random_weighted(tilted(spark, d), NY, seed=7, temperature=10.0).select("n", "x", "y", "nxt")


@query("accumulate_weighted", _summed_sql(_graph_sql(_TILT), source="rain", extra=f"JOIN (SELECT n AS pn, rain FROM ({_PER})) ON pn = n"))
def _weighted(spark, d):
    return flow.accumulate(flow.steepest(tilted(spark, d), NY), per_order(spark, d).select("n", F.col("rain").alias("s")), NY).select("n", *_r("total"))


_DONORS = f"(SELECT *, row_number() OVER (PARTITION BY nxt ORDER BY CASE {' '.join(f'WHEN n - nxt = {dx * NY + dy} THEN {i}' for i, (dx, dy) in enumerate(_SHIFTS))} END) AS slot FROM {_graph_sql(_TILT)})"
for _mode, _far in (("geometric", f"abs(nxt - n) IN ({NY - 1}, {NY + 1})"), ("slot", "slot > 4")):

    @query(f"accumulate_decay_{_mode}", _summed_sql(_DONORS, f"CASE WHEN {_far} THEN power(decay, 1.414) ELSE decay END", "rain", f"JOIN (SELECT n AS pn, rain, decay FROM ({_PER})) ON pn = n"))
    def _decayed(spark, d, mode=_mode):
        per = per_order(spark, d)
        return flow.accumulate_decay(flow.steepest(tilted(spark, d), NY), per.select("n", F.col("rain").alias("s")), per.select("n", "decay"), NY, diagonal=mode).select("n", *_r("total"))


_RUNS = 4
_BIG = 1 << 28


@query("multiflow_mean", f"SELECT n % {_BIG} AS n, round(sum(total) / {_RUNS}, 6) AS total FROM ({_summed_sql(f'(SELECT run * {_BIG}::BIGINT + n AS n, CASE WHEN nxt >= 0 THEN run * {_BIG}::BIGINT + nxt ELSE -1 END AS nxt FROM {_drawn_sql(_TILT, 10.0, 0, _RUNS)})')}) GROUP BY 1")
def _multiflow(spark, d):
    return flow.multiflow(tilted(spark, d), NY, _BIG, _RUNS).select("n", *_r("total"))


@query("donor_count", f"SELECT nxt AS n, count(*) AS donors FROM {_graph_sql(_ORDERS)} WHERE nxt >= 0 GROUP BY nxt")
def _donors(spark, d):
    return flow.donor_count(flow.steepest(height(spark, d), NY))


@query("pits", f"SELECT n FROM {_graph_sql(_ORDERS)} WHERE nxt < 0")
def _pits(spark, d):
    return flow.pits(flow.steepest(height(spark, d), NY))


_PATHS = f"WITH RECURSIVE g AS MATERIALIZED (SELECT n, nxt FROM {_graph_sql(_TILT)}), walk AS (SELECT n, n AS cur, 0::BIGINT AS depth FROM g UNION ALL SELECT walk.n, g.nxt, depth + 1 FROM walk JOIN g ON walk.cur = g.n WHERE g.nxt >= 0)"


@query("drainage_basins", f"{_PATHS} SELECT walk.n, cur AS root FROM walk JOIN g ON g.n = walk.cur WHERE g.nxt < 0")
def _basins(spark, d):
    return flow.roots(flow.steepest(tilted(spark, d), NY), ny=NY).select("n", "root")


@query("flow_depth", f"{_PATHS} SELECT n, max(depth) AS depth FROM walk GROUP BY n")
def _depth(spark, d):
    return flow.roots(flow.steepest(tilted(spark, d), NY), ny=NY).select("n", "depth")


@query("upstream", f"{_PATHS} SELECT DISTINCT n FROM walk WHERE cur = 250")
def _upstream(spark, d):
    return flow.upstream_of(flow.steepest(tilted(spark, d), NY), 250)


_LENGTH = "CASE WHEN abs(nxt - n) = 1 THEN 3.0::DOUBLE WHEN abs(nxt - n) = 100 THEN 2.0::DOUBLE ELSE sqrt(13.0::DOUBLE) END"


@query("flow_distance", f"WITH RECURSIVE g AS MATERIALIZED (SELECT n, nxt, {_LENGTH} AS s FROM {_graph_sql(_TILT)}), walk AS (SELECT n, n AS cur, 0.0::DOUBLE AS d FROM g UNION ALL SELECT walk.n, g.nxt, d + s FROM walk JOIN g ON walk.cur = g.n WHERE g.nxt >= 0) SELECT n, round(max(d), 6) AS distance FROM walk GROUP BY n")
def _distance(spark, d):
    return flow.flow_distance(flow.steepest(tilted(spark, d), NY), Grid(0, NY, 2.0, 3.0)).select("n", *_r("distance"))


@query("donor_lists", f"SELECT nxt AS n, array_to_string(list_sort(list(n)), ',') AS donors FROM {_graph_sql(_ORDERS)} WHERE nxt >= 0 GROUP BY nxt")
def _donor_lists(spark, d):
    return flow.donor_lists(flow.steepest(height(spark, d), NY)).select("n", F.array_join("donors", ",").alias("donors"))


# ---- stencils

_SX, _SY = 2.0, 3.0
_ONE = lambda low, high, s: f"coalesce(0.5 * ({high} - {low}) / {s}, (h - {low}) / {s}, ({high} - h) / {s}, 0)"
_GRAD = f"(SELECT n, x, y, {_ONE('h_n0', 'h_p0', _SX)} AS gx, {_ONE('h_0n', 'h_0p', _SY)} AS gy FROM {around(_HOLES, ['h'])})"
_NORMAL = f"(SELECT n, x, y, -gx / sqrt(gx * gx + gy * gy + 1) AS nx, -gy / sqrt(gx * gx + gy * gy + 1) AS ny, 1 / sqrt(gx * gx + gy * gy + 1) AS nz FROM {_GRAD})"


@query("gradient", f"SELECT n, x, y, {_rs('gx', 'gy')} FROM {_GRAD}")
def _gradient(spark, d):
    return stencil.gradient(holes(spark, d), _SX, _SY).select("n", "x", "y", *_r("gx", "gy"))


@query("normal", f"SELECT n, {_rs('nx', 'ny', 'nz', digits=9)} FROM {_NORMAL}")
def _normal(spark, d):
    return stencil.normal(holes(spark, d), _SX, _SY).select("n", *_r("nx", "ny", "nz", digits=9))


@query("relief_shade", f"SELECT n, round((-nx + 2 * ny + nz) / {6**0.5!r}::DOUBLE, 9) AS shade FROM {_NORMAL}")
def _relief(spark, d):
    return stencil.relief_shade(stencil.normal(holes(spark, d), _SX, _SY)).select("n", *_r("shade", digits=9))


@query("negslope", f"SELECT n, round(sqrt(power(greatest(0, (h - h_n0) / {_SX}, (h - h_p0) / {_SX}), 2) + power(greatest(0, (h - h_0n) / {_SY}, (h - h_0p) / {_SY}), 2)), 6) AS slope FROM {around(_ORDERS, ['h'])}")
def _negslope(spark, d):
    return stencil.negslope(height(spark, d), _SX, _SY).select("n", *_r("slope"))


def _laplace_sql(c: str) -> str:
    e = lambda t: f"(coalesce({c}_{t}, {c}) - {c})"
    hx, hy = repr(1 / _SX**2) + "::DOUBLE", repr(1 / _SY**2) + "::DOUBLE"
    return f"0.5 * (({e('n0')} + {e('p0')}) * {hx} + ({e('0n')} + {e('0p')}) * {hy}) + 0.25 * (({e('nn')} + {e('pp')}) * {hx} + ({e('pn')} + {e('np')}) * {hy})"


@query("laplacian_1ch", f"SELECT n, round({_laplace_sql('h')}, 7) AS l_h FROM {around(_ORDERS, ['h'])}")
def _laplacian1(spark, d):
    return stencil.laplacian(height(spark, d), ["h"], _SX, _SY).select("n", *_r("l_h", digits=7))


@query("laplacian_2ch", f"SELECT n, round({_laplace_sql('bedrock')}, 12) AS l_bedrock, round({_laplace_sql('sediment')}, 12) AS l_sediment FROM {around(_LAYERS, ['bedrock', 'sediment'])}")
def _laplacian2(spark, d):
    return stencil.laplacian(layers(spark, d), ["bedrock", "sediment"], _SX, _SY).select("n", *_r("l_bedrock", "l_sediment", digits=12))


def _upwind_sql(low: str, high: str, scale: float, exit_: float = P.exit_slope) -> str:
    fall, rise = f"greatest(0, coalesce((height - ({low})) * {scale!r}::DOUBLE, {exit_}::DOUBLE))", f"least(0, coalesce((({high}) - height) * {scale!r}::DOUBLE, {-exit_}::DOUBLE))"
    return f"CASE WHEN abs({rise}) > abs({fall}) THEN {rise} ELSE {fall} END"


def _sloped_sql(sx: float, sy: float, sz: float) -> str:
    at = lambda t: f"bedrock_{t} + sediment_{t}"
    return f"(SELECT *, {_upwind_sql(at('n0'), at('p0'), sz / sx)} AS ux, {_upwind_sql(at('0n'), at('0p'), sz / sy)} AS uy FROM (SELECT *, bedrock + sediment AS height FROM {around(_LAYERS, ['bedrock', 'sediment'])}))"


@query("upwind_gradient", f"SELECT n, {_rs('ux', 'uy', digits=10)} FROM {_sloped_sql(_SX, _SY, 1.5)}")
def _upwind(spark, d):
    return stencil.upwind_gradient(layers(spark, d), _SX, _SY, 1.5).select("n", *_r("ux", "uy", digits=10))


def _blur_sql(columns: list[str], base: str) -> str:
    w = ", ".join(f"({k}, {stencil._tap(k, SIGMA)!r}::DOUBLE)" for k in range(-16, 17))
    one = lambda t, a, b: f"SELECT c.x, c.y, {', '.join(f'sum(w * k.{v}) AS {v}' for v in columns)} FROM {t} c CROSS JOIN taps JOIN {t} k ON k.{b} = c.{b} AND k.{a} = least(greatest(c.{a} + o, 0), (SELECT max({a}) FROM base)) GROUP BY c.x, c.y"
    return f"WITH base AS ({base}), taps(o, w) AS (VALUES {w}), first AS ({one('base', 'x', 'y')}), second AS ({one('first', 'y', 'x')}) SELECT CAST(x AS BIGINT) * {NY} + y AS n, {_rs(*columns, digits=4)} FROM second"


@query("gaussian_blur_1ch", _blur_sql(["h"], _ORDERS))
def _blur1(spark, d):
    return stencil.gaussian_blur(height(spark, d), ["h"], SIGMA).select("n", *_r("h", digits=4))


@query("gaussian_blur_2ch", _blur_sql(["bedrock", "sediment"], _LAYERS))
def _blur2(spark, d):
    return stencil.gaussian_blur(layers(spark, d), ["bedrock", "sediment"], SIGMA).select("n", *_r("bedrock", "sediment", digits=4))


# ---- terrain

_G = Grid(0, NY, 2.0, 3.0, 1.5)
_UPLIFT = "(CASE WHEN n % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)"


def _uplift():
    return F.when(F.col("n") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.5))


@query("layer_merge", f"SELECT n, round(bedrock + sediment, 9) AS height FROM ({_LAYERS})")
def _merge(spark, d):
    return terrain.layer_merge(layers(spark, d)).select("n", *_r("height", digits=9))


_TRANSFER = f"""(SELECT *, greatest({-0.25 * math.hypot(2, 3)!r}::DOUBLE * slope, least({P.time_step}::DOUBLE * ({P.deposition_fluvial * 1.33!r}::DOUBLE * mass - {P.suspension_fluvial / 64!r}::DOUBLE * power({0.125 * P.friction_factor / 8!r}::DOUBLE * speed * speed * slope, 2)
 + least(debris, greatest(0, -{P.deposition_debris}::DOUBLE * shear)) - (greatest(0, {P.landslide_rate}::DOUBLE * (slope - {P.crit_slope_bedrock}::DOUBLE)) + {P.suspension_debris}::DOUBLE * greatest(0, shear))), {0.25 * math.hypot(2, 3) * 0.3!r}::DOUBLE)) AS transfer
FROM (SELECT *, {P.gravity}::DOUBLE * (debris * (slope - {P.crit_slope_bedrock}::DOUBLE) - {P.yield_stress}::DOUBLE) AS shear FROM (SELECT *, sqrt(ux * ux + uy * uy) AS slope, rain / 100 AS mass, (1 - decay) * 2 AS debris, sqrt(rain * rain + decay * decay) AS speed FROM {_sloped_sql(2.0, 3.0, 1.5)})))"""


def _state(spark, d):
    return layers(spark, d).select("n", (F.col("rain") / 100).alias("mass"), F.col("rain").alias("vx"), F.col("decay").alias("vy"), ((1 - F.col("decay")) * 2).alias("debris"))


@query("mass_transfer", f"SELECT n, {_rs('transfer')}, round({P.time_step * P.uplift!r}::DOUBLE * {_UPLIFT} / 1.5 + CASE WHEN transfer < 0 THEN transfer / 1.5 - greatest(transfer / 1.5, -sediment) ELSE 0 END, 6) AS d_bedrock, round(CASE WHEN transfer > 0 THEN transfer / 1.5 ELSE greatest(transfer / 1.5, -sediment) END, 6) AS d_sediment FROM {_TRANSFER}")
def _mass_transfer(spark, d):
    rows = layers(spark, d)
    return terrain.mass_transfer(rows.select("n", "x", "y", "bedrock", "sediment"), _state(spark, d), rows.select("n", _uplift().alias("uplift")), _G).select("n", *_r("transfer", "d_bedrock", "d_sediment"))


def _creep_sql(t: str, s: float) -> str:
    keep = P.crit_slope_sediment * s
    other, sed = f"coalesce(bedrock_{t} + sediment_{t}, bedrock + sediment) * 1.5", f"coalesce(sediment_{t}, sediment)"
    own = "(bedrock + sediment) * 1.5"
    return f"CASE WHEN {own} > {other} THEN -greatest(0, least(sediment * 1.5, 0.5 * ({own} - {other} - {keep!r}::DOUBLE))) ELSE greatest(0, least({sed} * 1.5, 0.5 * ({other} - {own} - {keep!r}::DOUBLE))) END"


@query("mass_creep", f"SELECT n, round(0.25 * ({' + '.join(_creep_sql(t, s) for t, s in (('n0', 2.0), ('0n', 3.0), ('0p', 3.0), ('p0', 2.0)))}) / 1.5, 10) AS d_sediment FROM {around(_LAYERS, ['bedrock', 'sediment'])}")
def _mass_creep(spark, d):
    return terrain.mass_creep(layers(spark, d), _G).select("n", *_r("d_sediment", digits=10))


def _coloured(rows: DataFrame) -> DataFrame:
    """Colours from the cell number, so that SQL has the same."""
    return rows.withColumns({f"{k}_{c}": (F.col("n") % m) / F.lit(float(m)) for k, ms in zip("bswd", ((7, 11, 13), (5, 3, 17), (19, 23, 29), (31, 37, 41)), strict=True) for c, m in zip("rgb", ms, strict=True)})


_COLOURS = ", ".join(f"(n % {m}) / {float(m)}::DOUBLE AS {k}_{c}" for k, ms in zip("bswd", ((7, 11, 13), (5, 3, 17), (19, 23, 29), (31, 37, 41)), strict=True) for c, m in zip("rgb", ms, strict=True))


def _surface_sql(c: str) -> str:
    carried = f"least(1, least(mass / total, 1) * w_{c} + (1 - least(mass / total, 1)) * d_{c})"
    w = "least(t / (t + least(1, sediment * 1.5)), 1)"
    return f"round(CASE WHEN sediment = 0 THEN b_{c} WHEN total > 0 AND t > 1e-12 THEN {w} * {carried} + (1 - {w}) * least(1, s_{c}) ELSE s_{c} END, 6) AS out_{c}"


@query("surface_albedo", f"SELECT n, {', '.join(map(_surface_sql, 'rgb'))} FROM (SELECT *, rain / 100 + (1 - decay) * 2 AS total, rain / 100 AS mass, rain - 3 AS t, {_COLOURS} FROM ({_LAYERS}))")
def _surface(spark, d):
    rows = _coloured(layers(spark, d)).withColumns({"mass": F.col("rain") / 100, "debris": (1 - F.col("decay")) * 2, "transfer": F.col("rain") - 3})
    return terrain.surface_albedo(rows, _G).select("n", *_r("out_r", "out_g", "out_b"))


@query("albedo_layer", "SELECT n, " + ", ".join(f"round(1 / (1 + 4.0 * sediment) * b_{c} + (1 - 1 / (1 + 4.0 * sediment)) * least(1, s_{c} + {x}::DOUBLE), 6) AS out_{c}" for c, x in zip("rgb", (0.1, 0.2, 0.3), strict=True)) + f" FROM (SELECT *, {_COLOURS} FROM ({_LAYERS}))")
def _albedo_layer(spark, d):
    return terrain.albedo_layer(_coloured(layers(spark, d)), 4.0, (0.1, 0.2, 0.3)).select("n", *_r("out_r", "out_g", "out_b"))


@query("albedo_stratum", "SELECT n, " + ", ".join(f"CASE WHEN CAST(floor(greatest(0, 5000.0::DOUBLE * 0.001::DOUBLE * {_UPLIFT} - bedrock * 1.5) / 0.7::DOUBLE) AS BIGINT) % 2 = 0 THEN {a}::DOUBLE ELSE {b}::DOUBLE END AS out_{c}" for c, a, b in zip("rgb", A, B, strict=True)) + f" FROM ({_LAYERS})")
def _albedo_stratum(spark, d):
    return terrain.albedo_stratum(layers(spark, d).withColumn("uplift", _uplift()), 5000.0, 0.7, A, B, _G).select("n", "out_r", "out_g", "out_b")


@query("albedo_discharge", "SELECT n, " + ", ".join(f"round(0.8 * (1 - exp(-0.3::DOUBLE * greatest(0, rain))) * {a}::DOUBLE + (1 - 0.8 * (1 - exp(-0.3::DOUBLE * greatest(0, rain)))) * s_{c}, 6) AS out_{c}" for c, a in zip("rgb", A, strict=True)) + f" FROM (SELECT *, {_COLOURS} FROM ({_LAYERS}))")
def _albedo_discharge(spark, d):
    return terrain.albedo_discharge(_coloured(layers(spark, d)).withColumn("q", F.col("rain")), 0.8, 0.3, A).select("n", *_r("out_r", "out_g", "out_b"))


# ---- whole rasters


@query("raster_project", f"SELECT n, x, y, round(ln(1 + h), 9) AS h FROM ({_ORDERS})")
def _project(spark, d):
    return height(spark, d).select("n", "x", "y", F.round(F.log(1 + F.col("h")), 9).alias("h"))


@query("tensor_arith", f"SELECT a.n, round(a.h + b.h, 6) AS added, round(a.h * b.h, 2) AS multiplied FROM ({_ORDERS}) a JOIN ({_TILT}) b ON a.n = b.n")
def _arith(spark, d):
    a, b = height(spark, d), tilted(spark, d)
    return raster.arithmetic(a, b, "add").select("n", F.round("h", 6).alias("added")).join(raster.arithmetic(a, b, "multiply").select("n", F.round("h", 2).alias("multiplied")), "n")


@query("clamp", f"SELECT n, greatest(50000.0::DOUBLE, least(h, 150000.0::DOUBLE)) AS h FROM ({_ORDERS})")
def _clamp(spark, d):
    return raster.clamp(height(spark, d), 50000.0, 150000.0).select("n", "h")


@query("nan_to_nodata", f"SELECT n, coalesce(h, -9999.0::DOUBLE) AS h FROM ({_HOLES})")
def _nan_to_nodata(spark, d):
    return raster.nan_to_nodata(holes(spark, d), -9999.0).select("n", "h")


@query("nodata_to_nan", f"SELECT n, h, h IS NULL AS missing FROM ({_HOLES})")
def _nodata_to_nan(spark, d):
    rows = raster.nodata_to_nan(raster.nan_to_nodata(holes(spark, d), -9999.0), -9999.0)
    return rows.select("n", F.when(~F.isnan("h"), F.col("h")).alias("h"), F.isnan("h").alias("missing"))


@query("world_map", f"SELECT n, 500.0::DOUBLE + 30.0::DOUBLE * x AS wx, -200.0::DOUBLE + 10.0::DOUBLE * y AS wy FROM ({_ORDERS})")
def _world(spark, d):
    return raster.world(height(spark, d), (500.0, -200.0), (30.0, 10.0)).select("n", "wx", "wy")


@query("extent", f"SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(h) AS low, max(h) AS high FROM ({_HOLES})")
def _extent(spark, d):
    return raster.extent(holes(spark, d))


_PART = "SELECT 2 AS tile, CAST(p_partkey // 50 AS DOUBLE) * 2 + 4 AS wx, CAST(p_partkey % 50 AS DOUBLE) * 2 + 10 AS wy, CAST(p_retailprice AS DOUBLE) AS h FROM part"


@query("mosaic", f"SELECT CAST(floor(wx / 2) AS INTEGER) AS x, CAST(floor(wy / 2) AS INTEGER) AS y, arg_max(h, (tile, wx, wy)) AS h FROM (SELECT 1 AS tile, CAST(x AS DOUBLE) AS wx, CAST(y AS DOUBLE) AS wy, h FROM ({_HOLES}) UNION ALL {_PART}) WHERE h IS NOT NULL GROUP BY 1, 2")
def _mosaic(spark, d):
    a = holes(spark, d).select(F.lit(1).alias("tile"), F.col("x").cast("double").alias("wx"), F.col("y").cast("double").alias("wy"), "h")
    key = F.col("p_partkey").cast("long")
    b = _table(spark, d, "part").select(F.lit(2).alias("tile"), (F.floor(key / 50).cast("double") * 2 + 4).alias("wx"), ((key % 50).cast("double") * 2 + 10).alias("wy"), F.col("p_retailprice").cast("double").alias("h"))
    return raster.mosaic(a.unionByName(b), (2.0, 2.0))


_NEW = "(SELECT CAST(range AS BIGINT) AS n, CAST(range // 60 AS INTEGER) AS x, CAST(range % 60 AS INTEGER) AS y FROM range(60 * 60))"
_NX = f"(SELECT max(x) + 1 FROM ({_ORDERS}))"


@query("resize_nearest", f"SELECT c.n, c.x, c.y, o.h FROM {_NEW} c LEFT JOIN ({_ORDERS}) o ON o.x = floor(c.x * {_NX} / 60.0::DOUBLE) AND o.y = floor(c.y * {NY} / 60.0::DOUBLE)")
def _nearest(spark, d):
    return raster.resize_nearest(height(spark, d), grid_of(spark, d), Grid(60, 60))


@query("resize_bilinear", f"""SELECT c.n, c.x, c.y, round(sum(h * CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN j = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END), 6) AS h
FROM (SELECT *, x * ({_NX} / 60.0::DOUBLE) AS u, y * ({NY} / 60.0::DOUBLE) AS w FROM {_NEW}) c CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)
JOIN ({_ORDERS}) o ON o.x = least(floor(u) + i, {_NX} - 1) AND o.y = least(floor(w) + j, {NY - 1}) GROUP BY ALL""")
def _bilinear(spark, d):
    return raster.resize_bilinear(height(spark, d), grid_of(spark, d), Grid(60, 60)).select("n", "x", "y", *_r("h"))


def at_points_sql(points: str, base: str) -> str:
    """Values and slopes between the four cells around each point (id, px, py)."""
    return f"""WITH p AS ({points}),
c AS (SELECT p.id, o.h, CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END AS a, CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS b, i * 2 - 1 AS u, j * 2 - 1 AS t
FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) JOIN ({base}) o ON o.x = least(floor(px) + i, {_NX} - 1) AND o.y = least(floor(py) + j, {NY - 1}))
SELECT id, CASE WHEN count(h) = 4 THEN round(sum(a * b * h), 5) END AS value, CASE WHEN count(h) = 4 THEN round(sum(u * b * h), 5) END AS gx, CASE WHEN count(h) = 4 THEN round(sum(t * a * h), 5) END AS gy FROM c GROUP BY id"""


@query("sample_bilinear", at_points_sql(f"SELECT CAST(event_id AS BIGINT) AS id, {uniform_sql('CAST(event_id AS BIGINT)', 3)} * ({_NX} - 1) AS px, {uniform_sql('CAST(event_id AS BIGINT)', 4)} * {NY - 1} AS py FROM events", _HOLES))
def _sampled(spark, d):
    g, k = grid_of(spark, d), F.col("event_id").cast("long")
    points = _table(spark, d, "events").select(k.alias("id"), (uniform(k, 3) * (g.nx - 1)).alias("px"), (uniform(k, 4) * (g.ny - 1)).alias("py"))
    return sampling.at_points(points, holes(spark, d), g).select("id", *_r("value", "gx", "gy", digits=5))


@query("log_discharge", f"SELECT n, round(ln(1 + rain), 9) AS shown, sediment > 1e-4::DOUBLE AS covered FROM ({_LAYERS})")
def _shown(spark, d):
    return raster.has_sediment(raster.shown_discharge(layers(spark, d), "rain")).select("n", F.round("shown", 9).alias("shown"), "covered")


_VERTICES = f"(SELECT *, row_number() OVER (ORDER BY x, y) - 1 AS id FROM ({_HOLES}) WHERE h IS NOT NULL)"


@query("mesh_vertices", f"SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, h AS z FROM {_VERTICES}")
def _vertices(spark, d):
    return raster.mesh(holes(spark, d), grid_of(spark, d))[0].select("id", "x", "y", "z")


@query("mesh_faces", f"""WITH v AS {_VERTICES}, s AS (SELECT row_number() OVER (ORDER BY a.x, a.y) - 1 AS id, a.id AS i00, b.id AS i01, c.id AS i10, e.id AS i11 FROM v a JOIN v b ON b.x = a.x AND b.y = a.y + 1 JOIN v c ON c.x = a.x + 1 AND c.y = a.y JOIN v e ON e.x = a.x + 1 AND e.y = a.y + 1)
SELECT id * 2 AS id, i01 AS a, i00 AS b, i10 AS c FROM s UNION ALL SELECT id * 2 + 1, i01, i10, i11 FROM s""")
def _faces(spark, d):
    return raster.mesh(holes(spark, d), grid_of(spark, d))[1]


_SIDE = 64


def _lattice_sql(i: str, j: str, seed: int) -> str:
    return f"({uniform_sql(f'((CAST({i} AS BIGINT) % 32768) * 32768 + CAST({j} AS BIGINT) % 32768)', seed)} * 2 - 1)"


def _octave_sql(k: int, p: NoiseParams) -> str:
    f = reduce(lambda a, _: a * p.lacunarity, range(k), p.frequency)
    s = lambda t: f"({t} * {t} * (3 - 2 * {t}))"
    u, v = f"(x * {f / p.ext[0]!r}::DOUBLE)", f"(y * {f / p.ext[1]!r}::DOUBLE)"
    a, b = s(f"({u} - floor({u}))"), s(f"({v} - floor({v}))")
    at = lambda i, j: _lattice_sql(f"floor({u}) + {i}", f"floor({v}) + {j}", p.seed + k)
    return f"((({at(0, 0)} * (1 - {b}) + {at(0, 1)} * {b}) * (1 - {a}) + ({at(1, 0)} * (1 - {b}) + {at(1, 1)} * {b}) * {a}) * {p.gain**k!r}::DOUBLE)"


_NOISE = NoiseParams(frequency=4.0, octaves=3, ext=(float(_SIDE), float(_SIDE)))


@query("noise_fbm", f"SELECT n, round(h / 1e5::DOUBLE + ({' + '.join(_octave_sql(k, _NOISE) for k in range(3))}) / {sum(0.6**k for k in range(3))!r}::DOUBLE, 9) AS h FROM ({_ORDERS})")
def _noise(spark, d):
    """The orders' heights made rough by noise over their grid."""
    rough = noise(spark, grid_of(spark, d), _NOISE).select("n", F.col("h").alias("rough"))
    return height(spark, d).join(rough, "n").select("n", F.round(F.col("h") / 1e5 + F.col("rough"), 9).alias("h"))


@query("event_cells", "SELECT CAST(event_id % 1500 AS BIGINT) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total, count(value) AS hits FROM events GROUP BY 1")
def _events(spark, d):
    return cell_sums(_table(spark, d, "events").withColumn("value", F.col("value").cast("double")), F.col("event_id") % 1500).select("n", *_r("total", digits=4), "hits")


# ---- particles and files: tested against small cases, not by SQL


def _cells(spark, d):
    rows = layers(spark, d).select("n", "x", "y", "bedrock", "sediment", F.col("rain"), (F.col("rain") / 10).alias("water"), F.lit(0.1).alias("vx"), F.lit(0.05).alias("vy"), (F.col("rain") / 100).alias("mass"), (1 - F.col("decay")).alias("debris"), F.lit(0.0).alias("dvx"), F.lit(0.0).alias("dvy"), _uplift().alias("uplift"))
    return rows.withColumns({c: (F.col("n") % m) / F.lit(float(m)) for c, m in zip("rgb", (7, 11, 13), strict=True)})


@query("transport_debris")
def _debris(spark, d):
    return transport.transport_debris(_cells(spark, d), grid_of(spark, d), 8192)


@query("erosion_step")
def _erosion(spark, d):
    return erosion_step(_cells(spark, d), grid_of(spark, d), 8192)


def _sample_file(spark: SparkSession, d: str) -> str:
    """The orders' heights with holes as a file."""
    g, path = grid_of(spark, d), os.path.join(files_folder(spark), "a.tiff")
    tiff.write(holes(spark, d), path, g.nx, g.ny, tiff.Meta(gdal_nodata="-9999", scale=[30.0, 10.0, 1.0], coords=[0, 0, 0, 500.0, -200.0, 0]), bits=64)
    return path


@query("tiff_roundtrip", f"SELECT n, x, y, h FROM ({_HOLES})")
def _tiff(spark, d):
    return tiff.read(spark, _sample_file(spark, d)).select("n", "x", "y", F.when(~F.isnan("h"), F.col("h")).alias("h"))


@query("geotiff_meta", f"SELECT 'a.tiff' AS filename, CAST(max(x) + 1 AS BIGINT) AS width, {NY}::BIGINT AS height, 64::BIGINT AS bits, '-9999' AS gdal_nodata, 500.0::DOUBLE AS min_x, -200.0::DOUBLE AS min_y, 500 + 30.0::DOUBLE * (max(x) + 1) AS max_x, {10.0 * NY - 200.0}::DOUBLE AS max_y FROM ({_ORDERS})")
def _meta(spark, d):
    return tiff.read_meta(spark, _sample_file(spark, d)).select("filename", "width", "height", "bits", "gdal_nodata", "min_x", "min_y", "max_x", "max_y")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The twenty cells that the most water passes."""
    return flow.accumulate(flow.steepest(height(spark, d), NY), ny=NY).orderBy(F.desc("total"), "n").limit(20)
