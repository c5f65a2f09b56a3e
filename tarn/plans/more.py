"""More named queries: particles, conditioning, files, streams and small operators, with the SQL that states the same."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.values import uniform_sql
from tarn.operators import flow, raster, sampling, stencil, terrain, transport
from tarn.plans import catalog as c
from tarn.plans.catalog import NY, _r, query
from tarn.plans.erosion import erode, erode_levels
from tarn.plans.model import Grid, Params, constant
from tarn.plans.state import files_folder, shared_folder
from tarn.sources import images, ply, tiff
from tarn.streaming.cells import cell_sums, drain, windowed_cell_sums

P = Params()


# ---- particles, step by step in SQL

SAMPLES = 8192


def _start_sql(seed: int, low: str, x: str, y: str) -> str:
    u, v = uniform_sql("(id * 2)", seed), uniform_sql("(id * 2 + 1)", seed)
    return f"(SELECT id, {low} + (1 - {u}) * {x} AS px, {low} + (1 - {v}) * {y} AS py FROM (SELECT CAST(range AS BIGINT) AS id FROM range({SAMPLES})))"


def _way_sql(p: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN sqrt(2.0::DOUBLE) ELSE least(greatest((floor({p}) - {p}) / {d}, (floor({p}) + 1 - {p}) / {d}), sqrt(2.0::DOUBLE)) END"


_CELL = f"CAST(floor(px) AS BIGINT) * {NY} + CAST(floor(py) AS BIGINT)"
_TILTED_GRAD = f"(SELECT n, x, y, {c._ONE('h_n0', 'h_p0', 1.0)} AS gx, {c._ONE('h_0n', 'h_0p', 1.0)} AS gy FROM {c.around(c._TILT, ['h'])})"
_INSIDE = f"px >= 0 AND py >= 0 AND px < (SELECT nx FROM size) AND py < {NY}"

_SOLVE = f"""WITH RECURSIVE cells AS MATERIALIZED (SELECT g.n, g.x, g.y, -gx AS vx, -gy AS vy, 0.001::DOUBLE AS decay, rain AS s FROM {_TILTED_GRAD} g JOIN ({c._PER}) p ON p.n = g.n),
size AS MATERIALIZED (SELECT max(x) + 1 AS nx, (max(x) + 1) * {NY} AS cells FROM cells),
field AS MATERIALIZED (SELECT a.*, b.vx AS vx01, b.vy AS vy01, k.vx AS vx10, k.vy AS vy10, e.vx AS vx11, e.vy AS vy11 FROM cells a, size
 JOIN cells b ON b.x = a.x AND b.y = least(a.y + 1, {NY - 1}) JOIN cells k ON k.x = least(a.x + 1, nx - 1) AND k.y = a.y JOIN cells e ON e.x = least(a.x + 1, nx - 1) AND e.y = least(a.y + 1, {NY - 1})),
walk AS (
 SELECT id, px, py, {_CELL} AS last, 0 AS steps, 1.0::DOUBLE AS att, load FROM (SELECT s.*, f.s * cells AS load FROM size, (SELECT id, px * nx AS px, py FROM size, {_start_sql(0, '0', '1', str(NY))}) s JOIN field f ON f.n = {_CELL} WHERE {_INSIDE}) WHERE abs(load) >= 1e-16
 UNION ALL
 SELECT id, px + step * vx / speed, py + step * vy / speed, cell, steps + 1, att * exp(-step * sqrt(2.0::DOUBLE) / speed * decay), load FROM (
  SELECT *, ({_way_sql('px', '(vx / speed)')} + {_way_sql('py', '(vy / speed)')}) / 2 AS step FROM (
   SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (
    SELECT w.*, f.n AS cell, decay, (f.vx * (1 - b) + vx01 * b) * (1 - a) + (vx10 * (1 - b) + vx11 * b) * a AS vx, (f.vy * (1 - b) + vy01 * b) * (1 - a) + (vy10 * (1 - b) + vy11 * b) * a AS vy FROM (
     SELECT *, CASE WHEN floor(px) >= (SELECT nx FROM size) - 1 THEN 0 ELSE px - floor(px) END AS a, CASE WHEN floor(py) >= {NY - 1} THEN 0 ELSE py - floor(py) END AS b, {_CELL} AS here
     FROM walk WHERE {_INSIDE} AND abs(att) > 1e-16 AND px <= (SELECT nx FROM size) - 1 AND py <= {NY - 1} AND steps < (SELECT nx FROM size) + {NY}) w JOIN field f ON f.n = w.here))
   WHERE speed >= 1e-16)),
flux AS (SELECT {_CELL} AS n, sum(load * att) AS v FROM walk WHERE {_INSIDE} AND abs(att) > 1e-16 AND steps < (SELECT nx FROM size) + {NY} AND {_CELL} <> last GROUP BY 1)
SELECT c.n, round(CASE WHEN abs(vx) + abs(vy) = 0 THEN NULL ELSE (s + coalesce(v, 0) / {SAMPLES}) / (abs(vx) + abs(vy)) END, 6) AS flux_s FROM cells c LEFT JOIN flux f ON f.n = c.n"""


@query("solve_uniform", _SOLVE)
def _solve(spark, d):
    g = stencil.gradient(c.tilted(spark, d))
    rows = g.join(c.per_order(spark, d), "n").select("n", "x", "y", (-F.col("gx")).alias("vx"), (-F.col("gy")).alias("vy"), F.lit(0.001).alias("decay"), F.col("rain").alias("s"))
    return transport.solve_uniform(rows, c.grid_of(spark, d), SAMPLES, ["s"]).select("n", *_r("flux_s"))


_KINDS = {"f_w": "aw", "f_m": "am", "f_x": "av", "f_y": "av", "f_r": "am", "f_g": "am", "f_b": "am"}
_DRAG = P.friction_factor / 8
_FLUVIAL = f"""WITH RECURSIVE cells AS MATERIALIZED (SELECT n, x, y, ux, uy, rain, rain / 10 AS water, 0.1::DOUBLE AS vx, 0.05::DOUBLE AS vy, (n % 7) / 7.0::DOUBLE AS r, (n % 11) / 11.0::DOUBLE AS g, (n % 13) / 13.0::DOUBLE AS b FROM {c._sloped_sql(1.0, 1.0, 1.0)}),
size AS MATERIALIZED (SELECT max(x) + 1 AS nx, (max(x) + 1) * {NY} / {SAMPLES}.0::DOUBLE AS share FROM cells),
field AS MATERIALIZED (SELECT *, {-P.gravity}::DOUBLE * ux + {P.viscosity_water}::DOUBLE * vx + 0.0::DOUBLE AS ax, {-P.gravity}::DOUBLE * uy + {P.viscosity_water}::DOUBLE * vy + 0.0::DOUBLE AS ay,
 share * {P.suspension_fluvial / 64!r}::DOUBLE * power({0.125 * _DRAG * P.density_water!r}::DOUBLE * (vx * vx + vy * vy) * sqrt(ux * ux + uy * uy), 2) AS mass FROM cells, size),
walk AS (
 SELECT id, px, py, cell AS last, 0 AS steps, ax / root AS sx, ay / root AS sy, 1.0::DOUBLE AS aw, 1.0::DOUBLE AS am, 1.0::DOUBLE AS av, cell AS source FROM (
  SELECT s.*, f.n AS cell, ax, ay, sqrt(sqrt(ax * ax + ay * ay)) AS root FROM (SELECT id, 0.5 + px * (nx - 1) AS px, py FROM size, (SELECT id, px, 0.5 + py AS py FROM {_start_sql(0, '0', '1', str(NY - 1))})) s JOIN field f ON f.n = {_CELL})
 WHERE root > 0
 UNION ALL
 SELECT id, px + step * sx / speed, py + step * sy / speed, cell, steps + 1, (sx + way * ax) / (1 + way * {P.bed_shear_water + P.viscosity_water!r}::DOUBLE), (sy + way * ay) / (1 + way * {P.bed_shear_water + P.viscosity_water!r}::DOUBLE),
  aw * exp(-(way / speed) * {P.evap_rate}::DOUBLE), am * exp(-(way / speed) * {P.deposition_fluvial}::DOUBLE * 1.33::DOUBLE), av * exp(-way * ({0.125 * P.friction_factor / 8!r}::DOUBLE / (1e-12::DOUBLE + water))), source FROM (
  SELECT *, step * sqrt(2.0::DOUBLE) AS way FROM (
   SELECT *, ({_way_sql('px', '(sx / speed)')} + {_way_sql('py', '(sy / speed)')}) / 2 AS step FROM (
    SELECT w.*, f.n AS cell, ax, ay, water, sqrt(sx * sx + sy * sy) AS speed FROM (SELECT *, {_CELL} AS here FROM walk WHERE {_INSIDE} AND steps < {P.maxage - 1}) w JOIN field f ON f.n = w.here) WHERE speed >= 1e-12))),
left_ AS (SELECT {_CELL} AS n, source, aw, am, av FROM walk WHERE {_INSIDE} AND steps < {P.maxage - 1} AND {_CELL} <> last),
flux AS (SELECT l.n, sum(share * {P.rainfall}::DOUBLE * rain * aw) AS f_w, sum(mass * am) AS f_m, sum(share * ax * av) AS f_x, sum(share * ay * av) AS f_y, sum(mass * r * am) AS f_r, sum(mass * g * am) AS f_g, sum(mass * b * am) AS f_b FROM left_ l JOIN field f ON f.n = l.source GROUP BY 1),
joined AS (SELECT f.*, {', '.join(f'coalesce({k}, 0) AS {k}' for k in _KINDS)} FROM field f LEFT JOIN flux USING (n))
SELECT n, round({P.rainfall}::DOUBLE * rain + f_w, 6) AS water, round(f_m * 1e20, 3) AS mass, round({-P.gravity}::DOUBLE * ux + f_x, 5) AS vx, round({-P.gravity}::DOUBLE * uy + f_y, 5) AS vy,
 {', '.join(f"round(CASE WHEN f_m > 0 AND abs(f_r) + abs(f_g) + abs(f_b) > 0 THEN f_{k} / f_m ELSE {k} END, 6) AS albedo_{k}" for k in 'rgb')} FROM joined"""


@query("transport_fluvial", _FLUVIAL)
def _fluvial(spark, d):
    out = transport.transport_fluvial(c._cells(spark, d), c.grid_of(spark, d), SAMPLES)
    return out.select("n", *_r("water"), F.round(F.col("mass") * 1e20, 3).alias("mass"), *_r("vx", "vy", digits=5), *_r("albedo_r", "albedo_g", "albedo_b"))


#: Debris slows by what it carries, whose exponentials round differently in other engines; errors double at each
#: step, so SQL is held to walks of a few steps. transport_debris walks to the end.
FEW = 12
_SLIDES = f"""WITH RECURSIVE cells AS MATERIALIZED (SELECT n, x, y, ux, uy, (n % 7) / 7.0::DOUBLE AS r, (n % 11) / 11.0::DOUBLE AS g, (n % 13) / 13.0::DOUBLE AS b FROM {c._sloped_sql(1.0, 1.0, 1.0)}),
size AS MATERIALIZED (SELECT max(x) + 1 AS nx, (max(x) + 1) * {NY} / {SAMPLES}.0::DOUBLE AS share FROM cells),
field AS MATERIALIZED (SELECT *, {-P.gravity}::DOUBLE * ux AS ax, {-P.gravity}::DOUBLE * uy AS ay, sqrt(ux * ux + uy * uy) AS steep, share * greatest(0, {P.landslide_rate}::DOUBLE * (sqrt(ux * ux + uy * uy) - {P.crit_slope_bedrock}::DOUBLE)) AS load FROM cells, size),
walk AS (
 SELECT id, px, py, cell AS last, 0 AS steps, ax / root AS sx, ay / root AS sy, 1.0::DOUBLE AS ad, 1.0::DOUBLE AS av, cell AS source, load FROM (
  SELECT s.*, f.n AS cell, ax, ay, load, sqrt(sqrt(ax * ax + ay * ay)) AS root FROM (SELECT id, 0.5 + px * (nx - 1) AS px, py FROM size, (SELECT id, px, 0.5 + py AS py FROM {_start_sql(1, '0', '1', str(NY - 1))})) s JOIN field f ON f.n = {_CELL})
 WHERE root > 0
 UNION ALL
 SELECT id, px + step * sx / speed, py + step * sy / speed, cell, steps + 1, (sx + way * ax) / (1 + way * slow), (sy + way * ay) / (1 + way * slow), ad * exp(power), av * exp(-way * slow), source, load FROM (
  SELECT *, {P.viscosity_debris}::DOUBLE + {P.bed_shear_debris}::DOUBLE / height AS slow, way / speed * CASE WHEN stress < 0 THEN {P.deposition_debris}::DOUBLE ELSE {P.suspension_debris}::DOUBLE END * stress / speed AS power FROM (
   SELECT *, step * sqrt(2.0::DOUBLE) AS way, {P.gravity}::DOUBLE * (steep - {P.crit_slope_bedrock}::DOUBLE - {P.yield_stress}::DOUBLE / height) AS stress FROM (
    SELECT *, ({_way_sql('px', '(sx / speed)')} + {_way_sql('py', '(sy / speed)')}) / 2 AS step FROM (
     SELECT w.*, f.n AS cell, ax, ay, steep, 1e-12::DOUBLE + ad * w.load AS height, sqrt(sx * sx + sy * sy) AS speed FROM (SELECT *, {_CELL} AS here FROM walk WHERE {_INSIDE} AND steps < {FEW - 1}) w JOIN field f ON f.n = w.here) WHERE speed >= 1e-12)))
 WHERE power < 709.782712893384::DOUBLE),
left_ AS (SELECT {_CELL} AS n, source, ad, av FROM walk WHERE {_INSIDE} AND steps < {FEW - 1} AND {_CELL} <> last),
flux AS (SELECT l.n, sum(load * ad) AS f_d, sum(share * ax * av) AS f_x, sum(share * ay * av) AS f_y FROM left_ l JOIN field f ON f.n = l.source GROUP BY 1),
joined AS (SELECT f.*, {', '.join(f'coalesce({k}, 0) AS {k}' for k in ('f_d', 'f_x', 'f_y'))} FROM field f LEFT JOIN flux USING (n))
SELECT n, round(ln(1 + f_d), 6) AS debris, round({-P.gravity}::DOUBLE * ux + f_x, 5) AS dvx, round({-P.gravity}::DOUBLE * uy + f_y, 5) AS dvy FROM joined"""


@query("transport_debris_few", _SLIDES)
def _debris_few(spark, d):
    out = transport.transport_debris(c._cells(spark, d), c.grid_of(spark, d), SAMPLES, Params(maxage=FEW))
    return out.select("n", F.round(F.log(1 + F.col("debris")), 6).alias("debris"), *_r("dvx", "dvy", digits=5))


# ---- conditioning, draws with decay, levels


_NEAR = f"near AS MATERIALIZED (SELECT a.n, b.n AS m FROM base a JOIN base b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.n <> b.n)"
_BORDER = f"(x = 0 OR y = 0 OR y = {NY - 1} OR x = (SELECT max(x) FROM base))"


def _filled_sql(base: str) -> str:
    """Water levels that only sink, a table by cell that each round updates where a neighbour sank."""
    return f"""WITH RECURSIVE base AS MATERIALIZED ({base}), {_NEAR},
level(n, v) USING KEY (n) AS (SELECT n, CASE WHEN {_BORDER} THEN h ELSE 1e300::DOUBLE END FROM base
 UNION SELECT n, new FROM (SELECT b.n, cur.v, greatest(b.h, min(k.v)) AS new FROM level k JOIN near ON near.m = k.n JOIN base b ON b.n = near.n JOIN recurring.level cur ON cur.n = b.n GROUP BY b.n, b.h, cur.v) WHERE new < v)
SELECT b.n, b.x, b.y, level.v AS h FROM base b JOIN level USING (n)"""


def _sloped_flats_sql(base: str) -> str:
    return f"""WITH RECURSIVE base AS MATERIALIZED ({base}), {_NEAR},
steps(n, v) USING KEY (n) AS (SELECT n, CASE WHEN {_BORDER} OR n IN (SELECT near.n FROM near JOIN base a ON a.n = near.n JOIN base b ON b.n = near.m WHERE b.h < a.h) THEN 0.0::DOUBLE ELSE 1e300::DOUBLE END FROM base
 UNION SELECT n, new FROM (SELECT b.n, cur.v, min(k.v) + 1 AS new FROM steps k JOIN near ON near.m = k.n JOIN base b ON b.n = near.n JOIN base o ON o.n = k.n AND o.h = b.h JOIN recurring.steps cur ON cur.n = b.n GROUP BY b.n, cur.v) WHERE new < v)
SELECT b.n, b.x, b.y, CASE WHEN s.v < 1e300 THEN h + 1e-6::DOUBLE * s.v ELSE h END AS h FROM base b JOIN steps s USING (n)"""


@query("fill_depressions", f"SELECT n, round(h, 6) AS h FROM ({_filled_sql(c._TILT)})")
def _fill(spark, d):
    return flow.fill_depressions(c.tilted(spark, d)).select("n", *_r("h"))


@query("condition_dem", f"SELECT n, round(h, 9) AS h FROM ({_sloped_flats_sql(_filled_sql(_sloped_flats_sql(_filled_sql(c._TILT))))})")
def _condition(spark, d):
    return flow.condition(c.tilted(spark, d)).select("n", *_r("h", digits=9))


@query("drained_basins", f"SELECT round(sum(total), 3) AS total, max(total) AS largest FROM ({c._summed_sql(c._graph_sql(_sloped_flats_sql(_filled_sql(_sloped_flats_sql(_filled_sql(c._TILT))))))})")
def _drained(spark, d):
    out = flow.accumulate(flow.steepest(flow.condition(c.tilted(spark, d)), NY), ny=NY)
    return out.agg(F.round(F.sum("total"), 3).alias("total"), F.max("total").alias("largest"))


_DRAWN = c._drawn_sql(c._TILT, 10.0, 7, 1)


@query("discharge_drawn", c._summed_sql(_DRAWN, f"CASE WHEN abs(nxt - n) IN ({NY - 1}, {NY + 1}) THEN power(0.9::DOUBLE, 1.414) ELSE 0.9::DOUBLE END"))
def _discharge(spark, d):
    graph = flow.random_weighted(c.tilted(spark, d), NY, seed=7, temperature=10.0).select("n", "nxt")
    return flow.accumulate_decay(graph, F.lit(1.0), F.lit(0.9), NY).select("n", *_r("total"))


@query("erode_levels")
def _levels(spark, d):
    g = c.grid_of(spark, d)
    return erode_levels(c._cells(spark, d), g, [(Grid(g.nx // 2, g.ny // 2, 2.0, 2.0), 1), (g, 1)], 2048)


@query("erosion_loop")
def _loop(spark, d):
    """Four whole steps; tests hold such steps to plain numbers."""
    return erode(c._cells(spark, d), c.grid_of(spark, d), SAMPLES, 4)


@query("erode_levels_more")
def _levels_more(spark, d):
    """Three steps on a grid of half the cells along each side, then two on the whole one."""
    g = c.grid_of(spark, d)
    return erode_levels(c._cells(spark, d), g, [(Grid(g.nx // 2, g.ny // 2, 2.0, 2.0), 3), (g, 2)], SAMPLES)


@query("top_discharge", f"SELECT n, total FROM ({c._summed_sql(c._graph_sql(c._ORDERS))}) ORDER BY total DESC, n LIMIT 20")
def _top(spark, d):
    return flow.accumulate(flow.steepest(c.height(spark, d), NY), ny=NY).select("n", *_r("total")).orderBy(F.desc("total"), "n").limit(20)


# ---- small operators


@query("constant_field", f"SELECT n, x, y, (SELECT max(h) FROM ({c._ORDERS})) AS h FROM ({c._ORDERS})")
def _constant(spark, d):
    return constant(spark, c.grid_of(spark, d), c.height(spark, d).agg(F.max("h")).first()[0])


def _mirror_sql(k: str, base: int) -> str:
    return "(" + " + ".join(f"(({k} // {base**j}) % {base}) * {base ** -(j + 1)!r}::DOUBLE" for j in range(20)) + ")"


_EACH = f"(SELECT n FROM ({c._ORDERS}))"


@query("sample_halton", c.at_points_sql(f"SELECT n AS id, {_mirror_sql('(n + 1)', 2)} * ({c._NX} - 1) AS px, {_mirror_sql('(n + 1)', 3)} * {NY - 1} AS py FROM {_EACH}", c._TILT))
def _halton(spark, d):
    """As many points as cells, from the sequence, and the heights there."""
    g = c.grid_of(spark, d)
    return sampling.at_points(sampling.halton(spark, g, g.cells), c.tilted(spark, d), g).select("id", *_r("value", "gx", "gy", digits=5))


@query("sample_random", c.at_points_sql(f"SELECT n AS id, {uniform_sql('(n * 2)', 9)} * ({c._NX} - 1) AS px, {uniform_sql('(n * 2 + 1)', 9)} * {NY - 1} AS py FROM {_EACH}", c._TILT))
def _random(spark, d):
    g = c.grid_of(spark, d)
    return sampling.at_points(sampling.random_points(spark, g, g.cells, 9), c.tilted(spark, d), g).select("id", *_r("value", "gx", "gy", digits=5))


@query("select_index", f"SELECT n, x, y, h FROM ({c._ORDERS}) WHERE n IN (SELECT CAST(l_orderkey AS BIGINT) FROM lineitem WHERE l_quantity > 49)")
def _select(spark, d):
    wanted = c._table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").cast("long").alias("n"))
    return sampling.select_cells(c.height(spark, d), wanted)


@query("concat_rasters", f"SELECT n, x, y, h FROM ({c._ORDERS}) UNION ALL SELECT n, x, y, h FROM ({c._TILT})")
def _concat(spark, d):
    return raster.concat(c.height(spark, d), c.tilted(spark, d))


@query("sample_line", f"""WITH p AS (SELECT CAST(event_id AS BIGINT) AS id, {uniform_sql('CAST(event_id AS BIGINT)', 5)} * {NY - 1} AS p FROM events), l AS (SELECT y, h FROM ({c._ORDERS}) WHERE x = 0)
SELECT id, round(a.h * (1 - (p - floor(p))) + b.h * (p - floor(p)), 5) AS value, round(b.h - a.h, 5) AS slope FROM p JOIN l a ON a.y = floor(p) JOIN l b ON b.y = least(floor(p) + 1, {NY - 1})""")
def _line(spark, d):
    k = F.col("event_id").cast("long")
    points = c._table(spark, d, "events").select(k.alias("id"), (c.uniform(k, 5) * (NY - 1)).alias("p"))
    line = c.height(spark, d).where("x = 0").select(F.col("y").alias("i"), "h")
    return sampling.at_line(points, line, NY).select("id", *_r("value", "slope", digits=5))


@query("map_expression", f"SELECT n, x, y, CASE WHEN h > 100000 THEN sqrt(h) ELSE -h END AS h FROM ({c._ORDERS})")
def _map(spark, d):
    return raster.map_values(c.height(spark, d), "CASE WHEN h > 100000 THEN sqrt(h) ELSE -h END")


@query("suspend", f"SELECT n, round({P.suspension_fluvial / 64!r}::DOUBLE * power({0.125 * P.friction_factor / 8 * P.density_water!r}::DOUBLE * rain * rain * sediment, 2) * 1e20, 3) AS suspended FROM ({c._LAYERS})")
def _suspend(spark, d):
    rows = c.layers(spark, d).select("n", F.col("rain").alias("speed"), F.col("sediment").alias("slope"))
    return rows.select("n", F.round(terrain.suspension(P) * 1e20, 3).alias("suspended"))


@query("directional_slope", f"SELECT n, round(gx * 0.6::DOUBLE + gy * 0.8::DOUBLE, 6) AS along FROM {c._GRAD}")
def _along(spark, d):
    return stencil.along(stencil.gradient(c.holes(spark, d), c._SX, c._SY), 3.0, 4.0).select("n", *_r("along"))


# ---- meshes and files

_CENTRED = f"(SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, h AS z FROM {c._VERTICES})"


@query("mesh_center", f"SELECT id, {', '.join(f'round({k} - (SELECT (min({k}) + max({k})) / 2 FROM {_CENTRED}), 6) AS {k}' for k in 'xyz')} FROM {_CENTRED}")
def _centre(spark, d):
    return raster.mesh(c.holes(spark, d), c.grid_of(spark, d), center=True)[0].select("id", *_r("x", "y", "z"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"file://{path}").select("value")


_SPAN = ", ".join(f"min({k}) AS low_{k}, CASE WHEN max({k}) > min({k}) THEN max({k}) - min({k}) ELSE 1 END AS wide_{k}" for k in "xyz")
_SCALED = ", ".join(f"CAST(format('{{:g}}', ({k} - low_{k}) / wide_{k}) AS DOUBLE) AS {n}" for k, n in zip("xyz", "abc", strict=True))


@query("ply_ascii", f"""WITH v AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, h AS z FROM {c._VERTICES}), f AS ({c.ORACLE['mesh_faces']})
SELECT 'vertex' AS kind, {_SCALED} FROM v, (SELECT {_SPAN} FROM v) UNION ALL SELECT 'face', CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE) FROM f""")
def _ply_ascii(spark, d):
    """Every line of the file, read as text."""
    path = os.path.join(files_folder(spark), "a.ply")
    ply.write_ascii(path, *raster.mesh(c.holes(spark, d), c.grid_of(spark, d)))
    parts = F.split("value", " ")
    body = _lines(spark, path).where("value RLIKE '^[-0-9]'").select(parts.alias("p"), (F.size(parts) == 4).alias("face"))
    number = lambda k: F.when(F.col("face"), F.get("p", F.lit(k + 1))).otherwise(F.get("p", F.lit(k))).cast("double")
    return body.select(F.when(F.col("face"), "face").otherwise("vertex").alias("kind"), *(number(k).alias(n) for k, n in enumerate("abc")))


@query("ply_binary", f"SELECT id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(h AS FLOAT) AS DOUBLE) AS z FROM {c._VERTICES}")
def _ply_binary(spark, d):
    return ply.read_vertices(spark, _mesh_file(spark, d))


@query("ply_binary_faces", f"SELECT id, a, b, c FROM ({c.ORACLE['mesh_faces']})")
def _ply_binary_faces(spark, d):
    return ply.read_faces(spark, _mesh_file(spark, d))


def _mesh_file(spark: SparkSession, d: str) -> str:
    path = os.path.join(files_folder(spark), "b.ply")
    ply.write_binary(path, *raster.mesh(c.holes(spark, d), c.grid_of(spark, d)))
    return path


def _raster_file(spark: SparkSession, d: str, compression: int, bits: int = 64) -> str:
    path = os.path.join(files_folder(spark), "orders.tif")
    g = c.grid_of(spark, d)
    tiff.write(c.holes(spark, d), path, g.nx, g.ny, tiff.Meta(gdal_nodata="-9999", scale=[30.0, 10.0, 1.0]), bits=bits, rows=16, compression=compression)
    return path


_FILE = f"SELECT 'orders.tif' AS file, n, x, y, h FROM ({c._HOLES})"


def _known(rows: DataFrame) -> DataFrame:
    return rows.select("file", "n", "x", "y", F.when(~F.isnan("h"), F.col("h")).alias("h"))


@query("tiff_strips", _FILE)
def _strips(spark, d):
    return _known(tiff.read(spark, _raster_file(spark, d, tiff.PLAIN)))


@query("tiff_deflate", _FILE)
def _deflate(spark, d):
    return _known(tiff.read(spark, _raster_file(spark, d, tiff.DEFLATE)))


@query("tiff_any_store", _FILE)
def _any_store(spark, d):
    """By a URI, as from a store that isn't mounted."""
    return _known(tiff.read(spark, f"file://{_raster_file(spark, d, tiff.DEFLATE)}"))


_TILES = "SELECT 'tile' || (p_partkey % 4) || '.tif' AS file, CAST(p_partkey // 4 AS BIGINT) AS n, CAST(p_retailprice AS DOUBLE) AS h FROM part"


@query("tiff_folder", f"SELECT file, n, h FROM ({_TILES})")
def _folder_query(spark, d):
    folder, key = files_folder(spark), F.col("p_partkey").cast("long")
    rows = c._table(spark, d, "part").select(F.concat(F.lit("tile"), key % 4, F.lit(".tif")).alias("file"), F.floor(key / 4).cast("long").alias("n"), F.col("p_retailprice").cast("double").alias("h"))
    tiff.write_folder(rows, folder, 5, bits=64).count()
    return tiff.read(spark, folder).where("NOT isnan(h)").select("file", "n", "h")


@query("tiff_box", f"SELECT n, x, y, h FROM ({c._HOLES}) WHERE x BETWEEN 5 AND 40 AND y >= 30 AND y < 75")
def _box(spark, d):
    """A box of a tiled file: blocks outside it aren't read."""
    path, g = os.path.join(files_folder(spark), "tiles.tif"), c.grid_of(spark, d)
    tiff.write(c.holes(spark, d), path, g.nx, g.ny, tiff.Meta(gdal_nodata="-9999"), bits=64, compression=tiff.DEFLATE, tile=(16, 32))
    return _known(tiff.read(spark, path).where("x BETWEEN 5 AND 40 AND y >= 30 AND y < 75")).drop("file")


@query("tiff_limit", "SELECT 'tile' || p_partkey % 4 || '.tif' AS filename, CAST(max(p_partkey // 4) // 5 + 1 AS BIGINT) AS width, 5::BIGINT AS height FROM part WHERE p_partkey % 4 < 3 GROUP BY 1")
def _limit(spark, d):
    """The headers of the first three files of a folder."""
    folder, key = files_folder(spark), F.col("p_partkey").cast("long")
    rows = c._table(spark, d, "part").select(F.concat(F.lit("tile"), key % 4, F.lit(".tif")).alias("file"), F.floor(key / 4).cast("long").alias("n"), F.col("p_retailprice").cast("double").alias("h"))
    tiff.write_folder(rows, folder, 5, bits=64).count()
    return tiff.read_meta(spark, folder, 3).select("filename", "width", "height")


_PARTS = "SELECT CAST(p_partkey AS BIGINT) AS n, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size FROM part"


@query("zip_fields", f"SELECT 'price' AS name, n, price AS h FROM ({_PARTS}) UNION ALL SELECT 'size', n, size FROM ({_PARTS})")
def _zip(spark, d):
    """Fields of the parts as arrays on the driver, saved and loaded as numpy's users do."""
    path, rows = os.path.join(files_folder(spark), "fields.zip"), c._table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("n"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    nx = rows.agg(F.max("n")).first()[0] // 50 + 1
    tiff.zip_save(path, {k: tiff.to_array(rows, nx, 50, k) for k in ("price", "size")}, bits=64)
    return reduce_union([tiff.from_array(spark, v).where("NOT isnan(h)").select(F.lit(k).alias("name"), "n", "h") for k, v in sorted(tiff.zip_load(path).items())])


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("png_uplift", "SELECT CAST(p_partkey AS BIGINT) AS n, CAST(p_partkey // 50 AS INTEGER) AS x, CAST(p_partkey % 50 AS INTEGER) AS y, round(p_size / 255.0::DOUBLE, 9) AS h FROM part")
def _png(spark, d):
    """The parts' sizes as the red channel of an image, and back."""
    path, rows = os.path.join(files_folder(spark), "u.png"), c._table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("n"), "p_size")
    red = np.nan_to_num(tiff.to_array(rows, rows.agg(F.max("n")).first()[0] // 50 + 1, 50, "p_size"))
    images.write_png(path, np.stack([red, red * 0, red * 0 + 7], axis=2).astype(np.uint8))
    return images.read_red(spark, f"file://{path}").select("n", "x", "y", *_r("h", digits=9))


# ---- streams


def _streamed(spark: SparkSession, d: str, make, mode: str) -> DataFrame:
    """What a stream over the events has written to files in the shared folder when its input ends."""
    schema, folder = c._table(spark, d, "events").schema, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(d, pathGlobFilter="events.parquet")
    drain(make(stream.withColumn("value", F.col("value").cast("double")).withColumn("ts", F.col("ts").cast("timestamp"))), folder, mode)
    return spark.read.parquet(f"{folder}/out")


@query("stream_cells", c.ORACLE["event_cells"])
def _stream(spark, d):
    return _streamed(spark, d, lambda s: cell_sums(s, F.col("event_id") % 1500), "complete").select("n", *_r("total", digits=4), "hits")


@query("stream_windows", "SELECT date_trunc('hour', ts) AS start, CAST(event_id % 50 AS BIGINT) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total, count(value) AS hits FROM events GROUP BY 1, 2")
def _windows(spark, d):
    """All windows, those too that the watermark hasn't passed when the input ends."""
    out = _streamed(spark, d, lambda s: windowed_cell_sums(s, F.col("event_id") % 50, "2 hours", "1 hour"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", *_r("total", digits=4), "hits")


_MANY = 64


@query("multiflow_64", f"SELECT n % {c._BIG} AS n, round(sum(total) / {_MANY}, 6) AS total FROM ({c._summed_sql(f'(SELECT run * {c._BIG}::BIGINT + n AS n, CASE WHEN nxt >= 0 THEN run * {c._BIG}::BIGINT + nxt ELSE -1 END AS nxt FROM {c._drawn_sql(c._TILT, 10.0, 0, _MANY)})')}) GROUP BY 1")
def _multiflow_many(spark, d):
    return flow.multiflow(c.tilted(spark, d), NY, c._BIG, _MANY).select("n", *_r("total"))
