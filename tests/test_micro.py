"""Rasters small enough to work out by hand."""

import math

import numpy as np
import pytest

from tarn.operators import flow, raster, sampling, stencil, terrain
from tarn.plans.model import Edge, Grid, edge_of
from tarn.sources.tiff import from_array


def grid(spark, rows):
    return from_array(spark, np.array(rows, float))


def by_n(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("n").collect()]


def test_bowl(spark):
    g = flow.steepest(grid(spark, [[1, 1, 1], [1, 0, 1], [1, 1, 1]]), 3)
    assert by_n(g, "nxt") == [4, 4, 4, 4, -1, 4, 4, 4, 4]
    assert by_n(flow.accumulate(g), "total")[4] == 9


def test_plane(spark):
    h = grid(spark, [[0, 0, 0], [1, 1, 1], [2, 2, 2]])
    assert by_n(flow.steepest(h, 3, Edge.D4), "nxt") == [-1, -1, -1, 0, 1, 2, 3, 4, 5]
    assert by_n(stencil.gradient(h), "gx", "gy") == [(1.0, 0.0)] * 9
    assert by_n(stencil.laplacian(h, ["h"]), "l_h")[4] == 0


def test_flat(spark):
    g = flow.steepest(grid(spark, [[5, 5], [5, 5]]), 2)
    assert by_n(g, "nxt") == [-1] * 4
    assert by_n(flow.accumulate(g), "total") == [1.0] * 4
    assert flow.pits(g).count() == 4


def test_chain_and_decay(spark):
    h = grid(spark, [[5, 4, 3, 2, 1]])
    g = flow.steepest(h, 5)
    assert by_n(flow.accumulate(g), "total") == [1, 2, 3, 4, 5]
    one, half = h.selectExpr("n", "1.0D AS s"), h.selectExpr("n", "0.5D AS decay")
    assert by_n(flow.accumulate_decay(g, one, half, 5), "total") == [1, 1.5, 1.75, 1.875, 1.9375]
    assert [r["depth"] for r in flow.roots(g).orderBy("n").collect()] == [4, 3, 2, 1, 0]
    assert flow.upstream_of(g, 2).count() == 3


def test_tie_takes_the_first_shift(spark):
    h = grid(spark, [[1, 9, 1], [9, 5, 9], [9, 9, 9]])
    assert by_n(flow.direction(h), "k")[4] == 4
    assert by_n(flow.steepest(h, 3), "nxt")[4] == 0


def test_not_square(spark):
    h = grid(spark, [[x * 10 + y for y in range(5)] for x in range(4)])
    assert by_n(flow.steepest(h, 5, Edge.D4), "nxt")[7] == 2
    assert by_n(stencil.gradient(h), "gx", "gy")[7] == (10.0, 1.0)


def test_nan_loses_and_has_no_receiver(spark):
    nan = float("nan")
    h = grid(spark, [[3, 3, 3], [3, nan, 3], [3, 3, 1]])
    nxt = by_n(flow.steepest(h, 3), "nxt")
    assert nxt[4] == -1 and nxt[5] == 8 and nxt[0] == -1
    assert by_n(flow.random_weighted(h, 3), "nxt")[0] == -1


def test_decay_modes_differ_without_straight_donors(spark):
    h = grid(spark, [[5, 0, 5], [0, 4, 0], [5, 0, 5]])
    graph = h.selectExpr("n", "CASE WHEN n IN (0, 2, 6, 8) THEN 4L ELSE -1L END AS nxt")
    one, half = h.selectExpr("n", "1.0D AS s"), h.selectExpr("n", "0.5D AS decay")
    geometric = by_n(flow.accumulate_decay(graph, one, half, 3), "total")[4]
    slot = by_n(flow.accumulate_decay(graph, one, half, 3, diagonal="slot"), "total")[4]
    assert geometric == pytest.approx(1 + 4 * 0.5**1.414)
    assert slot == pytest.approx(3.0)


def test_cycle_raises(spark):
    loop = spark.createDataFrame([(0, 1), (1, 0)], "n long, nxt long").selectExpr("n", "nxt", "1.0D AS w", "1.0D AS v")
    for run in (lambda: flow.sum_doubling(loop, 6), lambda: flow.sum_upstream(loop).collect(), lambda: flow.sum_upstream(loop, lambda n: n).collect(), lambda: flow.roots(loop).collect()):
        with pytest.raises(Exception, match="cycle"):
            run()


def plain_sums(nxt, w, v):
    """Each node's value carried down its path, one node at a time."""
    total = [0.0] * len(nxt)
    for n in range(len(nxt)):
        at, load = n, v[n]
        while at >= 0:
            total[at] += load
            load, at = load * w[at], nxt[at]
    return total


def test_tiled_sums_equal_walked_ones(spark):
    r = np.random.default_rng(3)
    count, ny = 13 * 11, 11
    h = r.random((13, 11)) + np.arange(13)[:, None] * 0.3
    graph = [(x["n"], x["nxt"]) for x in flow.steepest(grid(spark, h), ny).orderBy("n").collect()]
    nxt, w, v = [b for _, b in graph], r.random(count).tolist(), r.random(count).tolist()
    df = spark.createDataFrame([(n, t, w[n], v[n]) for n, t in graph], "n long, nxt long, w double, v double")
    want = plain_sums(nxt, w, v)
    for tile in (None, flow.tiles_of(ny, side=3), flow.tiles_of(ny, count, side=5), lambda n: n):
        got = {x["n"]: x["total"] for x in flow.sum_upstream(df, tile).collect()}
        assert [got[n] for n in range(count)] == pytest.approx(want)
    got = {x["n"]: x["total"] for x in flow.sum_doubling(df).collect()}
    assert [got[n] for n in range(count)] == pytest.approx(want)


def test_tiled_roots_equal_walked_ones(spark, monkeypatch):
    r = np.random.default_rng(4)
    h = r.random((12, 9)) + np.arange(12)[:, None] * 0.4
    graph = flow.steepest(grid(spark, h), 9).cache()
    nxt = {x["n"]: x["nxt"] for x in graph.collect()}

    def end(n):
        steps = 0
        while nxt[n] >= 0:
            n, steps = nxt[n], steps + 1
        return n, steps

    tiles = flow.tiles_of
    for side in (256, 3, 1):
        monkeypatch.setattr(flow, "tiles_of", lambda ny, side=side: tiles(ny, side=side))
        got = {x["n"]: (x["root"], x["depth"]) for x in flow.roots(graph, ny=9).collect()}
        assert got == {n: end(n) for n in nxt}


def test_one_outlet_takes_all(spark):
    """A star: every node but one points at the last, which is no hot key in any round."""
    count = 3000
    df = spark.range(count).selectExpr("id AS n", f"CASE WHEN id < {count - 1} THEN {count - 1} ELSE -1 END AS nxt", "1.0D AS w", "1.0D AS v")
    for tile in (None, lambda n: n % 50):
        got = {x["n"]: x["total"] for x in flow.sum_upstream(df, tile).collect()}
        assert got[count - 1] == count and sum(got.values()) == 2 * count - 1


def test_creep_moves_and_keeps(spark):
    layers = grid(spark, [[0.0, 4.0]]).selectExpr("n", "x", "y", "0.0D AS bedrock", "h AS sediment")
    moved = by_n(terrain.mass_creep(layers, Grid(1, 2)), "d_sediment")
    assert moved == pytest.approx([0.25 * 0.5 * (4 - 0.3), -0.25 * 0.5 * (4 - 0.3)])


def test_constant_blur_and_relief(spark):
    h = grid(spark, [[2.0] * 4] * 3)
    weight = sum(stencil._tap(k, 2.0) for k in range(-16, 17))
    assert by_n(stencil.gaussian_blur(h, ["h"], 2.0), "h") == pytest.approx([2 * weight**2] * 12)
    assert by_n(stencil.gaussian_blur(h, ["h"], 2.0, normalize=True), "h") == pytest.approx([2.0] * 12)
    assert by_n(stencil.relief_shade(stencil.normal(h)), "shade") == pytest.approx([1 / math.sqrt(6)] * 12)


def test_tiles_meet(spark):
    h = grid(spark, np.random.default_rng(1).random((9, 7)))
    whole = stencil.neighbourhood(h, ["h"], side=100)
    tiles = stencil.neighbourhood(h, ["h"], side=2)
    columns = [stencil.neighbour(dx, dy, "h").alias(f"v{k}") for k, (dx, dy) in enumerate(Edge.D8.shifts)]
    a, b = (x.select("n", *columns).orderBy("n").collect() for x in (whole, tiles))
    assert a == b and len(a) == 63


def test_blur_tiles_meet(spark):
    h = grid(spark, np.random.default_rng(2).random((23, 16)))
    a, b = (stencil.gaussian_blur(h, ["h"], 1.5, radius=4, side=k).orderBy("n").collect() for k in (100, 5))
    assert [r["h"] for r in a] == pytest.approx([r["h"] for r in b]) and len(b) == 23 * 16
    assert stencil.gaussian_blur(h, ["h"], 1.5)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_one_shuffle_for_a_stencil(spark):
    h = grid(spark, np.random.default_rng(1).random((9, 7)))
    plan = flow.steepest(h, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_mesh_of_four(spark):
    v, f = raster.mesh(grid(spark, [[1, 2], [3, 4]]), Grid(2, 2))
    assert v.count() == 4
    assert sorted(tuple(r) for r in f.select("a", "b", "c").collect()) == [(1, 0, 2), (1, 2, 3)]
    v, f = raster.mesh(grid(spark, [[1, 2], [3, float("nan")]]), Grid(2, 2), center=True)
    assert f.count() == 0
    assert sum(r["x"] for r in v.collect()) == pytest.approx(-0.5)


def test_filled_pits_drain(spark):
    h = grid(spark, [[9, 9, 9, 9], [9, 1, 2, 9], [9, 9, 9, 5]])
    assert by_n(flow.fill_depressions(h), "h") == [9, 9, 9, 9, 9, 5, 5, 9, 9, 9, 9, 5]


def flooded(h):
    """Filled by a flood from the border, lowest cell first."""
    import heapq

    nx, ny = h.shape
    out, seen = h.copy(), np.isnan(h)
    near = lambda i, j: [(i + a, j + b) for a, b in Edge.D8.shifts]
    inside = lambda i, j: 0 <= i < nx and 0 <= j < ny
    queue = [(h[i, j], i, j) for i in range(nx) for j in range(ny) if not np.isnan(h[i, j]) and any(not inside(*c) or np.isnan(h[c]) for c in near(i, j))]
    for _, i, j in queue:
        seen[i, j] = True
    heapq.heapify(queue)
    while queue:
        level, i, j = heapq.heappop(queue)
        for c in near(i, j):
            if inside(*c) and not seen[c]:
                seen[c] = True
                out[c] = max(level, h[c])
                heapq.heappush(queue, (out[c], *c))
    return out


@pytest.mark.parametrize("side", [256, 4])
def test_filled_equals_a_flood(spark, side):
    h = np.random.default_rng(6).integers(0, 9, (14, 11)).astype(float)
    h[4:6, 7] = np.nan
    got = np.array(by_n(flow.fill_depressions(grid(spark, h), side=side), "h")).reshape(h.shape)
    np.testing.assert_array_equal(got, flooded(h))


def test_conditioned_rasters_drain(spark):
    h = np.random.default_rng(7).integers(0, 4, (15, 12)).astype(float)
    done = flow.condition(grid(spark, h))
    got = np.array(by_n(done, "h")).reshape(h.shape)
    assert (got >= h).all() and (got - flooded(h)).max() < 1e-3
    ends = [(r["root"] // 12, r["root"] % 12) for r in flow.roots(flow.steepest(done, 12), ny=12).collect()]
    assert all(x in (0, 14) or y in (0, 11) for x, y in ends)


def test_points(spark):
    h = grid(spark, [[0, 1], [2, 3]])
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.0, 1.0), (2, 0.25, 0.0), (3, 1.5, 0.0)], "id long, px double, py double")
    rows = {r["id"]: (r["value"], r["gx"], r["gy"]) for r in sampling.at_points(points, h, Grid(2, 2)).collect()}
    assert rows == {0: (1.5, 2.0, 1.0), 1: (3.0, 0.0, 0.0), 2: (0.5, 2.0, 1.0), 3: (None, None, None)}
    assert [r["px"] for r in sampling.halton(spark, Grid(2, 2), 3).collect()] == [0.5, 0.25, 0.75]
    assert sampling.random_points(spark, Grid(9, 9), 50).where("px < 0 OR px > 8").count() == 0
    assert sampling.select_cells(h, h.where("h > 1")).count() == 2
    assert raster.concat(h, h).count() == 8


def test_distance_to_a_target(spark):
    g = flow.steepest(grid(spark, [[5, 4, 3, 2, 1]]), 5)
    assert [r["distance"] for r in flow.flow_distance(g, Grid(1, 5, 1.0, 2.0)).orderBy("n").collect()] == [8, 6, 4, 2, 0]
    assert [r["distance"] for r in flow.flow_distance(g, Grid(1, 5, 1.0, 2.0), 2).orderBy("n").collect()] == [4, 2, 0]


def test_unknown_choices_raise(spark):
    h = grid(spark, [[1.0]])
    for bad in (lambda: edge_of("d6"), lambda: edge_of(9), lambda: stencil.laplacian(h, ["h"] * 3), lambda: stencil.gaussian_blur(h, [], 1.0), lambda: raster.arithmetic(h, h, "power")):
        with pytest.raises(ValueError):
            bad()


def test_hash_of_large_numbers(spark):
    from pyspark.sql import functions as F

    from tarn.functions.values import uniform

    numbers = [0, 1, 65535, 65536, 2**32 - 1, 2**32, 3_474_701_500, 9_080_998_991, 54_000_000 * 1009, 2**62 + 5, -1]
    for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", uniform(F.col("n"), 7).alias("u")).collect():
        x = (r["n"] * 2654435761 + 7 * 40503) % 2**32
        for _ in range(2):
            x = ((x ^ (x >> 16)) * 73244475) % 2**32
        assert r["u"] == (x ^ (x >> 16)) / 2**32


@pytest.mark.parametrize("mode", ["geometric", "slot"])
def test_decay_by_column_needs_no_join(spark, mode):
    from pyspark.sql import functions as F

    graph = flow.steepest(grid(spark, [[9, 8, 7], [8, 5, 4], [7, 4, 1]]), 3).select("n", "nxt")
    by_rows = flow.accumulate_decay(graph, graph.select("n", F.lit(1.0).alias("s")), graph.select("n", F.lit(0.9).alias("decay")), 3, diagonal=mode)
    assert by_n(flow.accumulate_decay(graph, F.lit(1.0), F.lit(0.9), 3, diagonal=mode), "total") == pytest.approx(by_n(by_rows, "total"))
