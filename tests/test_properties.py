import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarn.operators import flow, stencil, terrain
from tarn.plans.model import Grid
from tarn.sources.tiff import from_array

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
fields = st.integers(0, 10_000).map(lambda s: np.random.default_rng(s).random((np.random.default_rng(s).integers(2, 7), np.random.default_rng(s + 1).integers(2, 7))) * 10)


@few
@given(fields)
def test_sums_reach_the_roots(spark, field):
    g = flow.steepest(from_array(spark, field), field.shape[1]).cache()
    total = {r["n"]: r["total"] for r in flow.accumulate(g).collect()}
    roots = [r["n"] for r in flow.pits(g).collect()]
    assert abs(sum(total[n] for n in roots) - field.size) < 1e-9
    assert all(t >= 1 for t in total.values())
    k = {r["n"]: r["k"] for r in flow.direction(from_array(spark, field)).collect()}
    assert all((k[r["n"]] < 0) == (r["nxt"] < 0) for r in g.collect())


@few
@given(fields)
def test_draws_go_down(spark, field):
    flat = field.ravel()
    for r in flow.random_weighted(from_array(spark, field), field.shape[1], seed=3, temperature=2.0, runs=3).collect():
        assert r["nxt"] < 0 or flat[r["nxt"]] < flat[r["n"]]


@few
@given(fields)
def test_creep_keeps_the_sum(spark, field):
    layers = from_array(spark, field).selectExpr("n", "x", "y", "h AS bedrock", "h / 3 AS sediment")
    assert abs(sum(r["d_sediment"] for r in terrain.mass_creep(layers, Grid(*field.shape, 1.0, 2.0)).collect())) < 1e-9


@few
@given(st.floats(-5, 5), st.floats(-5, 5))
def test_planes_have_their_slope(spark, a, b):
    x, y = np.indices((4, 5))
    for r in stencil.gradient(from_array(spark, a * x + b * y), 1.0, 1.0).collect():
        assert abs(r["gx"] - a) < 1e-9 and abs(r["gy"] - b) < 1e-9


def test_simplex_noise_is_smooth_and_bounded(spark):
    """Against a plain version of one octave: zero at the lattice's corners, small steps for small steps."""
    from tarn.functions.noise import simplex_noise
    from tarn.plans.model import NoiseParams

    df = spark.sql("SELECT id AS n, CAST(id DIV 60 AS INT) AS x, CAST(id % 60 AS INT) AS y FROM range(3600)")
    h = simplex_noise(df, NoiseParams(octaves=1, seed=0, ext=(20.0, 20.0))).toPandas().sort_values("n")["h"].to_numpy().reshape(60, 60)
    assert abs(h[0, 0]) < 1e-12 and np.abs(h).max() <= 1 and h.std() > 0.15
    assert max(np.abs(np.diff(h, axis=0)).max(), np.abs(np.diff(h, axis=1)).max()) < 0.35
    other = simplex_noise(df, NoiseParams(octaves=1, seed=1, ext=(20.0, 20.0))).toPandas().sort_values("n")["h"].to_numpy()
    assert abs(np.corrcoef(h.ravel(), other)[0, 1]) < 0.3
    assert simplex_noise(df.limit(0)).columns == ["n", "x", "y", "h"]


def test_pyramid_sketches_are_near_the_counts(spark):
    from pyspark.sql import functions as F

    from tarn.operators.pyramid import tile_pyramid

    df = spark.sql("SELECT id AS n, CAST(id DIV 200 - 30 AS INT) AS x, CAST(id % 200 AS INT) AS y, CAST(id AS DOUBLE) AS h FROM range(40000)").withColumn("k", F.xxhash64("n") % 9000)
    got = tile_pyramid(df, 5, 16, key=F.col("k")).toPandas()
    cells = df.toPandas()
    assert set(got["level"]) == set(range(5))
    for level in range(5):
        side = 16 * 2**level
        want = cells.assign(tx=cells["x"] // side, ty=cells["y"] // side).groupby(["tx", "ty"]).agg(cells=("n", "size"), keys=("k", "nunique"), total=("h", "sum"))
        mine = got[got["level"] == level].set_index(["tx", "ty"]).sort_index()
        assert (mine["cells"] == want["cells"]).all() and np.allclose(mine["total"], want["total"])
        assert (abs(mine["distinct"] - want["keys"]) <= 0.08 * want["keys"] + 1).all()  # five deviations of 1.04 / 2 ** 6


def test_draws_made_by_tiles_are_those_of_the_whole(spark):
    """Missing values, NaN and infinities among them, tiles of 8 cells a side; and what is kept doesn't grow with all draws."""
    from pathlib import Path

    from pyspark.sql import functions as F

    odd = {97: None, 89: float("nan"), 83: float("inf"), 79: float("-inf")}
    h = np.random.default_rng(1).random((37, 23)) * 20 + np.arange(37)[:, None] * 3.0
    rows = [(n, n // 23, n % 23, next((v for k, v in odd.items() if n % k == 0), float(h.flat[n]))) for n in range(h.size)]
    df = spark.createDataFrame(rows, "n long, x int, y int, h double")
    draws = flow.random_weighted(df, 23, "D8", 3, temperature=10.0, runs=5)
    key = F.col("run").cast("long") * 1024
    graph = draws.select((key + F.col("n")).alias("n"), F.when(F.col("nxt") >= 0, key + F.col("nxt")).otherwise(-1).alias("nxt"))
    want = {r["k"]: r["t"] for r in flow.accumulate(graph).groupBy((F.col("n") % 1024).alias("k")).agg((F.sum("total") / 5).alias("t")).collect()}
    got = {r["n"]: r["total"] for r in flow.multiflow(df, 23, 1024, 5, seed=3, side=8).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - t) < 1e-9 for n, t in want.items())

    def kept() -> int:
        return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file())

    wide, before = from_array(spark, np.random.default_rng(2).random((300, 100))), kept()
    assert flow.multiflow(wide, 100, 1 << 20, 64).count() == 30_000
    assert kept() - before < 30_000 * 64


def test_a_temperature_of_zero_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        flow.multiflow(from_array(spark, np.ones((2, 2))), 2, 16, 2, temperature=0.0)
