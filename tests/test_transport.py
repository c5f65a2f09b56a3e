"""Particles on straight channels, where the result is known."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import transport
from tarn.plans.erosion import erode
from tarn.plans.model import Grid, Params, constant
from tarn.plans.state import scratch, settled


def test_uniform_flow_gathers_downstream(spark):
    g = Grid(16, 4)
    cells = constant(spark, g, 1.0, "s").withColumns({"vx": F.lit(1.0), "vy": F.lit(0.0), "decay": F.lit(0.0)})
    rows = transport.solve_uniform(cells, g, 20_000, ["s"]).orderBy("n").collect()
    flux = np.array([r["flux_s"] for r in rows]).reshape(16, 4)
    # A cell with n cells upstream gets their sources and its own. Starts beyond the last row's corner have no flow.
    np.testing.assert_allclose(flux[:, :3].mean(axis=1), 1 + np.arange(16) * 1.0, rtol=0.1)
    np.testing.assert_allclose(flux[:, 3], 1.0)


def test_no_flow_is_null(spark):
    g = Grid(4, 4)
    cells = constant(spark, g, 1.0, "s").withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0), "decay": F.lit(0.0)})
    assert all(r["flux_s"] is None for r in transport.solve_uniform(cells, g, 100, ["s"]).collect())
    with pytest.raises(ValueError):
        transport.solve_uniform(cells, g, 100, ["s", "s", "s"])


def test_result_is_the_same_for_any_partitions(spark, monkeypatch):
    g = Grid(12, 8)
    cells = constant(spark, g, 1.0, "s").withColumns({"vx": F.lit(0.7), "vy": F.lit(0.2), "decay": F.lit(0.01)})
    a = transport.solve_uniform(cells, g, 9000, ["s"]).orderBy("n").collect()
    monkeypatch.setattr(transport, "PARTICLES", 100)
    b = transport.solve_uniform(cells, g, 9000, ["s"]).orderBy("n").collect()
    assert [r["flux_s"] for r in a] == pytest.approx([r["flux_s"] for r in b])


def test_tiles_give_the_same(spark, monkeypatch):
    g = Grid(23, 14)
    cells = constant(spark, g, 1.0, "s").withColumns({"vx": F.lit(0.7) + F.col("y") * 0.01, "vy": F.sin("x"), "decay": F.lit(0.01)})
    loaded = _slope(spark, g, 1.5).withColumn("bedrock", F.col("bedrock") + F.sin(F.col("y") * 0.7))
    runs = (lambda: transport.solve_uniform(cells, g, 3000, ["s"]), lambda: transport.transport_fluvial(loaded, g, 3000), lambda: transport.transport_debris(loaded, g, 3000))
    whole = [f().orderBy("n").collect() for f in runs]
    monkeypatch.setattr(transport, "FIELD_BYTES", 10)
    monkeypatch.setattr(transport, "TILE", 5)
    monkeypatch.setattr(transport, "CROWD", 100)
    for f, want in zip(runs, whole, strict=True):
        for a, b in zip(f().orderBy("n").collect(), want, strict=True):
            assert list(a) == pytest.approx(list(b), rel=1e-9, nan_ok=True)


def _slope(spark, g, tilt=0.1):
    rows = constant(spark, g, 0.0, "sediment").withColumn("bedrock", F.col("x") * tilt)
    zero = {c: F.lit(0.0) for c in ("water", "mass", "vx", "vy", "debris", "dvx", "dvy")}
    return rows.withColumns({"rain": F.lit(1.0), "uplift": F.lit(0.0), "r": F.lit(0.5), "g": F.lit(0.4), "b": F.lit(0.3)} | zero)


def test_water_gathers_at_the_foot(spark):
    g = Grid(24, 6)
    p = Params(evap_rate=0.0)
    rows = transport.transport_fluvial(_slope(spark, g), g, 20_000, p).orderBy("n").collect()
    water = np.array([r["water"] for r in rows]).reshape(24, 6).mean(axis=1)
    assert water[2] > water[12] > water[22] >= 1.0
    assert {r["albedo_r"] for r in rows} == {0.5}


def test_debris_needs_a_steep_slope(spark):
    g = Grid(12, 4)
    calm = transport.transport_debris(_slope(spark, g, 0.1), g, 2000).agg(F.max("debris")).first()[0]
    steep = transport.transport_debris(_slope(spark, g, 2.0), g, 2000).agg(F.max("debris")).first()[0]
    assert calm == 0 and steep > 0


def test_two_steps_keep_the_grid(spark):
    g = Grid(8, 6)
    out = erode(_slope(spark, g), g, 500, 2)
    assert out.count() == 48
    assert out.where("bedrock IS NULL OR sediment IS NULL OR isnan(bedrock + sediment)").count() == 0


def test_particles_to_and_fro_over_a_border_take_few_rounds(spark, monkeypatch):
    g = Grid(40, 4)
    cells = constant(spark, g, 1.0, "s").withColumns({"vx": F.when(F.col("x") < 16, 1.0).otherwise(-1.0), "vy": F.lit(0.0), "decay": F.lit(0.0)})
    whole = transport.solve_uniform(cells, g, 50, ["s"]).orderBy("n").collect()
    monkeypatch.setattr(transport, "FIELD_BYTES", 10)
    monkeypatch.setattr(transport, "TILE", 8)
    kept, settled = [], transport.settled
    monkeypatch.setattr(transport, "settled", lambda df: kept.append(1) or settled(df))
    tiled = transport.solve_uniform(cells, g, 50, ["s"]).orderBy("n").collect()
    assert [r["flux_s"] for r in tiled] == pytest.approx([r["flux_s"] for r in whole])
    assert len(kept) <= 9  # particles cross x = 16 some forty times, from a tile to the next twice


def test_steps_leave_only_the_last_state(spark):
    """Tables of earlier steps, and what a step had settled for itself, are removed; so are the shuffles that made them."""

    def kept() -> int:
        return len({p.parent for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*")})

    g, before = Grid(8, 6), kept()
    out = erode(_slope(spark, g), g, 500, 2)
    assert kept() == before + 1 and out.count() == g.cells


def test_a_settled_table_leaves_no_shuffle(spark):
    blocks = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    shuffled = lambda: {b for b in blocks() if "shuffle_" in b and b.endswith(".data")}
    before = shuffled()
    with scratch() as keep:
        gone, out = (settled(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()) for _ in range(2))
        keep(out)
    until = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < until:  # files are removed in the background
        time.sleep(0.2)
    assert not shuffled() - before
    assert out.count() == 5000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    with pytest.raises(Exception):  # noqa: B017
        gone.count()
