"""Particles walked one at a time with plain numbers, beside the operators' results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import transport
from tarn.plans.model import Grid, Params, constant
from tarn.sources import images

G = Grid(11, 8, 2.0, 3.0, 1.5)
P = Params(maxage=40)


def number(n, seed):
    x = (n * 2654435761 + seed * 40503) % 2**32
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) % 2**32
    return (x ^ (x >> 16)) / 2**32


def fields(spark, high):
    r = np.random.default_rng(12)
    names = ["bedrock", "sediment", "rain", "water", "vx", "vy", "dvx", "dvy", "r", "g", "b"]
    values = {k: r.random(G.cells) * (high if k == "bedrock" else 1) + 0.01 for k in names}
    rows = [(n, n // G.ny, n % G.ny, *(float(values[k][n]) for k in names)) for n in range(G.cells)]
    return values, spark.createDataFrame(rows, "n long, x int, y int, " + ", ".join(f"{k} double" for k in names))


def slopes(values):
    """The steeper one-sided difference along x and y; beyond the border the ground falls by the exit slope."""
    height, out = (values["bedrock"] + values["sediment"]).reshape(G.nx, G.ny), {}
    for name, (dx, dy), s in (("ux", (1, 0), G.sx), ("uy", (0, 1), G.sy)):
        u = np.zeros((G.nx, G.ny))
        for i in range(G.nx):
            for j in range(G.ny):
                h, low, high = height[i, j], (i - dx, j - dy), (i + dx, j + dy)
                fall = (h - height[low]) * G.sz / s if min(low) >= 0 else P.exit_slope
                rise = (height[high] - h) * G.sz / s if high[0] < G.nx and high[1] < G.ny else -P.exit_slope
                fall, rise = max(0.0, fall), min(0.0, rise)
                u[i, j] = rise if abs(rise) > abs(fall) else fall
        out[name] = u.ravel()
    return out


def way(p, d):
    return min(math.sqrt(2), max((math.floor(p) - p) / d, (math.floor(p) + 1 - p) / d)) if d else math.sqrt(2)


def walk(samples, seed, start, step):
    """The sums that particles leave in each cell that they enter."""
    total = {}
    for i in range(samples):
        px, py = 0.5 + (1 - number(2 * i, seed)) * (G.nx - 1), 0.5 + (1 - number(2 * i + 1, seed)) * (G.ny - 1)
        last = int(px) * G.ny + int(py)
        state, age = start(last), 0
        while state["speed"] is not None and age < P.maxage - 1 and 0 <= px < G.nx and 0 <= py < G.ny:
            cell = int(px) * G.ny + int(py)
            if cell != last:
                for k, v in state["leaves"]().items():
                    total[cell, k] = total.get((cell, k), 0.0) + v
            sx, sy = state["speed"]
            size = math.sqrt(sx * sx + sy * sy)
            if size < 1e-12:
                break
            length = (way(px, sx / size) + way(py, sy / size)) / 2
            step(state, cell, length * math.hypot(G.sx, G.sy), size)
            px, py, last, age = px + length * sx / size, py + length * sy / size, cell, age + 1
    return total


def begun(ax, ay):
    root = math.sqrt(math.sqrt((G.sx * ax) ** 2 + (G.sy * ay) ** 2))
    return (ax / root, ay / root) if root else None


def water(v, samples, seed):
    """What rain leaves on its way, by particles of plain numbers: water, mass, vx, vy and colour of each cell."""
    u = slopes(v)
    share = G.sx * G.sy * G.cells / samples
    pull = lambda n: (-P.gravity * u["ux"][n] + P.viscosity_water * v["vx"][n], -P.gravity * u["uy"][n] + P.viscosity_water * v["vy"][n])

    def start(n):
        a, shear = pull(n), 0.125 * P.friction_factor / 8 * P.density_water * (v["vx"][n] ** 2 + v["vy"][n] ** 2)
        mass = share * P.suspension_fluvial / 64 * (shear * math.hypot(u["ux"][n], u["uy"][n])) ** 2
        s = {"speed": begun(*a), "water": share * P.rainfall * v["rain"][n], "mass": mass, "mx": share * a[0], "my": share * a[1], "colour": [v[c][n] for c in "rgb"]}
        s["leaves"] = lambda: {"water": s["water"], "mass": s["mass"], "mx": s["mx"], "my": s["my"]} | {c: s["mass"] * x for c, x in zip("rgb", s["colour"], strict=True)}
        return s

    def step(s, n, far, size):
        a, slow = pull(n), P.bed_shear_water + P.viscosity_water
        s["speed"] = tuple((x + far * y) / (1 + far * slow) for x, y in zip(s["speed"], a, strict=True))
        s["water"] *= math.exp(-far / size * P.evap_rate)
        s["mass"] *= math.exp(-far / size * P.deposition_fluvial * 1.33)
        for k in ("mx", "my"):
            s[k] *= math.exp(-far * 0.125 * P.friction_factor / 8 / (1e-12 + v["water"][n]))

    total, area = walk(samples, seed, start, step), G.sx * G.sy
    got = lambda k: np.array([total.get((n, k), 0.0) for n in range(G.cells)])
    out = {"water": (area * v["rain"] + got("water")) / G.sy, "mass": got("mass") / G.sy, "vx": (-area * P.gravity * u["ux"] + got("mx")) / G.sy, "vy": (-area * P.gravity * u["uy"] + got("my")) / G.sy}
    return out | {"albedo_g": np.where(got("mass") > 0, got("g") / np.where(got("mass") > 0, got("mass"), 1), v["g"])}


def debris(v, samples, seed):
    """What slides leave on their way: debris, dvx, dvy and colour of each cell."""
    u = slopes(v)
    share = G.sx * G.sy * G.cells / samples
    steep = lambda n: math.hypot(u["ux"][n], u["uy"][n])
    pull = lambda n: (-P.gravity * u["ux"][n] + P.viscosity_debris * v["dvx"][n], -P.gravity * u["uy"][n] + P.viscosity_debris * v["dvy"][n])

    def start(n):
        a, load = pull(n), share * max(0.0, P.landslide_rate * (steep(n) - P.crit_slope_bedrock))
        s = {"speed": begun(*a), "load": load, "mx": share * a[0], "my": share * a[1], "colour": [v[c][n] for c in "rgb"]}
        s["leaves"] = lambda: {"load": s["load"], "mx": s["mx"], "my": s["my"]} | {c: s["load"] * x for c, x in zip("rgb", s["colour"], strict=True)}
        return s

    def step(s, n, far, size):
        a, height = pull(n), 1e-12 + s["load"]
        slow = P.viscosity_debris + P.bed_shear_debris / height
        stress = P.gravity * (steep(n) - P.crit_slope_bedrock - P.yield_stress / height)
        s["speed"] = tuple((x + far * y) / (1 + far * slow) for x, y in zip(s["speed"], a, strict=True))
        power = far / size * (P.deposition_debris if stress < 0 else P.suspension_debris) * stress / size
        if power > 709:  # beyond any number: the particle ends
            s["speed"] = None
            return
        s["load"] *= math.exp(power)
        for k in ("mx", "my"):
            s[k] *= math.exp(-far * slow)

    total, area = walk(samples, seed, start, step), G.sx * G.sy
    got = lambda k: np.array([total.get((n, k), 0.0) for n in range(G.cells)])
    out = {"debris": got("load") / G.sy, "dvx": (-area * P.gravity * u["ux"] + got("mx")) / G.sy, "dvy": (-area * P.gravity * u["uy"] + got("my")) / G.sy}
    return out | {"albedo_b": np.where(got("load") > 0, got("b") / np.where(got("load") > 0, got("load"), 1), v["b"])}


def test_water_equals_single_walks(spark):
    v, df = fields(spark, 30)
    want = water(v, 400, 3)
    for r in transport.transport_fluvial(df, G, 400, P, 3).collect():
        for k, rel in (("water", 1e-9), ("mass", 1e-9), ("vx", 1e-8), ("vy", 1e-8), ("albedo_g", 1e-9)):
            assert r[k] == pytest.approx(want[k][r["n"]], rel=rel, abs=1e-30)


def test_debris_equals_single_walks(spark):
    v, df = fields(spark, 4)
    want = debris(v, 400, 4)
    assert want["debris"].max() > 0
    for r in transport.transport_debris(df, G, 400, P, 4).collect():
        for k in ("debris", "dvx", "albedo_b"):
            assert r[k] == pytest.approx(want[k][r["n"]], rel=1e-6, abs=1e-12)


def eroded(v, samples, seed):
    """One step of the loop with plain numbers: exchange with water and slides, creep, uplift."""
    now, slope = water(v, samples, seed) | debris(v, samples, seed + 1), np.hypot(*slopes(v).values())
    speed, length = np.hypot(now["vx"], now["vy"]), math.hypot(G.sx, G.sy)
    up = P.suspension_fluvial / 64 * (0.125 * P.friction_factor / 8 * P.density_water * speed**2 * slope) ** P.fluvial_exponent
    excess = slope - P.crit_slope_bedrock
    shear = P.gravity * (now["debris"] * excess - P.yield_stress)
    slide = np.maximum(0, P.landslide_rate * excess) + P.suspension_debris * np.maximum(0, shear)
    settle = np.minimum(now["debris"], np.maximum(0, -P.deposition_debris * shear))
    change = P.time_step * (P.deposition_fluvial * 1.33 * now["mass"] - up + settle - slide)
    t = np.maximum(-0.25 * length * slope, np.minimum(change, 0.25 * length * 0.3)) / G.sz
    loose = np.where(t > 0, t, np.maximum(t, -v["sediment"]))
    shape = (G.nx, G.ny)
    sed, top = v["sediment"].reshape(shape) * G.sz, (v["bedrock"] + v["sediment"]).reshape(shape) * G.sz
    creep = np.zeros(shape)
    for i in range(G.nx):
        for j in range(G.ny):
            for a, b, far in ((i - 1, j, G.sx), (i + 1, j, G.sx), (i, j - 1, G.sy), (i, j + 1, G.sy)):
                if 0 <= a < G.nx and 0 <= b < G.ny:
                    fall = abs(top[i, j] - top[a, b]) - P.crit_slope_sediment * far
                    give = max(0.0, min(sed[i, j] if top[i, j] > top[a, b] else sed[a, b], 0.5 * fall))
                    creep[i, j] += -give if top[i, j] > top[a, b] else give
    raised = P.time_step * P.uplift * v["uplift"] / G.sz
    layers = {"bedrock": v["bedrock"] + raised + np.where(t < 0, t - loose, 0), "sediment": v["sediment"] + loose + 0.25 * creep.ravel() / G.sz}
    return v | {k: now[k] for k in ("water", "mass", "vx", "vy", "debris", "dvx", "dvy")} | layers


def test_steps_of_the_loop_equal_plain_numbers(spark):
    from tarn.plans.erosion import erode

    v, df = fields(spark, 6)
    v |= {"mass": np.zeros(G.cells), "debris": np.zeros(G.cells), "uplift": np.arange(G.cells) / G.cells}
    df = df.withColumns({"mass": F.lit(0.0), "debris": F.lit(0.0), "uplift": F.col("n") / float(G.cells)})
    got = erode(df, G, 150, 4, P, 9).toPandas().sort_values("n")
    start = v
    for k in range(4):
        v = eroded(v, 150, 9 + 2 * k)
    assert np.abs(v["sediment"] - start["sediment"]).max() > 0.1
    for k in ("bedrock", "sediment", "water", "debris", "vx"):
        np.testing.assert_allclose(got[k].to_numpy(), v[k], rtol=1e-5, atol=1e-8, err_msg=k)


def test_uniform_equals_single_walks(spark):
    r = np.random.default_rng(5)
    vx, vy, s = r.random(G.cells) - 0.2, r.random(G.cells) - 0.5, r.random(G.cells)
    rows = [(n, n // G.ny, n % G.ny, float(vx[n]), float(vy[n]), 0.02, float(s[n])) for n in range(G.cells)]
    df, samples, total = spark.createDataFrame(rows, "n long, x int, y int, vx double, vy double, decay double, s double"), 500, {}
    for i in range(samples):
        px, py = (1 - number(2 * i, 0)) * G.nx, (1 - number(2 * i + 1, 0)) * G.ny
        if px >= G.nx or py >= G.ny:
            continue
        last, att, age = int(px) * G.ny + int(py), 1.0, 0
        load = s[last] * G.sx * G.sy * G.cells
        while age < G.nx + G.ny and 0 <= px < G.nx and 0 <= py < G.ny and abs(att) > 1e-16:
            cell = int(px) * G.ny + int(py)
            if cell != last:
                total[cell] = total.get(cell, 0.0) + load * att
            if px > G.nx - 1 or py > G.ny - 1:
                break
            x, y = int(px), int(py)
            a, b = (0 if x >= G.nx - 1 else px - x), (0 if y >= G.ny - 1 else py - y)
            x2, y2 = min(x + 1, G.nx - 1), min(y + 1, G.ny - 1)
            u, w = (f[x * G.ny + y] * (1 - a) * (1 - b) + f[x * G.ny + y2] * (1 - a) * b + f[x2 * G.ny + y] * a * (1 - b) + f[x2 * G.ny + y2] * a * b for f in (vx, vy))
            size = math.hypot(u, w)
            length = (way(px, u / size) + way(py, w / size)) / 2
            att *= math.exp(-length * math.hypot(G.sx, G.sy) / size * 0.02)
            px, py, last, age = px + length * u / size, py + length * w / size, cell, age + 1
    for row in transport.solve_uniform(df, G, samples, ["s"]).collect():
        n = row["n"]
        want = (s[n] * G.sx * G.sy + total.get(n, 0.0) / samples) / (abs(vx[n]) * G.sy + abs(vy[n]) * G.sx)
        assert row["flux_s"] == pytest.approx(want, rel=1e-7)


def filtered(values, kinds):
    """A PNG whose rows use the given filters, made from their definitions."""
    import struct
    import zlib

    h, w, n = values.shape
    out = b""
    for y in range(h):
        row, up = values[y].ravel().astype(int), values[y - 1].ravel().astype(int) if y else np.zeros(w * n, int)
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        out += bytes([kinds[y], *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png_filters():
    values = np.random.default_rng(1).integers(0, 256, (10, 7, 3)).astype(np.uint8)
    np.testing.assert_array_equal(images.decode_png(filtered(values, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])), values)
    with pytest.raises(ValueError):
        images.decode_png(b"no image")


def test_levels_keep_the_ground(spark):
    from tarn.plans.erosion import erode_levels

    g = Grid(8, 8)
    cells = constant(spark, g, 1.0, "bedrock").withColumns({c: F.lit(0.5) for c in ("sediment", "rain", "uplift", "water", "mass", "vx", "vy", "debris", "dvx", "dvy", "r", "g", "b")})
    out = erode_levels(cells, g, [(Grid(4, 4, 2.0, 2.0), 1), (g, 1)], 200)
    assert out.count() == 64 and out.where("bedrock IS NULL OR isnan(bedrock)").count() == 0
