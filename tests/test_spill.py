import heapq

import numpy as np
import pytest

from tarn.operators import flow, spill
from tarn.plans.model import Edge


def flooded(h, shifts):
    """Priority flood from all cells that touch a missing one."""
    h = np.asarray(h, float)
    out, queue, inside = np.full(h.shape, np.nan), [], lambda x, y: 0 <= x < h.shape[0] and 0 <= y < h.shape[1] and not np.isnan(h[x, y])
    for x, y in np.argwhere(~np.isnan(h)).tolist():
        if any(not inside(x + dx, y + dy) for dx, dy in shifts):
            heapq.heappush(queue, (h[x, y], x, y))
    while queue:
        w, x, y = heapq.heappop(queue)
        if not np.isnan(out[x, y]):
            continue
        out[x, y] = w
        for dx, dy in shifts:
            if inside(x + dx, y + dy) and np.isnan(out[x + dx, y + dy]):
                heapq.heappush(queue, (max(w, h[x + dx, y + dy]), x + dx, y + dy))
    return out


def lake(r, nx, ny):
    """A basin over most of the raster, with a rim that has one low place, and islands."""
    x, y = np.indices((nx, ny))
    h = 5 + np.hypot(x - nx / 2, y - ny / 2) / 10 + r.uniform(0, 0.01, (nx, ny))
    h[1, :], h[-2, :], h[:, 1], h[:, -2] = 50, 50, 50, 50
    h[nx // 2, -2], h[nx // 3, ny // 3] = 20, np.nan
    return h


CASES = {
    "noise": lambda r: r.uniform(0, 9, (37, 29)), "steps": lambda r: r.integers(0, 4, (40, 23)).astype(float), "flat": lambda r: np.ones((19, 17)),
    "holes": lambda r: np.where(r.uniform(size=(33, 31)) < 0.05, np.nan, r.uniform(0, 9, (33, 31))), "lake": lambda r: lake(r, 50, 41), "row": lambda r: r.uniform(0, 9, (1, 40)),
}


@pytest.mark.parametrize("edge", [Edge.D4, Edge.D8])
@pytest.mark.parametrize("name", CASES)
def test_filled_equals_priority_flood(spark, name, edge):
    h = CASES[name](np.random.default_rng(len(name)))
    nx, ny = h.shape
    rows = [(x * ny + y, x, y, float(h[x, y])) for x in range(nx) for y in range(ny)]
    df = spark.createDataFrame(rows, "n long, x int, y int, h double").repartition(3)
    want = flooded(h, edge.shifts)
    for side, fan in ((4, 2), (7, 16)):
        got = flow.fill_depressions(df, edge, side=side, fan=fan).toPandas().sort_values("n")["h"].to_numpy().reshape(nx, ny)
        assert np.array_equal(got, want, equal_nan=True), (side, fan)


def test_missing_cells_and_other_columns(spark):
    h = np.random.default_rng(3).uniform(0, 9, (20, 20))
    h[5:9, 4:7] = np.nan
    rows = [(x * 20 + y, x, y, float(h[x, y]), "k") for x in range(20) for y in range(20) if not np.isnan(h[x, y])]
    got = flow.fill_depressions(spark.createDataFrame(rows, "n long, x int, y int, h double, w string"), side=6, fan=2).toPandas().sort_values("n")
    assert list(got.columns) == ["n", "x", "y", "h", "w"] and set(got["w"]) == {"k"}
    want = flooded(h, Edge.D8.shifts)
    assert np.array_equal(got["h"].to_numpy(), want[~np.isnan(want)])
    assert flow.fill_depressions(spark.createDataFrame([], "n long, x int, y int, h double")).count() == 0


def test_shuffles_do_not_grow_with_depressions(spark):
    """The same plan for noise and for a lake that reaches over all tiles."""
    import io
    from contextlib import redirect_stdout

    counts = []
    for h in (np.random.default_rng(1).uniform(0, 9, (40, 40)), lake(np.random.default_rng(1), 40, 40)):
        df = spark.createDataFrame([(x * 40 + y, x, y, float(h[x, y])) for x in range(40) for y in range(40)], "n long, x int, y int, h double")
        with redirect_stdout(text := io.StringIO()):
            flow.fill_depressions(df, side=4, fan=4).explain()
        counts.append(text.getvalue().count("Exchange"))
    assert counts[0] == counts[1] <= 4


def test_drained_takes_the_lowest_way():
    r = np.random.default_rng(5)
    n = 60
    for _ in range(20):
        a, b, w = r.integers(0, n, 150), r.integers(0, n, 150), r.integers(0, 20, 150).astype(float)
        kept = r.uniform(size=n) < 0.15
        kept[0] = True
        owner, cost, used = spill.drained(n, a, b, w, kept)
        level = np.where(kept, -np.inf, np.inf)
        for _ in range(n):  # plain relaxation
            for i, j, h in zip(a, b, w, strict=True):
                level[i], level[j] = min(level[i], max(level[j], h)), min(level[j], max(level[i], h))
        reached = np.isfinite(level) | kept
        assert (kept[owner] == reached).all()
        assert (cost[reached & ~kept] == level[reached & ~kept]).all()
        assert len(used) == len(set(used.tolist()))


def stepped(h, shifts, rise):
    """Breadth-first from the cells of flats that drain."""
    inside = lambda x, y: 0 <= x < h.shape[0] and 0 <= y < h.shape[1] and not np.isnan(h[x, y])
    near = lambda x, y: [(x + dx, y + dy) for dx, dy in shifts]
    front = [(x, y) for x, y in np.argwhere(~np.isnan(h)).tolist() if any(not inside(*c) or h[c] < h[x, y] for c in near(x, y))]
    steps = {c: 0 for c in front}
    while front:
        new = []
        for c in front:
            for d in near(*c):
                if inside(*d) and h[d] == h[c] and d not in steps:
                    steps[d] = steps[c] + 1
                    new.append(d)
        front = new
    out = h.copy()
    for c, k in steps.items():
        out[c] += rise * k
    return out


@pytest.mark.parametrize("side", [5, 256])
def test_flats_rise_towards_where_they_drain(spark, side):
    r = np.random.default_rng(2)
    maze = np.where(r.uniform(size=(31, 27)) < 0.3, 2.0, 1.0)
    maze[0, :], maze[-1, :], maze[:, 0], maze[:, -1] = 3, 3, 3, 3
    maze[0, 5] = 0.5
    terraces, shifts = r.integers(0, 3, (31, 27)).astype(float), Edge.D8.shifts
    terraces[8:20, 6:18], terraces[12, 9] = 1, np.nan
    for h in (maze, terraces):
        df = spark.createDataFrame([(x * 27 + y, x, y, float(h[x, y])) for x in range(31) for y in range(27)], "n long, x int, y int, h double").repartition(2)
        got = flow.resolve_flats(df, 0.25, side=side).toPandas().sort_values("n")["h"].to_numpy().reshape(31, 27)
        assert np.array_equal(got, stepped(h, shifts, 0.25), equal_nan=True)


def test_flats_are_found_without_windows(spark, monkeypatch):
    """Dealing cells into tiles takes no lambda for each cell, and flats no sorts within tiles."""
    from tarn.operators import flats

    plans = []
    monkeypatch.setattr(flats, "settled", lambda df, f=flats.settled: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    h = np.random.default_rng(4).integers(0, 3, (23, 19)).astype(float)
    df = spark.createDataFrame([(x * 19 + y, x, y, float(h[x, y])) for x in range(23) for y in range(19)], "n long, x int, y int, h double")
    got = flow.resolve_flats(df, 0.25, side=6).toPandas().sort_values("n")["h"].to_numpy().reshape(23, 19)
    assert np.array_equal(got, stepped(h, Edge.D8.shifts, 0.25))
    assert "Window" not in plans[0] and not any("lambda" in p for p in plans)


@pytest.mark.parametrize("radius, side", [(1, 1), (1, 2), (2, 3), (1, 4)])
def test_tiles_get_the_cells_around_them(spark, radius, side):
    from tarn.operators.stencil import in_tiles

    df = spark.createDataFrame([(x, y) for x in range(9) for y in range(5)], "x int, y int")
    got = {(r["x"], r["y"], r["__tx"], r["__ty"], r["__own"]) for r in in_tiles(df, radius, side).collect()}
    near = lambda k: {(k + d) // side for d in (-radius, 0, radius)}
    assert got == {(x, y, tx, ty, tx == x // side and ty == y // side) for x in range(9) for y in range(5) for tx in near(x) for ty in near(y)}
