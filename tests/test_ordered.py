import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions.values import uniform
from tarn.operators import flow, ordered
from tarn.plans import state


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("each", [1 << 20, 7])
@pytest.mark.parametrize("exact", [True, False])
def test_as_of_equals_a_search(spark, each, exact):
    r = np.random.default_rng(4)
    left = [(i, "hot" if r.uniform() < 0.5 else str(r.integers(0, 4)), float(r.integers(0, 60))) for i in range(150)] + [(900, None, 5.0), (901, "hot", None), (902, "gone", 3.0)]
    right = [("hot" if r.uniform() < 0.5 else str(r.integers(0, 4)), float(r.integers(0, 60)), int(r.integers(0, 5))) for _ in range(120)] + [(None, 1.0, 1), ("hot", None, 2)]
    want = []
    for i, k, t in left:
        ok = [x for x in right if x[0] == k is not None and None not in (t, x[1]) and (x[1] <= t if exact else x[1] < t)]
        best = max(ok, key=lambda x: (x[1], x[2]), default=None)
        want.append((i, k, t, *(best or (None,) * 3)))
    a, b = spark.createDataFrame(left, "id long, k string, t double").repartition(3), spark.createDataFrame(right, "k string, at double, v int").repartition(2)
    got = ordered.as_of(a, b, "t", "at", [("k", "k")], exact=exact, each=each)
    assert got.columns == ["id", "k", "t", "r_k", "r_at", "r_v"]
    assert rows_of(got) == sorted(want, key=str)
    near = ordered.as_of(a, b, "t", "at", [("k", "k")], within=F.lit(2.0), exact=exact, each=each)
    assert rows_of(near) == sorted(((*w[:3], None, None, None) if w[4] is None or w[4] < w[2] - 2 else w for w in want), key=str)
    assert ordered.as_of(a.limit(0), b, "t", "at", [("k", "k")]).count() == 0
    assert ordered.as_of(a, b.limit(0), "t", "at").where("r_v is null").count() == len(left)


def test_as_of_without_key_and_by_time(spark):
    a = spark.sql("SELECT id, timestamp_seconds(id * 100) AS t FROM range(9)")
    b = spark.sql("SELECT timestamp_seconds(id * 250) AS t, id AS v FROM range(3)")
    got = ordered.as_of(a, b, "t", "t", within=F.expr("INTERVAL 120 SECONDS"), each=2)
    assert [r["r_v"] for r in got.orderBy("id").collect()] == [0, 0, None, 1, None, 2, 2, None, None]


@pytest.mark.parametrize("crowded", [100_000, 3])
def test_intervals_equal_a_loop(spark, monkeypatch, crowded):
    monkeypatch.setattr(ordered, "CROWDED", crowded)
    r = np.random.default_rng(5)
    points = [(i, int(r.integers(0, 3)), float(r.choice([7.0, r.uniform(0, 100)]))) for i in range(120)] + [(500, None, 1.0), (501, 1, None)]
    spans = [(i, int(r.integers(0, 3)), (a := float(r.uniform(-5, 100))), a + float(r.choice([0.3, 4, 60, 0, -2]))) for i in range(60)] + [(90, 1, None, 4.0), (91, 1, 7.0, 8.0), (92, None, 0.0, 9.0)]
    want = [(*p, *s) for p in points for s in spans if p[1] == s[1] is not None and None not in (p[2], s[2]) and s[2] <= p[2] < s[3]]
    a, b = spark.createDataFrame(points, "id long, k int, t double"), spark.createDataFrame(spans, "id long, k int, a double, b double")
    got = ordered.within_intervals(a, b, "t", "a", "b", [("k", "k")])
    assert rows_of(got) == sorted(want, key=str) and want
    assert ordered.within_intervals(a, b.limit(0), "t", "a", "b").count() == 0


def test_running_sum_over_slices(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("n"), (F.col("id") % 7).cast("double").alias("s"))
    got = ordered.running_sum(df, "n", "s", "upto", each=9).orderBy("n").collect()
    assert np.array_equal([r["upto"] for r in got], np.cumsum([r["s"] for r in got]))


def test_slices_follow_the_distribution(spark):
    df = spark.range(5000).select(F.exp(F.col("id") / 500).alias("v"))
    sizes = [r["count"] for r in df.groupBy(ordered.slices(df, F.col("v"), 50).alias("s")).count().collect()]
    assert len(sizes) > 90 and max(sizes) < 120


def slope(spark, n=1200, ny=30):
    r = np.random.default_rng(8)
    x, y = np.indices((n // ny, ny))
    h = x * 3.0 + r.uniform(0, 4, x.shape)
    df = spark.createDataFrame([(int(i * ny + j), int(i), int(j), float(h[i, j])) for i in range(n // ny) for j in range(ny)], "n long, x int, y int, h double")
    return flow.steepest(df, ny).select("n", "nxt").cache()


@pytest.mark.parametrize("iterations", [None, 1, 6, 13])
@pytest.mark.parametrize("mode", ["even", "weighted", "reservoir"])
def test_sampled_walks_equal_walks_one_by_one(spark, monkeypatch, mode, iterations):
    monkeypatch.setattr(state, "HOT_ROWS", 20)
    graph, samples = slope(spark), 700
    to = {r["n"]: r["nxt"] for r in graph.collect()}
    s = {n: float(n % 5) for n in to}
    weights = spark.createDataFrame(list(s.items()), "n long, s double") if mode != "even" else None
    u = [r["u"] for r in spark.range(samples).select(uniform(F.col("id"), 3).alias("u")).collect()]
    edges, want = np.cumsum([s[n] for n in sorted(s)]), dict.fromkeys(to, 0.0)
    for x in u:
        start = int(np.searchsorted(edges, x * edges[-1], side="right")) if mode == "reservoir" else int(x * len(to))
        gives = edges[-1] if mode == "reservoir" else len(to) * (s[start] if mode == "weighted" else 1)
        n, k = start, 0
        while n >= 0 and (iterations is None or k < iterations):
            want[n] += gives / samples
            n, k = to[n], k + 1
    got = {r["n"]: r["total"] for r in flow.accumulate_sampled(graph, samples, iterations, weights, mode == "reservoir", 3, 30).collect()}
    assert got == pytest.approx(want)


def test_sampled_mean_is_near_the_sum(spark):
    graph, samples = slope(spark), 20_000
    exact = {r["n"]: r["total"] for r in flow.accumulate(graph, ny=30).collect()}
    got = {r["n"]: r["total"] for r in flow.accumulate_sampled(graph, samples, ny=30).collect()}
    for n, want in exact.items():  # the number of walks through a cell is binomial
        p = want / len(exact)
        assert abs(got[n] - want) <= 5 * len(exact) * np.sqrt(p * (1 - p) / samples) + 1e-9


@pytest.mark.parametrize("crowd", [4096, 3])
def test_paths_equal_walks(spark, monkeypatch, crowd):
    from tarn.operators import paths

    monkeypatch.setattr(paths, "CROWD", crowd)
    monkeypatch.setattr(paths, "BATCH", 50)
    graph = slope(spark, 600)
    to = {r["n"]: r["nxt"] for r in graph.collect()}
    starts = [(k, k * 37 % 600) for k in range(80)] + [(k, 5) for k in range(80, 120)] + [(200, None), (201, 9999)]
    want = []
    for i, n in starts:
        step = 0
        while n is not None and n >= 0 and n in to:
            want.append((i, step, n))
            n, step = to[n], step + 1
    got = paths.flow_paths(graph, spark.createDataFrame(starts, "id long, n long"), 30, side=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert paths.flow_paths(graph, spark.createDataFrame([], "id long, n long"), 30).count() == 0


def test_paths_in_sql(spark):
    from tarn.operators import paths

    paths.register(spark)
    spark.sql("SELECT 0 AS kind, id AS a, id + 1 AS b, 0L AS step, id DIV 3 AS tile, 0 AS part FROM range(6) UNION ALL SELECT 1, 1L, 77L, 4L, 0L, 0").createOrReplaceTempView("rows_of_tiles")
    got = spark.sql("SELECT * FROM flow_paths(TABLE(rows_of_tiles) PARTITION BY (tile, part))").collect()
    assert sorted(tuple(r) for r in got) == [(77, 4, 1, -1), (77, 5, 2, 3)]
    with pytest.raises(Exception, match="cycle"):
        spark.sql("SELECT 0 AS kind, id AS a, (id + 1) % 3 AS b, 0L AS step, 0 AS tile, 0 AS part FROM range(3) UNION ALL SELECT 1, 1L, 1L, 0L, 0, 0").createOrReplaceTempView("ring")
        spark.sql("SELECT * FROM flow_paths(TABLE(ring) PARTITION BY (tile, part))").collect()


def test_reservoirs_are_even(spark):
    graph = slope(spark)
    exact = {r["n"]: r["total"] for r in flow.accumulate(graph, ny=30).collect()}
    got = flow.upstream_sample(graph, 5, 3).toPandas()
    assert got.groupby("n").size().to_dict() == {n: min(5, t) for n, t in exact.items()}
    assert not got.duplicated(["n", "cell"]).any() and got.groupby("n")["place"].max().to_dict() == {n: min(5, t) - 1 for n, t in exact.items()}
    # Over many seeds each upstream cell of a large one is drawn about as often as any other.
    big = max(exact, key=exact.get)
    times = sum(flow.upstream_sample(graph, 5, seed).where(F.col("n") == big).groupBy("cell").count().toPandas().set_index("cell")["count"].reindex(range(1200), fill_value=0) for seed in range(4))
    assert times.sum() == 20 and times.max() <= 3
    with pytest.raises(ValueError):
        flow.upstream_sample(spark.createDataFrame([(0, 1), (1, 0)], "n long, nxt long"), most_rounds=8)


def test_reservoirs_over_many_tiles(spark, monkeypatch):
    ny, of = 30, flow.tiles_of
    graph = slope(spark)
    monkeypatch.setattr(flow, "tiles_of", lambda n: of(n, side=7))
    moved = []
    doubling = flow._least_doubling
    monkeypatch.setattr(flow, "_least_doubling", lambda drawn, live, *rest: moved.append(live.count()) or doubling(drawn, live, *rest))
    got = flow.upstream_sample(graph, 3, 6, ny=ny).toPandas().sort_values(["n", "place"])
    to = {r["n"]: r["nxt"] for r in graph.collect()}
    number = {r["n"]: r["u"] for r in spark.range(len(to)).select(F.col("id").alias("n"), uniform(F.col("id"), 6).alias("u")).collect()}
    above = {n: [] for n in to}
    for n in to:
        at = n
        while at >= 0:
            above[at].append(n)
            at = to[at]
    want = [(n, place, cell) for n in sorted(above) for place, cell in enumerate(sorted(above[n], key=lambda m: (number[m], m))[:3])]
    assert list(got.itertuples(index=False, name=None)) == want
    assert 0 < moved[0] < len(to) / 2  # only entries of tiles are doubled


def test_sums_in_intervals_are_those_of_their_pairs(spark):
    """Slices, crowded parts, equal rows, nulls, NaN and values of very different size; no pair is formed."""
    rng = np.random.default_rng(4)
    odd = {7: None, 11: float("nan"), 13: 1e18, 17: float("inf")}
    value = lambda n: odd.get(n % 400, float(rng.integers(0, 1000)) / 4)
    a = spark.createDataFrame([(int(rng.integers(0, 3)) if n % 50 else None, int(rng.integers(0, 900)) if n % 41 else None, value(n)) for n in range(2000)] + [(1, 500, 2.0)] * 300, "k int, t int, v double")
    spans = [(int(rng.integers(0, 4)) if n % 50 else None, int(s := rng.integers(0, 900)), int(s + (rng.integers(0, 40) if n % 3 else rng.integers(-5, 900))), n // 2) for n in range(600)]
    b = spark.createDataFrame(spans + [(1, 490, 520, 9999)] * 200, "k long, a int, b int, id long")
    kept = lambda df: {r["id"]: (r["hits"], r["total"]) for r in df.collect()}
    want = kept(ordered.within_intervals(a, b, "t", "a", "b", [("k", "k")]).groupBy(F.col("r_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"), F.sum("v").alias("total")))
    for each, room in ((1 << 20, 1 << 20), (150, 1 << 20), (150, 20)):
        got = kept(ordered.interval_sums(a, b, "t", "a", "b", "v", ["id"], [("k", "k")], each, room))
        assert got.keys() == want.keys()
        for n, (hits, total) in want.items():
            assert got[n][0] == hits and ((got[n][1] is None) if total is None else got[n][1] == pytest.approx(total, nan_ok=True, rel=1e-12))
    assert ordered.interval_sums(a, b.limit(0), "t", "a", "b", "v", ["id"]).count() == 0


def test_sums_over_more_pairs_than_could_be_formed(spark):
    """A thousand million pairs of one key."""
    a, b = (spark.range(50_000).select(F.col("id").alias(c), F.col("id").cast("double").alias("v")) for c in ("t", "a"))
    got = ordered.interval_sums(a, b.withColumn("b", F.lit(50_000)), "t", "a", "b", "v", ["a"]).agg(F.sum("hits").alias("hits"), F.max("total").alias("top")).first()
    assert (got["hits"], got["top"]) == (50_000 * 50_001 // 2, 50_000 * 49_999 / 2)
