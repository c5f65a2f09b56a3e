import numpy as np
import pytest

from tarn.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string, d int, component string"


def plain(rows):
    """(id, n, deviation, components with variance, whitened up to sign, explained), with numpy's solver and whole numbers."""
    ok = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in e]) for i, e in rows if e is not None and e and all(c is not None and np.isfinite(c) for c in e)]
    out = []
    for d in {len(x) for _, x in ok}:
        own = [(i, x) for i, x in ok if len(x) == d]
        fit = np.array(sorted({tuple(x) for _, x in own}), object)
        n, total = len(fit), fit.sum(axis=0)
        centred = (fit * n - total).astype(float) / n
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
        trace = float((centred**2).sum() / n)
        for i, x in own:
            c = np.array(x, object) * n - total
            out.append((i, d, n, int((c * c).sum()), (c.astype(float) / n) @ axes, values, values / trace if trace else values))
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(6)
    mix = r.normal(size=(24, 24))
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=24) @ mix / 10]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 230)] + [(7, rows[9][1])] * 3  # a third are copies; repeated ids
    rows += [(300, None), (301, [None] * 24), (302, [float("nan")] * 24), (303, [float("inf")] * 24), (None, rows[1][1]), (304, []), (305, [1.0, 2.0]), (306, [1.5, 2.0]), (307, [0.5, 0.25, 4.0])]
    return rows


@pytest.mark.parametrize("fan", [64, 2])
def test_equals_plain_numbers(spark, vectors, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    df = spark.createDataFrame([(i, e, 1, "x", 2, "c") for i, e in vectors], SCHEMA).repartition(7)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append(r)
    want = plain(vectors)
    assert sum(len(v) for v in got.values()) == sum(min(16, w[1]) for w in want)
    signs = {}
    for i, d, n, deviation, along, values, share in want:
        rows = got[i, n, deviation]
        for k in range(min(16, d)):
            mine = [r for r in rows if r["component"] == k + 1]
            assert mine
            for r in mine:
                assert r["explained"] == pytest.approx(share[k] if share[k] > 1e-12 else 0, rel=1e-9, abs=1e-12)
                assert r["identity_error"] < 1e-9
                if values[k] <= 1e-9:
                    assert r["whitened"] is None
                    continue
                value = along[k] / np.sqrt(values[k])
                if abs(value) > 1e-6:
                    sign = signs.setdefault((d, k), np.sign(value * r["whitened"]))
                    assert r["whitened"] == pytest.approx(sign * value, rel=1e-7, abs=1e-9)


def test_empty_and_single(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [0.5, 1.5], 1, "x", 2, "c")] * 3, SCHEMA)
    rows = whitening.whiten(one).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in rows] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)] * 3


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**49 * (i % 2)), 1.0], 1, "x", 2, "c") for i in range(2)]
    got = whitening.whiten(spark.createDataFrame([(i, [e[0] / 64, e[1]], *r) for i, e, *r in rows], "vec_id long, embedding array<double>, n long, x string, d int, component string"))
    assert {r["deviation"] for r in got.collect()} == {None}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    r = np.random.default_rng(n)
    for a in (r.normal(size=(n, n)), np.ones((n, n)), np.diag(np.arange(n) % 3.0), np.zeros((n, n))):
        a = (a + a.T) / 2
        values, axes = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max() * n))
        assert np.allclose(axes @ axes.T, np.eye(n), atol=1e-12)
        assert np.allclose(axes * values @ axes.T, a, atol=1e-11 * max(1, n))


def test_merged_moments_equal_those_of_all():
    r = np.random.default_rng(3)
    x = r.normal(1e6, 3, (90, 5))
    whole = whitening.Moments.none(5)
    for part in np.split(x, [0, 1, 40]):
        own = whitening.Moments.none(5)
        own.add(part)
        whole.merge(own)
    c = x - x.mean(axis=0)
    assert whole.n == 90 and np.allclose(whole.mean, x.mean(axis=0), rtol=1e-14) and np.allclose(whole.square, c.T @ c, rtol=1e-8)


def test_query_on_the_table(spark, data):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = {w[0]: w for w in plain(rows)}
    got = whitening.op12_welford_whitening(spark, data).collect()
    assert len(got) == 16 * len(want)
    for r in got:
        _, _, n, deviation, along, values, share = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-8
        assert abs(r["whitened"]) == pytest.approx(abs(along[k] / np.sqrt(values[k])), rel=1e-6, abs=1e-9)
        assert r["explained"] == pytest.approx(share[k], rel=1e-9)
