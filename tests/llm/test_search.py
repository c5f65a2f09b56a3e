import numpy as np
import pytest

from tarn.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, score double, v int"


def brute(rows, k, every):
    """Sorted answers of each row that asks; a row's own place is no candidate."""
    ok = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for at, (q, x) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for other, (i, y) in enumerate(ok) if other != at and len(y) == len(x))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 200)]  # a third are copies
    rows += [(200, [0.0] * 6), (220, None), (240, [None] * 6), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (None, rows[0][1]), (300, [1.0, 2.0]), (301, [1.0, 1.0]), (320, [])]
    return rows


@pytest.mark.parametrize("k", [1, 5, 20, 1000])
def test_equals_brute_force(spark, vectors, monkeypatch, k):
    monkeypatch.setattr(mtree, "BLOCK", 40)
    monkeypatch.setattr(mtree, "CHUNK", 5)
    df = spark.createDataFrame([(i, e, 1.0, 2) for i, e in vectors], SCHEMA)
    got = sorted(tuple(r) for r in mtree.top_k(df, k, 20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(vectors, k, 20)


def test_repeated_ids_are_separate_rows(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(60)]
    rows += [(100, rows[7][1])] * 5 + [(100, [float(np.float32(x)) for x in r.normal(size=4)]) for _ in range(3)] + [rows[20]] * 30
    df = spark.createDataFrame([(i, e, 1.0, 2) for i, e in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in mtree.top_k(df, 20, 20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 20, 20)
    assert len(got) == 20 * sum(i % 20 == 0 for i, _ in rows)


def test_empty(spark):
    assert mtree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_skips_computations_on_clusters():
    r = np.random.default_rng(1)
    v = np.unique(np.concatenate([r.normal(c, 1.0, (400, 8)) for c in r.normal(0, 60, (20, 8))]).astype(np.int64), axis=0)
    tree, q = mtree.MTree(v), v[::500]
    score, row = tree.search(q, 7)
    for x, ss, rr in zip(q, score, row, strict=True):
        want = sorted(((int(x @ y), -i) for i, y in enumerate(v)), reverse=True)[:7]
        assert [(int(s), -int(i)) for s, i in zip(ss, rr, strict=True)] == want
    assert tree.computed < 0.4 * len(v) * len(q)


def test_bound_from_elsewhere_saves_work():
    r = np.random.default_rng(2)
    v = np.unique(r.normal(0, 40, (3000, 6)).astype(np.int64), axis=0)
    tree, q = mtree.MTree(v, page=16), v[:20]
    score, _ = tree.search(q, 5)
    whole, tree.computed = tree.computed, 0
    reach = np.sqrt(np.einsum("ij,ij->i", q, q) + tree.top - 2 * score[:, -1]) + 1e-3
    again, _ = tree.search(q, 5, reach)
    assert (again == score).all() and tree.computed < whole
