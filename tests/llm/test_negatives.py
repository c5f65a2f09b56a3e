import numpy as np
import pytest

from tarn.llm import negatives
from tarn.llm.common import attach
from tarn.plans import state

SCHEMA = "vec_id long, embedding array<float>, label int, score double, uid int, x string, found int"


def brute(rows, every=100):
    ok = [(i, (n + 1) % 10 if i % 7 == 0 else n, np.floor(256 * np.array(e, float)).astype(int)) for i, e, n in rows if i is not None and n is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    out = []
    for at, (i, label, x) in enumerate(ok):
        if i % every:
            continue
        scored = [(-int(x @ y), j, other) for k, (j, other, y) in enumerate(ok) if k != at and len(y) == len(x)]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            hard = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k, _) in enumerate(hard)]
    return sorted(out)


def rows_of(seed, n, d):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in r.normal(size=d)], int(r.integers(0, 4))) for i in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rows = rows_of(4, 700, 5)
    rows += [(i, rows[100][1], rows[100][2]) for i in range(700, 1000)]  # a third are copies, anchors among them
    rows += [(i, rows[100][1], 3 - rows[100][2]) for i in range(1000, 1020)]
    rows += [(200, rows[9][1], 2), (200, rows[200][1], rows[200][2]), (200, rows[200][1], rows[200][2])]  # repeated ids
    rows += [(2000, [0.0] * 5, 1), (2001, [0.0] * 5, 2), (2100, None, 1), (2200, [None] * 5, 1), (2300, [float("nan")] * 5, 1), (2400, [float("-inf")] * 5, 1), (None, rows[0][1], 1), (2500, rows[3][1], None)]
    return rows + [(2600, [1.0, 2.0], 1), (2601, [1.0, 1.9], 1), (2602, [1.0, 1.8], 2), (2603, [1.0, 0.0], 2), (2700, [], 1), (2701, [], 1), (2702, [], 2)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, n, 1.0, 2, "x", 3) for i, e, n in rows], SCHEMA).repartition(3)


def listed(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 90, "CHUNK": 4, "TOGETHER": 2, "LEAF": 7}])
def test_equals_brute_force(spark, vectors, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(negatives, k, v)
    if sizes:
        monkeypatch.setattr(state, "HOT_ROWS", 20)
        monkeypatch.setattr(state, "HOT_SHARE", 0.1)
    got = listed(negatives.mine(frame(spark, vectors)))
    assert got == brute(vectors)
    assert len(got) > 100


def test_empty(spark):
    assert negatives.mine(frame(spark, rows_of(1, 1, 2)).limit(0)).count() == 0


def test_few_rows(spark):
    rows = [(100, [1.0, 1.0], 1), (3, [0.9, 1.0], 1), (4, [0.9, 0.95], 2)]
    assert listed(negatives.mine(frame(spark, rows))) == brute(rows) != []


def test_trees_prune_groups_and_keep_results():
    r = np.random.default_rng(1)
    centres = r.normal(0, 60, (20, 8))
    v = np.concatenate([r.normal(c, 1.0, (300, 8)) for c in centres]).astype(int).astype(float)
    label = r.integers(0, 3, len(v))
    anchors, other = negatives.BallTree(v[::40], label[::40], 8), negatives.BallTree(v, label, 32)
    n = len(v[::40])
    found = negatives.Search(anchors, np.full((n, 1), -np.inf), np.full((n, 1), np.inf), True, 4)
    found.meet(other, [[int(i)] for i in other.row])
    dots = v[::40] @ v.T
    for a, row in enumerate(anchors.row):
        want = sorted((-dots[row, j], j) for j in np.flatnonzero(label == label[::40][row]))[:4]
        assert [(-s, i) for s, i in zip(found.score[a, 0].tolist(), found.id[a, 0].tolist(), strict=True)] == want
    assert found.computed < 0.35 * dots.size
    least, most = negatives.intervals(anchors.centre, anchors.radius, other.centre, other.radius)
    for i in range(0, len(anchors.start), 5):
        for j in range(0, len(other.start), 7):
            own = anchors.v[anchors.start[i] : anchors.end[i]] @ other.v[other.start[j] : other.end[j]].T
            assert least[i, j] <= own.min() and own.max() <= most[i, j]


def test_cells_are_of_similar_size():
    r = np.random.default_rng(2)
    v = r.normal(size=(4000, 6))
    cells = negatives.Cells(v[:400], 16)
    sizes = np.bincount(cells.of(v), minlength=16)
    assert len(sizes) == len(cells.centre) == 16 and sizes.min() > 100 and sizes.max() < 600
    assert len(negatives.Cells(np.zeros((50, 3)), 8).centre) == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_joins_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(state, "HOT_ROWS", 10)
    monkeypatch.setattr(state, "HOT_SHARE", 0.2)
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 1), (3, 2), (None, 3)] + [(4, k) for k in range(30)], "k long, v long")
    values = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, w string")
    got = sorted(map(tuple, attach(rows, values, ["k"], how).select("k", "v", "w").collect()), key=str)
    assert got == sorted(map(tuple, rows.join(values, "k", how).select("k", "v", "w").collect()), key=str)
