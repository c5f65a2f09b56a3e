"""A quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import documents, id_remainder, ship

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "ends", "commas", "distinct", "echoes", "top_word",
    "same_lines", "line_words", "ended_lines", "beyond_ascii", "short_words", "marked_words", "deviation",
)
_MARKS = frozenset(b"!#$%&*+/<=>@\\^_`{|}~")


def features(text: bytes) -> list[float]:
    """The numbers that the model sees of a whole text; all zero for a text without words."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    size = len(text)
    seen = Counter(w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    spread = Counter(map(len, w))
    mean = sum(k * v for k, v in spread.items()) / n
    return [
        float(np.log1p(n)), mean, upper / max(1, upper + lower), int(c[48:58].sum()) / size,
        int(c[[35, 42, 36, 37, 38, 60, 62]].sum()) / n, int(c[33]) / n, int(c[124]) / n, int(c[[46, 63]].sum()) / n, int(c[44]) / n,
        len(seen) / n, sum(map(bytes.__eq__, w, w[1:])) / n, max(seen.values()) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        int(c[128:].sum()) / size, sum(v for k, v in spread.items() if k <= 3) / n, sum(v for x, v in seen.items() if x[-1] in _MARKS) / n,
        (sum(v * (k - mean) ** 2 for k, v in spread.items()) / n) ** 0.5,
    ]


@dataclass
class Gam:
    """Edges of the bins and the lookup tables of single features and of pairs; scores are sums of table entries."""

    edges: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.single):
            total += table[b[:, f]]
        for f, g, table in self.pairs:
            total += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-total))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins: split the best interval until there are so many leaves; Newton values."""
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best, cut = 1e-9, None
        for i, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                if gain.max() > best:
                    best, cut = gain.max(), (i, int(m[gain.argmax()]))
        if cut is None:
            break
        i, m = cut
        parts[i : i + 1] = [(parts[i][0], m), (m, parts[i][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best one cut in each direction of a grid: its gain and the four values over the grid."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gain, parts = 0.0, []
    for s in (gs, hs):
        a = s[:-1, :-1]
        parts.append((a, s[:-1, -1:] - a, s[-1:, :-1] - a, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + a))
    gain = sum(x**2 / (y + ridge) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty(g.shape)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in zip(*parts, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 80, pairs: int = 8, bins: int = 32, rate: float = 0.1, leaves: int = 4) -> Gam:
    """Boost one small tree a feature in turn, then, on what is left, one a pair for the pairs that promise most."""
    if not len(x):
        return Gam([np.zeros(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-margin))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f, table in enumerate(model.single):
            g, h = slopes()
            step = rate * _steps(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), leaves)
            table += step
            margin += step[b[:, f]]

    def grid(f: int, k: int, w: np.ndarray) -> np.ndarray:
        shape = (len(model.single[f]), len(model.single[k]))
        return np.bincount(b[:, f] * shape[1] + b[:, k], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_quadrants(grid(f, k, g), grid(f, k, h))[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k, np.zeros((len(model.single[f]), len(model.single[k])))) for _, f, k in gains[:pairs]]
    for _ in range(pair_rounds):
        for f, k, table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(f, k, g), grid(f, k, h))[1]
            table += step
            margin += step[b[:, f], b[:, k]]
    return model


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit to at most `bound` labelled documents, those of smallest hash of the id, none with remainder 0 of five.

    The bound holds for labelled rows only; it limits what the driver collects to `bound` rows of numbers, also where one
    id has many documents: of those of the last id that fits, the ones of smallest features are taken.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(id_remainder(F.col(id_col), 5) != 0)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("double").alias("label"))
    chosen = {r["doc_id"]: r["label"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()}
    if not chosen:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    spark = docs.sparkSession
    ids = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(chosen), pa.int64())}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    found = _featured(docs, id_col, text_col).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<double>")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(bound).toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(found["x"].to_list()).astype(float)
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))
    return fit(x[order], found["doc_id"].map(chosen).to_numpy()[order])


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, in one pass without a shuffle.

    Null and empty texts have all features zero and are scored like any other; a very long text is held whole. A value
    on the edge of two bins is in the upper one. Repeated rows get equal scores; null
    ids pass through; an empty table gives an empty result. Other columns are ignored. A model without training rows
    gives 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return _featured(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out_auc(scored: pd.DataFrame) -> float:
    """The chance that a row of label 1 scores above one of label 0; ties count half."""
    r = scored["score"].rank().to_numpy()
    one = scored["label"].to_numpy() == 1
    return float((r[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum()))


def op3_additive_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.when(F.col("doc_id").isNotNull(), id_remainder(F.col("doc_id"), 5) == 0).otherwise(F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
