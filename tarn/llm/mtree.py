"""Exact top-k search by inner product over M-trees, searched best first."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.common import packed, settled, ship

#: Entries of a page; vectors of a tree; queries of a chunk; chunks that meet a tree in one task; routing objects above trees.
PAGE, BLOCK, CHUNK, TOGETHER, ROUTES = 64, 8192, 4096, 8, 1024


@dataclass
class Page:
    """A node: its entries' objects, their distances to the routing object above, covering radii and pages below."""

    rows: np.ndarray
    to_parent: np.ndarray | None
    radius: np.ndarray | None = None
    below: list[Page] | None = None


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, top - np.einsum("ij,ij->i", v, v)))


def distances(v: np.ndarray, lift: np.ndarray, w: np.ndarray, to: np.ndarray, top: float) -> np.ndarray:
    """Between lifted vectors, all of squared length `top`."""
    return np.sqrt(np.maximum(0, 2 * top - 2 * (v @ w.T + lift[:, None] * to[None, :])))


class MTree:
    """An M-tree over integer vectors, for inner products.

    Every vector gets one more component that brings all of them to one length; with a zero there in the query, the
    squared Euclidean distance is |q|^2 + top - 2 * score, so near means a high score. Pages hold up to PAGE entries.
    An inner entry has a routing object, a covering radius and the distance to the routing object of its page; a leaf
    entry has the latter. Pages are loaded in bulk: seeds are drawn, and each vector goes to its nearest seed.
    """

    def __init__(self, vectors: np.ndarray, top: float | None = None, page: int = PAGE, seed: int = 1):
        self.v = vectors.astype(np.float64)
        self.top = float(np.einsum("ij,ij->i", self.v, self.v).max(initial=0)) if top is None else top
        self.lift = _lift(self.v, self.top)
        self.page, self.computed = page, 0
        self.root = self._build(np.arange(len(self.v)), None, np.random.default_rng(seed))

    def _far(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return distances(self.v[rows], self.lift[rows], self.v[to], self.lift[to], self.top)

    def _build(self, rows: np.ndarray, parent: int | None, rng: np.random.Generator) -> Page:
        up = None if parent is None else self._far(rows, np.array([parent]))[:, 0]
        if len(rows) <= self.page:
            return Page(rows, up)
        seeds = np.sort(rng.choice(rows, min(self.page, max(2, 2 * len(rows) // self.page)), replace=False))
        far = self._far(rows, seeds)
        nearest = far.argmin(axis=1)
        at = np.searchsorted(rows, seeds)
        nearest[at] = np.arange(len(seeds))  # equal vectors: each seed keeps itself
        parts = [np.flatnonzero(nearest == k) for k in range(len(seeds))]
        radius = np.array([far[p, k].max() for k, p in enumerate(parts)])
        return Page(seeds, None if up is None else up[at], radius, [self._build(rows[p], int(s), rng) for p, s in zip(parts, seeds, strict=True)])

    def search(self, queries: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of each query's k best, best first, ties to the smaller row; row -1 where there are fewer.

        reach: a distance beyond which no row is wanted. The page that promises most to any query is read next, for
        all queries that still need it; `computed` counts the distances that were computed.
        """
        q = queries.astype(np.float64)
        base = np.einsum("ij,ij->i", q, q) + self.top
        reach = np.full(len(q), np.inf) if reach is None else reach.astype(float)
        score, row = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        queue: list[tuple] = [(0.0, 0, self.root, np.zeros(len(q)), None)] if len(self.v) and len(q) else []
        pushed = 0
        while queue:
            least, _, page, low, up = heapq.heappop(queue)
            if least > reach.max():
                break
            who, rows, radius = np.flatnonzero(low <= reach), page.rows, page.radius
            below = np.arange(len(rows))
            if up is not None and len(who):  # the stored distances bound the new ones before any is computed
                may = np.abs(page.to_parent[None, :] - up[who, None]) - (0 if radius is None else radius[None, :]) <= reach[who, None]
                below, who = np.flatnonzero(may.any(axis=0)), who[may.any(axis=1)]
            if not len(who) or not len(below):
                continue
            rows = rows[below]
            self.computed += len(rows) * len(who)
            dots = q[who] @ self.v[rows].T
            if page.below is not None:
                d = np.sqrt(np.maximum(0, base[who, None] - 2 * dots))
                bound = np.maximum(0, d - radius[None, below])
                for i, j in enumerate(below.tolist()):
                    if (need := bound[:, i] <= reach[who]).any():
                        to, parent = np.full(len(q), np.inf), np.zeros(len(q))
                        to[who[need]], parent[who] = bound[need, i], d[:, i]
                        pushed += 1
                        heapq.heappush(queue, (float(bound[need, i].min()), pushed, page.below[j], to, parent))
                continue
            good = dots >= score[who, -1:]  # an equal score may have a smaller row
            some = np.flatnonzero(good.any(axis=1))
            who, dots, good = who[some], dots[some], good[some]
            s = np.concatenate((score[who], np.where(good, dots, -np.inf)), axis=1)
            r = np.concatenate((row[who], np.where(good, rows[None, :], -1)), axis=1)
            best = np.lexsort((np.where(r < 0, len(self.v), r), -s), axis=1)[:, :k]
            score[who], row[who] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
            worst = score[who, -1]
            full = np.isfinite(worst)
            # Equal scores stay within reach.
            reach[who[full]] = np.minimum(reach[who[full]], np.sqrt(np.maximum(0, base[who[full]] - 2 * worst[full])) * (1 + 1e-9) + 1e-6)
        return score, row


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each row whose id is divisible by `every`.

    Components become floor(scale * x). Equal vectors are one object with its k + 1 smallest ids, which is all that
    any answer can name; so a vector that a third of the rows share costs no more than another. At most ROUTES sampled
    objects are the routing objects of one tree's top; each object goes to the nearest, and what a routing object
    has is cut into trees of about BLOCK objects. Trees are built once and settled with their covering radii. A query
    first meets a tree of its nearest routing object, and the distance of its k-th answer then bounds the
    search: it meets only trees of routing objects whose farthest object the bound can't exclude. Queries travel packed,
    chunks of about CHUNK of neighbouring routing objects, a value for each chunk, home and tree.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A query's own row is no candidate.

    Rows with a null id, a null vector, or a null, NaN or infinite component take no part; vectors are only compared
    with vectors of their length. Repeated ids are separate rows: each asks, and each is a candidate of the others.
    With fewer than k candidates all are returned; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    parts = F.col(vector_col).cast("array<double>")
    fit = F.forall(parts, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    base = settled(vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(parts, lambda x: F.floor(x * scale)).alias("v")))
    asks = F.col("id") % every == 0
    objects = base.groupBy("v").agg(F.max(asks).alias("asks"))
    few = base.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    objects = objects.join(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    objects = settled(objects.select(F.monotonically_increasing_id().alias("uid"), "v", "ids", "asks", F.size("v").alias("dim"), square.alias("square")))
    dims = {d: (n, top) for d, n, top in objects.groupBy("dim").agg(F.count(F.lit(1)), F.max("square")).collect()}  # a row for each length of vectors
    n = sum(x for x, _ in dims.values())
    wanted = min(ROUTES, -(-n // BLOCK))
    drawn = objects.orderBy(F.xxhash64("uid"), "uid").limit(wanted).select("dim", "v").collect() if n else []
    routes: dict[int, np.ndarray] = {}
    for d in {r["dim"] for r in drawn}:
        routes[d] = np.array([r["v"] for r in drawn if r["dim"] == d], np.float64).reshape(-1, d)
    first = {d: i for i, d in enumerate(sorted(dims))}  # dimension -> number
    shared = spark.sparkContext.broadcast((dims, routes, first))

    def route(batches):
        dims, routes, first = shared.value
        for batch in batches:
            home = np.zeros(batch.num_rows, np.int64)
            dim = batch.column("dim").to_numpy()
            table = pa.Table.from_batches([batch])
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                home[own] = first[d] * (ROUTES + 1)
                if d in routes and d:
                    v = _matrix(table.take(own)).astype(np.float64)
                    top, w = dims[d][1], routes[d]
                    home[own] += distances(v, _lift(v, top), w, _lift(w, top), top).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "home"])

    placed = settled(objects.select("uid", "v", "ids", "asks", "dim").mapInArrow(route, "uid long, v array<long>, ids array<long>, asks boolean, dim int, home long"))
    counts = {r["home"]: (r["n"], r["m"]) for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("m")).collect()}
    # Trees of each routing object, and chunks of neighbouring routing objects' queries; one entry for each tree.
    trees, chunk_of, tree, chunk, room = {}, {}, 0, -1, 0
    for home in sorted(counts):
        many, asking = counts[home]
        trees[home] = (tree, max(1, -(-many // BLOCK)))
        tree += trees[home][1]
        if asking > room:
            chunk, room = chunk + 1, CHUNK
        pieces = max(1, -(-asking // CHUNK))
        chunk_of[home] = (max(chunk, 0), pieces)
        chunk, room = chunk + pieces - 1, room - asking if pieces == 1 else 0
    plan = spark.sparkContext.broadcast((trees, chunk_of))

    def deal(batches):
        trees, chunk_of = plan.value
        for batch in batches:
            home, uid = batch.column("home").to_pylist(), batch.column("uid").to_numpy()
            mixed = ((uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            t, c = np.array([trees[h] for h in home]).reshape(-1, 2), np.array([chunk_of[h] for h in home]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t[:, 0] + mixed % t[:, 1]), pa.array(c[:, 0] + mixed % c[:, 1])], names=[*batch.schema.names, "tree", "chunk"])

    dealt = placed.mapInArrow(deal, "uid long, v array<long>, ids array<long>, asks boolean, dim int, home long, tree long, chunk long")

    def build(table: pa.Table) -> pa.Table:
        dims, routes, first = shared.value
        ids, v = table.column("ids").to_pylist(), _matrix(table)
        order = sorted(range(len(ids)), key=lambda i: ids[i])  # rows by id, so that ties go to the smaller
        d, home = v.shape[1], table.column("home")[0].as_py()
        made = MTree(v[order], dims[d][1])
        at = home - first[d] * (ROUTES + 1)
        near = routes[d][at : at + 1] if d in routes and d else np.zeros((1, d))
        radius = distances(made.v, made.lift, near, _lift(near, made.top), made.top).max()
        packed = pickle.dumps((made, [ids[i] for i in order]))
        return pa.table({"tree": table.column("tree").slice(0, 1), "home": pa.array([home]), "dim": pa.array([d], pa.int32()), "radius": pa.array([radius]), "packed": pa.array([packed], pa.binary())})

    pages = settled(dealt.groupBy("tree").applyInArrow(build, "tree long, home long, dim int, radius double, packed binary"))
    queries = settled(dealt.where("asks").select("uid", "v", "dim", "home", "chunk", "tree"))

    def bundled(uid: np.ndarray, v: np.ndarray, own: np.ndarray, reach: np.ndarray) -> bytes:
        """Queries as one value; vectors as the narrowest whole numbers that hold them."""
        most = np.abs(v).max(initial=0)
        kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        return pickle.dumps((uid, v.astype(kind), own, reach))

    def bundle(table: pa.Table) -> pa.Table:
        """One row for each chunk and home: its queries, packed."""
        v = _matrix(table)
        columns = [table.column(c).to_numpy() for c in ("uid", "tree", "reach")]
        data = bundled(columns[0], v, columns[1], columns[2])
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "home": table.column("home").slice(0, 1), "dim": table.column("dim").slice(0, 1), "data": pa.array([data], pa.binary())})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, u, s, far = [], [], [], []
        if left.num_rows and right.num_rows:
            made, ids = pickle.loads(left.column("packed")[0].as_py())
            for data in right.column("data"):
                uids, v, _, reach = pickle.loads(data.as_py())
                v = v.astype(np.int64)
                score, row = made.search(v, k + 1, reach)
                square = np.einsum("ij,ij->i", v, v).astype(float) + made.top
                for uid, sq, ss, rr in zip(uids.tolist(), square.tolist(), score.tolist(), row.tolist(), strict=True):
                    found = sorted((-x, i) for x, r in zip(ss, rr, strict=True) if r >= 0 for i in ids[r])[: k + 1]
                    near = float(np.sqrt(max(0.0, sq + 2 * found[-1][0])) * (1 + 1e-9) + 1e-6) if len(found) > k else float("inf")
                    q += [uid] * len(found)
                    u += [i for _, i in found]
                    s += [int(-x) for x, _ in found]
                    far += [near] * len(found)
        return pa.table({"quid": pa.array(q, pa.int64()), "vec_id": pa.array(u, pa.int64()), "score": pa.array(s, pa.int64()), "reach": pa.array(far, pa.float64())})

    radii = {r["home"]: r["radius"] for r in pages.groupBy("home").agg(F.max("radius").alias("radius")).collect()}  # one for each routing object
    above = spark.sparkContext.broadcast(radii)

    def spread(first_tree: bool):
        """The bundles that each tree gets: its own queries at first, then those that can't exclude what its routing object has."""

        def run(batches):
            dims, routes, first = shared.value
            trees, _ = plan.value
            for batch in batches:
                for chunk, d, data in zip(batch.column("chunk").to_pylist(), batch.column("dim").to_pylist(), batch.column("data"), strict=True):
                    uid, v, own, reach = pickle.loads(data.as_py())
                    out = [(t, own == t) for t in np.unique(own).tolist()] if first_tree else []
                    if not first_tree:
                        homes = [h for h in sorted(above.value) if h // (ROUTES + 1) == first[d]]
                        low = np.zeros((len(v), len(homes)))
                        if d in routes and d:
                            x = v.astype(float)
                            away = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x, x)[:, None] + dims[d][1] - 2 * (x @ routes[d].T)))
                            low = away[:, np.array(homes) - first[d] * (ROUTES + 1)] - np.array([above.value[h] for h in homes])[None, :]
                        for j, h in enumerate(homes):
                            may = low[:, j] <= reach
                            out += [(t, may & (own != t)) for t in range(trees[h][0], trees[h][0] + trees[h][1])] if may.any() else []
                    for t, pick in out:
                        if pick.any():
                            part = bundled(uid[pick], v[pick], own[pick], reach[pick])
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([chunk // TOGETHER], pa.int64()), pa.array([part], pa.binary())], names=["tree", "part", "data"])

        return run

    def met(asked: DataFrame, first_tree: bool) -> DataFrame:
        """What queries (uid, v, dim, home, tree, chunk, reach) find in trees: a row for each chunk and tree is shuffled, not for each query."""
        bundles = asked.groupBy("chunk", "home").applyInArrow(bundle, "chunk long, home long, dim int, data binary")
        sent = settled(bundles.mapInArrow(spread(first_tree), "tree long, part long, data binary"))
        wanted = pages.join(sent.select("tree", "part").distinct(), "tree").select(F.col("tree").alias("of"), F.col("part").alias("for"), "packed")
        return wanted.groupBy("of", "for").cogroup(sent.groupBy("tree", "part")).applyInArrow(search, "quid long, vec_id long, score long, reach double")

    near = settled(met(queries.withColumn("reach", F.lit(float("inf"))), True))
    bound = near.groupBy("quid").agg(F.min("reach").alias("reach"))
    asked = queries.join(bound, queries["uid"] == bound["quid"]).drop("quid")
    hits = near.unionAll(met(asked, False)).select("quid", "vec_id", "score")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    named = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    answers = named.groupBy("quid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    asking = base.where(asks).join(queries.select("v", F.col("uid").alias("quid")), "v").select("id", "v", "quid")
    # One answer with the query's own id and score goes: its own row, or one that can't be told from it.
    own_score = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    rows = asking.withColumn("own_score", own_score).join(answers, "quid")
    own_n = F.array_min(F.transform(F.filter("found", lambda x: (x["vec_id"] == F.col("id")) & (x["score"] == F.col("own_score"))), lambda x: x["n"]))
    others = F.slice(F.filter("found", lambda x: own_n.isNull() | (x["n"] != own_n)), 1, k)
    return rows.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op1_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return packed(top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
