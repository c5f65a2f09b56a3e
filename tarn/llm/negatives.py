"""Hard-negative mining: dual-tree search by inner product, trees over anchors and trees over candidates."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.common import attach, packed, settled, ship

#: Vectors of a tree, from the least to the most as the table grows; anchors of a tree; chunks of anchors that meet a tree in one task; cells above the trees, vectors
#: drawn for each cell's cuts; vectors of a leaf.
BLOCK, CHUNK, TOGETHER, CELLS, DRAWN, LEAF = 8192, 4096, 8, 4096, 16, 64
WIDEST = 8 * BLOCK
#: No upper end of a window.
OPEN = 1 << 52


def _cut(v: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
    """The direction from one far row to a row far from that one, None if all rows are equal."""
    x = v[rows]
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    return None if (a == b).all() else b - a


class Cells:
    """Cuts that deal vectors of one length to cells of near ones, made from a bounded sample; about as many rows each."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.way, self.at, self.below, self.centre = [], [], [], []
        self.root = self._split(sample, np.arange(len(sample)), wanted)
        d = sample.shape[1]
        self.way, self.at, self.below = np.array(self.way, float).reshape(len(self.way), d), np.array(self.at), np.array(self.below, np.int64).reshape(-1, 2)
        self.centre = np.array(self.centre, float).reshape(len(self.centre), d)

    def _split(self, v: np.ndarray, rows: np.ndarray, wanted: int) -> int:
        """A cut's number, or -1 - c for cell c."""
        way = _cut(v, rows) if wanted > 1 and len(rows) > 1 else None
        if way is None:
            self.centre.append(v[rows].mean(axis=0) if len(rows) else np.zeros(v.shape[1]))
            return -len(self.centre)
        far, few = v[rows] @ way, wanted // 2
        at = np.partition(far, len(far) * few // wanted)[len(far) * few // wanted]
        left = far < at
        if not left.any():
            left = far <= at
        me = len(self.at)
        self.way.append(way)
        self.at.append(at if (far[left] < at).all() else np.nextafter(at, np.inf))
        self.below.append([0, 0])
        self.below[me] = [self._split(v, rows[left], few), self._split(v, rows[~left], wanted - few)]
        return me

    def of(self, v: np.ndarray) -> np.ndarray:
        here = np.full(len(v), self.root)
        while len(live := np.flatnonzero(here >= 0)):
            cut = here[live]
            right = np.einsum("ij,ij->i", v[live], self.way[cut]) >= self.at[cut]
            here[live] = self.below[cut, right.astype(int)]
        return -1 - here


class BallTree:
    """Nodes with a centre and a covering radius over vectors with labels; rows of one label come together first."""

    def __init__(self, v: np.ndarray, label: np.ndarray, leaf: int = LEAF):
        self.row = np.lexsort((np.arange(len(v)), label))
        v, label = v[self.row].astype(float), label[self.row]
        nodes, todo = [], [(0, len(v), -1)] if len(v) else []
        while todo:
            a, b, up = todo.pop()
            me, pure = len(nodes), label[a] == label[b - 1]
            if up >= 0:
                nodes[up][2 if nodes[up][2] < 0 else 3] = me
            nodes.append([a, b, -1, -1])
            if b - a <= (leaf if pure else leaf // 8):  # labels part early, as they alone may exclude a pair
                continue
            if not pure:  # at the change of label nearest to the middle
                changes = np.flatnonzero(label[a + 1 : b] != label[a : b - 1]) + a + 1
                middle = changes[np.argmin(np.abs(changes - (a + b) // 2))]
            elif (way := _cut(v, np.arange(a, b))) is not None:
                order = a + np.argsort(v[a:b] @ way, kind="stable")
                v[a:b], self.row[a:b], middle = v[order], self.row[order], (a + b) // 2
            else:
                middle = (a + b) // 2
            todo += [(middle, b, me), (a, middle, me)]
        self.v, self.label = v, label
        self.start, self.end, self.left, self.right = np.array(nodes, np.int64).reshape(-1, 4).T
        ranges = list(zip(self.start.tolist(), self.end.tolist(), strict=True))
        self.centre = np.array([v[a:b].mean(axis=0) for a, b in ranges]).reshape(len(ranges), v.shape[1])
        self.radius = np.array([np.sqrt(((v[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(ranges, self.centre, strict=True)])
        self.pure = np.array([label[a] == label[b - 1] for a, b in ranges], bool)

    def __getstate__(self) -> dict:
        """Vectors travel as the narrowest whole numbers that hold them."""
        most = np.abs(self.v).max(initial=0)
        kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else float
        return self.__dict__ | {"v": self.v.astype(kind)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"v": state["v"].astype(float)}


def intervals(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that a vector of ball a can have with one of ball b, for all pairs."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    dots = a @ b.T
    room = na[:, None] * rb[None, :] + ra[:, None] * nb[None, :] + ra[:, None] * rb[None, :]
    room += 1e-9 * (na[:, None] * nb[None, :] + room) + 1e-6
    return dots - room, dots + room


class Search:
    """The k best candidates of every anchor in each of its windows, over one tree of candidates after the other.

    low, high: the windows' ends, a row for each anchor in the tree's order; low rises to the k-th best found. Pairs of
    nodes are met by the greatest inner product they may have; a pair goes if that is below what all anchors of the
    node still want, or if the least is above all of their windows, or if its labels can't fit. Pairs of leaves are
    scored exactly. `computed` counts scores.
    """

    def __init__(self, anchors: BallTree, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.tree, self.low, self.high, self.same, self.k = anchors, low.astype(float).copy(), high.astype(float), same, k
        self.score, self.id = np.full((*low.shape, k), -np.inf), np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.computed = 0
        ranges = list(zip(anchors.start.tolist(), anchors.end.tolist(), strict=True))
        self.least = np.array([self.low[a:b].min(initial=np.inf) for a, b in ranges])
        self.most = np.array([self.high[a:b].max(initial=-np.inf) for a, b in ranges])

    def meet(self, other: BallTree, ids: list[list[int]]) -> None:
        """ids: of each row of the candidates' tree, in its order, smallest first."""
        mine = self.tree
        if not len(mine.row) or not len(other.row) or not self.low.shape[1]:
            return
        count = np.array([len(x) for x in ids])
        flat, first = np.array([i for x in ids for i in x], np.int64), np.cumsum(count) - count
        below, above = intervals(mine.centre, mine.radius, other.centre, other.radius)
        queue = [(-above[0, 0], 0, 0)]
        while queue:
            best, i, j = heapq.heappop(queue)
            if mine.left[i] >= 0:
                self.least[i] = min(self.least[mine.left[i]], self.least[mine.right[i]])
            if -best < self.least[i] or below[i, j] > self.most[i]:
                continue
            both = mine.pure[i] and other.pure[j]
            if both and (mine.label[mine.start[i]] == other.label[other.start[j]]) != self.same:
                continue
            inner, outer = mine.left[i] >= 0, other.left[j] >= 0
            if not inner and not outer:
                self._score(i, other, j, not both, flat, first, count)
            elif outer and (not inner or other.radius[j] >= mine.radius[i]):
                for c in (other.left[j], other.right[j]):
                    heapq.heappush(queue, (-above[i, c], i, c))
            else:
                for c in (mine.left[i], mine.right[i]):
                    heapq.heappush(queue, (-above[c, j], c, j))

    def _score(self, i: int, other: BallTree, j: int, mixed: bool, flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        a, b, c, d = self.tree.start[i], self.tree.end[i], other.start[j], other.end[j]
        dots = self.tree.v[a:b] @ other.v[c:d].T
        self.computed += dots.size
        if mixed:
            fits = (self.tree.label[a:b, None] == other.label[None, c:d]) == self.same
            dots = np.where(fits, dots, np.nan)
        for w in range(self.low.shape[1]):
            row, col = np.nonzero((dots >= self.low[a:b, w, None]) & (dots <= self.high[a:b, w, None]))
            if not len(row):
                continue
            times = count[c + col]
            at = np.repeat(first[c + col] - np.cumsum(times) + times, times) + np.arange(times.sum())
            touched = np.unique(row)
            rows = np.concatenate((np.repeat(row, times), np.repeat(touched, self.k)))
            scores = np.concatenate((np.repeat(dots[row, col], times), self.score[a + touched, w].ravel()))
            who = np.concatenate((flat[at], self.id[a + touched, w].ravel()))
            order = np.lexsort((who, -scores, rows))
            place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
            keep = order[place < self.k]
            self.score[a + touched, w], self.id[a + touched, w] = scores[keep].reshape(-1, self.k), who[keep].reshape(-1, self.k)
            self.low[a + touched, w] = np.maximum(self.low[a + touched, w], self.score[a + touched, w, -1])
        self.least[i] = self.low[a:b].min(initial=np.inf)


def _matrix(table: pa.Table | pa.RecordBatch, d: int) -> np.ndarray:
    column = table.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d).astype(np.float64)


def mine(
    vectors: DataFrame, anchors_every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, changed: tuple[int, int] = (7, 10),
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor's positives.

    Components become floor(scale * x); scores are inner products. Where the id is divisible by changed[0] the label
    becomes (label + 1) % changed[1]. Anchors are the rows whose id is divisible by anchors_every; an anchor's positives
    are its best other rows of the same label, and of each positive the hard negatives are the best rows of other
    labels that score from share[0] / share[1] of the positive's score up to it. Ties go to the smaller id.

    Equal vectors of one label are one object with its few smallest ids, which is all that an answer can name. A bounded
    sample (DRAWN vectors for each of at most CELLS cells) gives the cuts that deal objects to cells of near ones; a
    cell's objects make trees of about BLOCK (up to WIDEST as the table grows), its anchors chunks of about CHUNK. Chunks meet the trees of their own cells
    first, so that each anchor knows what it must beat, and then the trees that the interval of inner products between
    their leaves and a cell's ball can't exclude: a chunk is sent once to each such tree, packed. Windows of negatives
    are known before the search. If no tree can be excluded, all anchors meet all trees, in blocks.

    Rows with a null id or label, a null vector or a null, NaN or infinite component take no part; vectors are only
    compared with vectors of their length, and empty ones score 0. Repeated ids are separate rows. Scores are exact below 2**52.
    Fewer than the wanted number of positives or negatives are all returned; an empty table gives an empty result.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    numbers = F.col(vector_col).cast("array<double>")
    fit = F.forall(numbers, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    label = F.when(vec_id % changed[0] == 0, (label + 1) % changed[1]).otherwise(label)
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit)
    base = settled(whole.select(vec_id.alias("id"), label.alias("label"), F.transform(numbers, lambda c: F.floor(c * scale).cast("long")).alias("x")))
    keep = positives + 1
    asks = F.col("id") % anchors_every == 0
    few = base.withColumn("n", F.row_number().over(Window.partitionBy("x", "label").orderBy("id"))).where(F.col("n") <= max(keep, negatives))
    asking = base.where(asks).select("x", "label").distinct().withColumn("asks", F.lit(True))
    objects = few.groupBy("x", "label").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asking, ["x", "label"], "left")
    objects = settled(objects.select(F.monotonically_increasing_id().alias("uid"), "x", "label", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("x").alias("d")))

    sizes = {r["d"]: r["n"] for r in objects.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    total = sum(sizes.values())
    size = min(WIDEST, max(BLOCK, total // 1024))  # larger trees meet fewer times
    cells = min(CELLS, -(-total // size))
    drawn = objects.orderBy(F.xxhash64("uid"), "uid").limit(cells * DRAWN).select("d", "x").collect() if total else []
    cuts, first, n_cells = {}, {}, 0
    for d in sorted(sizes):
        own = [r["x"] for r in drawn if r["d"] == d]
        own = np.array(own, float).reshape(len(own), d)
        cuts[d], first[d] = Cells(own, max(1, cells * len(own) // max(1, len(drawn)))), n_cells
        n_cells += len(cuts[d].centre)
    shared = spark.sparkContext.broadcast((cuts, first))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first = shared.value
        for batch in batches:
            cell, d_of = np.zeros(batch.num_rows, np.int64), batch.column("d").to_numpy()
            for d in np.unique(d_of).tolist():
                own = np.flatnonzero(d_of == d)
                cell[own] = first[d] + cuts[d].of(_matrix(batch.take(pa.array(own)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    kinds = "uid long, x array<long>, label long, ids array<long>, asks boolean, d int, cell long"
    placed = settled(objects.mapInArrow(route, kinds))
    counts = {r["cell"]: (r["n"], r["m"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("m")).collect()}
    trees, chunks, tree, chunk, room, before = {}, {}, 0, -1, 0, None
    dim_of = {c + first[d]: d for d in sizes for c in range(len(cuts[d].centre))}
    for cell in sorted(counts):
        many, asking_ = counts[cell]
        trees[cell] = (tree, -(-many // size))
        tree += trees[cell][1]
        if asking_ > room or dim_of[cell] != before:  # a chunk has vectors of one length
            chunk, room = chunk + 1, CHUNK
        pieces = max(1, -(-asking_ // CHUNK))
        chunks[cell] = (chunk, pieces)
        chunk, room, before = chunk + pieces - 1, room - asking_ if pieces == 1 else 0, dim_of[cell]
    plan = spark.sparkContext.broadcast((trees, chunks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, chunks = plan.value
        for batch in batches:
            cell, uid = batch.column("cell").to_pylist(), batch.column("uid").to_numpy()
            mixed = ((uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            t, c = np.array([trees[x] for x in cell]).reshape(-1, 2), np.array([chunks[x] for x in cell]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t[:, 0] + mixed % t[:, 1]), pa.array(c[:, 0] + mixed % c[:, 1])], names=[*batch.schema.names, "block", "chunk"])

    dealt = placed.mapInArrow(deal, f"{kinds}, block long, chunk long")

    def build(table: pa.Table) -> pa.Table:
        cuts, first = shared.value
        d, cell = table.column("d")[0].as_py(), table.column("cell")[0].as_py()
        v = _matrix(table, d)
        made, ids = BallTree(v, table.column("label").to_numpy()), table.column("ids").to_pylist()
        radius = np.sqrt(((v - cuts[d].centre[cell - first[d]]) ** 2).sum(axis=1).max())
        return pa.table({"block": table.column("block").slice(0, 1), "cell": pa.array([cell]), "radius": pa.array([radius]), "packed": pa.array([pickle.dumps((made, [ids[r] for r in made.row]))], pa.binary())})

    blocks = settled(dealt.groupBy("block").applyInArrow(build, "block long, cell long, radius double, packed binary"))
    anchors = settled(dealt.where("asks").select("uid", "x", "label", "d", "cell", "chunk"))
    radius = {r["cell"]: r["r"] for r in blocks.groupBy("cell").agg(F.max("radius").alias("r")).collect()}  # one for each cell
    balls = {d: [(c + first[d], x, radius[c + first[d]]) for c, x in enumerate(cuts[d].centre) if c + first[d] in radius] for d in sizes}
    above = spark.sparkContext.broadcast({d: (np.array([c for c, _, _ in b], np.int64), np.array([x for _, x, _ in b], float).reshape(len(b), d), np.array([r for _, _, r in b])) for d, b in balls.items()})

    def pack(table: pa.Table) -> pa.Table:
        """One row for each chunk: its tree, windows in the tree's order, the anchors' numbers and cells."""
        d = table.column("d")[0].as_py()
        made = BallTree(_matrix(table, d), table.column("label").to_numpy())
        wide = max((len(x) for x in table.column("low").to_pylist()), default=0)
        ends = [np.array([[*x, *[fill] * (wide - len(x))] for x in table.column(c).to_pylist()], float).reshape(-1, wide)[made.row] for c, fill in (("low", np.inf), ("high", -np.inf))]
        data = pickle.dumps((d, made, *ends, table.column("uid").to_numpy()[made.row], np.unique(table.column("cell").to_numpy())))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "data": pa.array([data], pa.binary())})

    def asked(windows: DataFrame) -> DataFrame:
        return settled(anchors.join(windows, "uid").groupBy("chunk").applyInArrow(pack, "chunk long, data binary"))

    def meet(asked: DataFrame, same: bool, k: int, home: bool | None) -> DataFrame:
        """uid, high, score, id: what chunks find in the trees of their own cells (home), of all others, or of all (None)."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                    d, made, low, high, _, own = pickle.loads(data.as_py())
                    number, centre, radius = above.value[d]
                    if home:
                        met = own
                    else:
                        leaves = np.flatnonzero(made.left < 0)
                        least, most = intervals(made.centre[leaves], made.radius[leaves], centre, radius)
                        ends = [(low[a:b].min(initial=np.inf), high[a:b].max(initial=-np.inf)) for a, b in zip(made.start[leaves], made.end[leaves], strict=True)]
                        need, top = np.array(ends).reshape(-1, 2).T
                        met = number[((most >= need[:, None]) & (least <= top[:, None])).any(axis=0)]
                        met = np.setdiff1d(met, own) if home is False else met
                    for cell in met.tolist():
                        block, pieces = plan.value[0][cell]
                        for t in range(block, block + pieces):
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([chunk // TOGETHER], pa.int64()), pa.array([data.as_py()], pa.binary())], names=["block", "part", "data"])

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                tree, ids = pickle.loads(left.column("packed")[0].as_py())
                for data in right.column("data"):
                    _, made, low, high, uid, _ = pickle.loads(data.as_py())
                    found = Search(made, low, high, same, k)
                    found.meet(tree, ids)
                    a, w, n = np.nonzero(np.isfinite(found.score))
                    out.append((uid[a], high[a, w].astype(np.int64), found.score[a, w, n].astype(np.int64), found.id[a, w, n]))
            columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
            return pa.table(dict(zip(("uid", "high", "score", "id"), columns, strict=True)))

        sent = settled(asked.mapInArrow(spread, "block long, part long, data binary"))
        wanted = blocks.join(sent.select("block", "part").distinct(), "block").select(F.col("block").alias("of"), F.col("part").alias("for"), "packed")
        return settled(wanted.groupBy("of", "for").cogroup(sent.groupBy("block", "part")).applyInArrow(search, "uid long, high long, score long, id long"))

    def best(hits: DataFrame, k: int) -> DataFrame:
        """uid, high, found: the k best of each, best first."""
        order = Window.partitionBy("uid", "high").orderBy(F.desc("score"), "id")
        few = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        return few.groupBy("uid", "high").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))

    one = lambda c: F.array(c.cast("long"))
    near = meet(asked(anchors.select("uid", one(F.lit(-OPEN)).alias("low"), one(F.lit(OPEN)).alias("high"))), True, keep, True)
    known = best(near, keep).select("uid", F.when(F.size("found") == keep, F.element_at("found", keep)["score"]).alias("low"))
    bound = anchors.select("uid").join(known, "uid", "left").select("uid", one(F.coalesce("low", F.lit(-OPEN))).alias("low"), one(F.lit(OPEN)).alias("high"))
    liked = settled(best(near.unionAll(meet(asked(bound), True, keep, False)), keep).select("uid", "found"))

    # Each anchor's own row goes from its object's list, or one that can't be told from it.
    own_score = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)
    asking = attach(base.where(asks), objects.where("asks").select("x", "label", "uid"), ["x", "label"])
    rows = attach(settled(asking.select("id", "uid", own_score.alias("own"))), liked, ["uid"])
    at = F.array_min(F.transform(F.filter("found", lambda f: (f["id"] == F.col("id")) & (f["score"] == F.col("own"))), lambda f: f["n"]))
    rows = rows.withColumn("at", at)
    others = F.slice(F.filter("found", lambda f: F.col("at").isNull() | (f["n"] != F.col("at"))), 1, positives)
    pairs = settled(rows.select(F.col("id").alias("anchor_id"), "uid", F.explode(others).alias("p")).select("anchor_id", "uid", F.col("p.id").alias("positive_id"), F.col("p.score").alias("high")))

    # An object's anchors have at most keep different scores of positives.
    low = F.transform("highs", lambda s: -F.floor(-s * share[0] / share[1]).cast("long"))
    windows = pairs.select("uid", "high").where("high >= 0").distinct().groupBy("uid").agg(F.collect_list("high").alias("highs")).select("uid", low.alias("low"), F.col("highs").alias("high"))
    hard = settled(best(meet(asked(windows), False, negatives, None), negatives))
    out = attach(pairs, hard, ["uid", "high"]).select("anchor_id", "positive_id", F.explode("found").alias("f"), F.col("high").alias("positive_score"))
    return out.select("anchor_id", "positive_id", F.col("f.n").cast("int").alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score"))


def op13_dual_tree_negatives(spark, sf_dir: str) -> DataFrame:
    return packed(mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.r AS a, a.id AS anchor_id, c.r AS c, c.id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.x) = len(c.x) WHERE a.id % 100 = 0),
liked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM scored WHERE same) WHERE n <= 5),
hard AS (
  SELECT l.anchor_id, l.id AS positive_id, CAST(row_number() OVER (PARTITION BY l.a, l.c ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, l.score AS positive_score, s.score AS negative_score
  FROM liked l JOIN scored s ON s.a = l.a AND NOT s.same AND 80 * l.score <= 100 * s.score AND 100 * s.score <= 100 * l.score)
SELECT * FROM hard WHERE rank <= 5
"""
