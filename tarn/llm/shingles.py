"""Near-duplicates by word shingles: wide SimHash fingerprints and pivot distances pick pairs, whole sets verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import settled, ship
from tarn.llm.components import components
from tarn.llm.simhash import LOWER, split_keys

#: Bands of min-hashes and min-hashes of a band: sets of similarity 0.8 share no band once in 2,800 pairs.
BANDS, BAND_ROWS = 20, 5
#: 64-bit words of a fingerprint, and members of a group that serve as pivots.
WORDS, PIVOTS = 64, 4
#: Of each round: words of the fingerprint, differing bits up to which it looks, and whether at a forest of pairs only.
#: At similarity 0.8, 621 of 4096 bits differ (deviation 23), and pairs beyond 698 are discarded: one in 3,000 of those.
ROUNDS = ((16, 160, True), (64, 698, False))
#: Rows that one task takes on average; words whose hashes a task keeps; pairs a task holds before it thins them.
TASK_ROWS, KEPT_WORDS, HELD = 100_000, 200_000, 2_000_000
_RANDOM = np.random.default_rng(5)
_SEEDS, _ODD = (_RANDOM.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
_SPREAD, _COMMON = _RANDOM.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1), _RANDOM.integers(0, 2, 64 * WORDS)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_word = _Words().__getitem__


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word shingles, sorted; a shorter text is one shingle, no words are none."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    v, width = np.fromiter(map(_word, w), np.uint64, len(w)), min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[k : k + len(h)]
    return np.unique(_mixed(h))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets at least 4/5."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes; an empty set has keys of its own."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 2048):
        least = np.minimum(least, ((h[None, k : k + 2048] ^ _SEEDS[:, None]) * (_ODD[:, None] | np.uint64(1))).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WORDS bits; one shingle that all sets have keeps small sets from ties."""
    total = _COMMON.copy()
    for k in range(0, len(h), 255):  # as many as one byte can count
        words = _mixed(h[k : k + 255, None] * _SPREAD[None, :])
        total += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h) + 1).view(np.uint64)


def _roots(root: np.ndarray) -> np.ndarray:
    while (up := root[root]).tobytes() != root.tobytes():
        root = up
    return root


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the pairs join something when they are taken by distance."""
    if not len(a):
        return a
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root, taken = ends[: len(a)], ends[len(a) :], np.arange(len(names)), []
    order = np.lexsort((b, a, far))
    for k in range(0, len(order), 4096):
        root = _roots(root)
        some = order[k : k + 4096]
        for i in some[root[x[some]] != root[y[some]]].tolist():
            p, q = x[i], y[i]
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                taken.append(i)
    return np.array(taken, np.int64)


def pairs(group: np.ndarray, half: np.ndarray, comp: np.ndarray, size: np.ndarray, fp: np.ndarray, most: int, band: np.ndarray | None = None, keys: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, differing bits) of rows of one group, but of different components, that differ in `most` or fewer bits.

    Rows are sorted by group. Sizes that rule a similarity of 4/5 out are passed over. The distances of all rows to
    the first members of their group, the pivots, are computed once; pairs whose distances to any pivot differ by
    over `most` are discarded by that alone, and the survivors' bits are compared. With the rows' bands and their keys
    in all bands, a pair is only given in the first band that it shares.
    """
    n = len(group)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    length = np.diff(np.append(first, n))
    start, last = np.repeat(first, length), np.repeat(first + length - 1, length)
    table = np.stack([np.bitwise_count(fp ^ fp[np.minimum(start + k, last)]).sum(axis=1, dtype=np.int16) for k in range(PIVOTS)], axis=1)
    live, step = np.arange(n), 1
    while len(live := live[live + step <= last[live]]):
        a = live[comp[live] != comp[live + step]]
        b = a + step
        good = (half[a] < 0) | (half[a] != half[b])
        good &= 5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])
        a, b = a[good], b[good]
        near = (np.abs(table[a] - table[b]) <= most).all(axis=1)
        a, b = a[near], b[near]
        far = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64)
        near = far <= most
        if keys is not None and near.any():
            near[near] = (keys[a[near]] == keys[b[near]]).argmax(axis=1) == band[a[near]]
        if near.any():
            yield a[near], b[near], far[near]
        step += 1


def near_copies(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component and stays for each row: which documents are linked by a Jaccard similarity of their
    word-shingle sets of 4/5 or more, and which one of each component is its first.

    Words and shingles are those of simhash.near_duplicates, without repeats. Equal sets are one node. Nodes meet if
    they share a band of min-hashes; of those that meet, pairs of different components whose wide fingerprints
    differ in few enough bits (see `pairs`) are verified on their whole sets. The first rounds look at the nearest
    pairs, a forest of each group, so that what is linked becomes one component before the last round looks at all
    pairs of different components. So a large group of near copies is compared, but its pairs aren't written out.

    component is any number that linked rows share. A component's first row is that of smallest id (null last) and,
    among equal ids, of smallest text_hash (xxhash64 of the text); rows equal in both all say `stays`. Null texts count
    as empty, and all texts without words are equal. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, size, keys = [], [], []
            for x in batch.column(2):
                h = hashes(x.as_py(), width)
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                keys.append(bands(h).view(np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(size, pa.int32()), flat], names=["doc_id", "text_hash", "same", "n", "keys"])

    sets = settled(rows.mapInArrow(signed, "doc_id long, text_hash long, same binary, n int, keys array<long>"))
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = sets.groupBy("same").agg(F.min(name).alias("first"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    nodes = settled(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.where("n > 0").select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = settled(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    met = settled(keyed.join(shared, "key").select("key", "band", "node", "n"))
    which = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    same_row = rows["doc_id"].eqNullSafe(which["doc_id"]) & (rows["text_hash"] == which["text_hash"])
    # Rows equal in id and text have one node; any of their texts will do.
    texts = settled(rows.join(which, same_row).select("node", "text").groupBy("node").agg(F.first("text").alias("text")))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [wide_fingerprint(hashes(x.as_py(), width)).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fp, pa.binary())], names=["node", "fp"])

    by = ["key", "low", "high"]
    short = F.transform("keys", lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    prints = settled(texts.mapInArrow(printed, "node long, fp binary").join(nodes.select("node", short.alias("keys")), "node"))
    dealt = settled(split_keys(met, ["key"], "node").select(*by, "part", "band", "node", "n"))
    tasks = max(1, -(-dealt.count() // TASK_ROWS))

    def meet(words: int, most: int, thin: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None  # about TASK_ROWS rows
            if table is None or not table.num_rows:
                return
            column = {c: table.column(c).to_numpy() for c in (*by, "part", "band", "node", "n", "root")}
            order = np.lexsort([column[c] for c in ("node", "high", "low", "key")])
            column = {c: x[order] for c, x in column.items()}
            new = np.append(True, np.any([column[c][1:] != column[c][:-1] for c in by], axis=0))
            fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, words)[order]
            keys = None if thin else np.array(table.column("keys").to_pylist(), np.int32).reshape(-1, BANDS)[order]
            node, held, count = column["node"], [], 0

            def thinned() -> list[tuple]:
                a, b, far = (np.concatenate(x) for x in zip(*held, strict=True))
                pick = forest(node[a], node[b], far) if thin else slice(None)
                return [(a[pick], b[pick], far[pick])]

            for found in pairs(np.cumsum(new), column["part"], column["root"], column["n"].astype(np.int64), fp, most, column["band"], keys):
                held.append(found)
                count += len(found[0])
                if thin and count > HELD:
                    held = thinned()
                    count = len(held[0][0])
            for a, b, _ in thinned() if held else ():
                x, y = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        return run

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(hashes(x.as_py(), width), hashes(y.as_py(), width)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links, roots = None, None
    for words, most, thin in ROUNDS:
        now = dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else dealt.withColumn("root", F.col("node"))
        # Only groups of several components go on, and only then do rows get their fingerprints.
        mixed = now.groupBy(*by).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select(*by)
        now = now.join(mixed, by, "left_semi").join(prints.select("node", F.substring("fp", 1, 8 * words).alias("fp"), *([] if thin else ["keys"])), "node")
        found = settled(now.repartition(tasks, *by).mapInArrow(meet(words, most, thin), "a long, b long").distinct())
        known = found.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        good = known.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")
        links = settled(links.unionAll(good) if links is not None else good)
        roots = components(links)
    placed = nodes.join(roots, "node", "left").select("same", "first", F.coalesce("root", "node").alias("component"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("best"))
    placed = settled(placed.join(firsts, "component").select("same", "component", "best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return sets.select("doc_id", "text_hash", "same").join(placed, "same").select("doc_id", "text_hash", "component", stays.alias("stays"))


def one_of_each(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component of `near_copies` one row, with all its columns.

    Rows are told apart by id and text, so an id that has several texts loses only those that go. Of rows equal in
    both the one of least hash over its columns stays. Rows with a null id go if any other row of the component stays.
    """
    found = near_copies(docs, width, id_col, text_col)
    counted = settled(found.groupBy("doc_id", "text_hash", "stays").agg(F.count(F.lit(1)).alias("times")))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("own_hash"))
    same_row = lambda t: F.col("own_id").eqNullSafe(t["doc_id"]) & (F.col("own_hash") == t["text_hash"])
    gone, many = counted.where("not stays"), counted.where("stays and times > 1")
    left = rows.join(gone, same_row(gone), "left_anti")
    if many.limit(1).count():
        of_many = left.join(many, same_row(many), "left_semi")
        one = of_many.groupBy("own_id", "own_hash").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        left = left.join(many, same_row(many), "left_anti").select("doc").unionAll(one.select("doc"))
    return left.select("doc.*")
