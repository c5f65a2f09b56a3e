"""SimHash near-duplicates: fingerprints, links found through pivot distance tables, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import documents, packed, settled, ship
from tarn.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of a key that one task compares with as many others; larger keys are split.
HALF = 2000
#: Nodes from here on are fingerprints of rows without an id.
UNNAMED = 1 << 62
#: Rows that one task takes on average.
TASK_ROWS = 200_000


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits, each set if it is set in over half of the XXH64 of the text's word shingles, repeats included."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1]))
    if len(w) > width:
        ends, starts = ends[width - 1 :], starts[: 1 - width]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends - 1).tolist(), strict=True)])
    n, total = len(starts), np.zeros(64, np.int64)
    hashes = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for k in range(0, n, 255):  # as many as one byte can count
        total += np.add.reduce(np.unpackbits(hashes[k : k + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"", width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(count: int = 32, seed: int = 20) -> np.ndarray:
    """Reference fingerprints: random 64-bit values, the same in every task."""
    return np.random.default_rng(seed).integers(0, 2**64, count, np.uint64)


def linked(group: np.ndarray, half: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a forest) of one group that differ in `most` or fewer bits; rows are sorted by group.

    Rows of one half (if not negative) aren't compared with each other: that is done in the half's own group.

    Pairs whose distances to any pivot differ by over `most` are discarded by that alone, as
    |d(x, p) - d(y, p)| <= d(x, y); the survivors are verified. Pairs that are already connected are passed over.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    n, got_a, got_b = len(fp), [], []
    root = np.arange(n)
    live, step = np.arange(n), 1
    while len(live := live[live + step < n]) and len(live := live[group[live] == group[live + step]]):
        a = live[root[live] != root[live + step]]
        a = a[(half[a] < 0) | (half[a] != half[a + step])]
        for k in range(0, table.shape[1], 4):
            if not len(a):
                break
            a = a[(np.abs(table[a, k : k + 4] - table[a + step, k : k + 4]) <= most).all(axis=1)]
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= most]
        for x, y in zip(a.tolist(), (a + step).tolist(), strict=True):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                got_a.append(x)
                got_b.append(y)
                root[max(p, q)] = min(p, q)
        if len(a):
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        step += 1
    return np.array(got_a, np.int64), np.array(got_b, np.int64)


def agreeing(rows: int, most: int) -> int:
    """How many blocks pairs must agree in: more as rows grow, so that the pairs formed grow with the rows only."""
    return next((k for k in range(2, 5) if 16 << (64 * k // (most + k)) >= rows), 4)


def split_keys(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The rows with low, high and part; rows meet where key, low and high agree, and no such group passes 2 * HALF rows.

    A key with more than HALF rows is split in parts by a hash of `by`. A part's own group holds it once (part -1);
    the groups of two parts hold both, and rows of one part needn't be compared there again.
    """
    parts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") > HALF).select(*key, F.ceil(F.col("parts") / HALF).cast("int").alias("parts"))
    rows = rows.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("half", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("half", "other"), "high": F.greatest("half", "other")})
    return rows.withColumn("part", F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("half"))).drop("half", "other", "parts")


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between the nodes of distinct fingerprints (node, fp) that differ in `most` or fewer bits.

    The pivot table discards pairs, but it can't say which pairs to form. So pairs form only among fingerprints that
    agree in k of `most` + k blocks of bits: at most `most` blocks differ, so no link is lost, whatever k is. A key
    with more than HALF rows is split in parts, and each two parts meet in a group of their own, so no task grows
    with a key.
    """
    count = distinct.count()
    agree = agreeing(count, most)
    blocks = most + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    picks = [sum(masks[k] for k in pick) for pick in combinations(range(blocks), agree)]
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("bits")) for k, mask in enumerate(picks)))
    rows = distinct.select("node", "fp", F.explode(keys).alias("key")).select("node", "fp", "key.kind", "key.bits")
    rows = split_keys(rows, ["kind", "bits"], "fp").select("kind", "bits", "low", "high", "part", "node", "fp")
    by = ["kind", "bits", "low", "high"]
    tasks = max(1, -(-count * len(picks) // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # about TASK_ROWS rows
        if table is None or not table.num_rows:
            return
        c = [table.column(x).to_numpy() for x in by]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in c], axis=0)
        a, b = linked(np.cumsum(new), table.column("part").to_numpy(), table.column("fp").to_numpy().view(np.uint64), most)
        node = table.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    ship(distinct.sparkSession)
    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and the component of documents that it is linked to.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; shingles are `width` words joined by a
    space, repeats included (a shorter text: all of its words; no words: fingerprint zero). Two fingerprints link if
    `most` or fewer of their 64 bits differ; equal fingerprints are one node, so copies form no pairs.

    Returns doc_id, fp (signed long), component_id (the smallest doc_id reachable, itself included).

    Null texts count as empty, and all texts without words are linked to each other. A very long text is held whole,
    its shingles' bits a slice at a time. Rows with a null id get a
    component but never name one; repeated rows get equal results. An empty table gives an empty result. Other
    columns are ignored.
    """
    fps = settled(fingerprints(docs, width, id_col, text_col))
    # A node is named by its smallest id, so the smallest node of a component is the component's id.
    unnamed = F.lit(UNNAMED).bitwiseOR(F.col("fp").bitwiseAND(F.lit(UNNAMED - 1)))
    nodes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.coalesce("first", unnamed).alias("node")))
    placed = nodes.join(components(links(nodes, most)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = settled(placed.select("fp", F.when(F.col("root") < UNNAMED, F.col("root")).alias("component_id")))
    return fps.join(placed, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_components(spark, sf_dir: str) -> DataFrame:
    return packed(near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
