"""Language-model scoring: context-tree weighting over bytes, beside a smoothed unigram model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import documents, id_remainder, packed, settled, ship

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of context; tokens, and byte grams, whose figures every task has at hand; grams that a task fits on average.
DEPTH, COMMON, COMMON_GRAMS, FITTED = 5, 1 << 19, 1 << 21, 250_000
#: Distinct tokens or byte grams, and bytes of text, that a task holds at a time.
HELD, SLICE = 200_000, 1 << 20
END = xxhash.xxh64_intdigest(b"")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _grams(joined: list[bytes], depth: int) -> np.ndarray:
    """The last depth + 1 bytes at each place of the texts, as one number; texts end in a line break and begin after one."""
    pad = b"\n" * depth
    buf = np.frombuffer(b"".join([pad + x + b"\n" for x in joined]), np.uint8)
    out = np.zeros(len(buf) - depth, np.uint64)
    for j in range(depth + 1):
        out <<= np.uint64(8)
        out |= buf[j : j + len(out)]
    size = np.array([len(x) + 1 for x in joined])
    start = np.concatenate(([0], np.cumsum(size + depth)[:-1]))
    return out[np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series at x + 8, brought back by the recurrence."""
    z, down = x + 8, np.ones_like(x)
    for k in range(8):
        down *= x + k
    inv = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680 - np.log(down)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


@dataclass
class ContextTree:
    """A weighted context tree, flattened: child nodes by older byte, and log10 of each next byte's probability."""

    depth: int
    alphabet: np.ndarray  # byte -> column of child
    child: np.ndarray
    log10: np.ndarray

    @classmethod
    def fit(cls, depth: int, level: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> ContextTree:
        """From the counts of next bytes (symbol) in contexts (their last `level` bytes as a number), suffixes included.

        Each of a next byte's eight bits has a binary tree of its own. A context's probability of its bits is half
        its own KT estimate and half the product over its children; children that aren't among the contexts are
        one child together. From these follow the weights with which the estimates along a path mix.
        """
        if not len(level):
            level, context, symbol, count = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1)
        seen = np.unique(symbol[count > 0])
        prefix = [[(1 << k) | (s >> (8 - k)) for k in range(8)] for s in range(256)]
        used = sorted({p for s in seen.tolist() for p in prefix[s]})
        place = {p: i for i, p in enumerate(used)}
        bit = np.zeros((2, 256, len(used)))
        rest = np.zeros(256)
        for s in range(256):
            for k, p in enumerate(prefix[s]):
                if p in place:
                    bit[s >> (7 - k) & 1, s, place[p]] = 1
                else:
                    rest[s] += np.log10(0.5)
        keys, counts, up = [], [], []
        for d in range(depth + 1):
            own = level == d
            keys.append(np.unique(context[own]) if d else np.zeros(1, np.uint64))
            table = np.zeros((len(keys[d]), 256))
            np.add.at(table, (np.searchsorted(keys[d], context[own]), symbol[own]), count[own])
            counts.append(table)
            up.append(np.searchsorted(keys[d - 1], keys[d] & np.uint64((1 << 8 * (d - 1)) - 1)) if d else None)
        alone, weight, ratio = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
        below = None
        for d in range(depth, -1, -1):
            zeros, ones = counts[d] @ bit[0], counts[d] @ bit[1]
            own = _kt(zeros, ones)
            ratio[d] = (ones + 0.5) / (zeros + ones + 1)
            if d == depth:
                below = own
                continue
            others = counts[d].copy()
            np.subtract.at(others, up[d + 1], counts[d + 1])
            zeros, ones = others @ bit[0], others @ bit[1]
            alone[d] = (ones + 0.5) / (zeros + ones + 1)
            split = _kt(zeros, ones)
            np.add.at(split, up[d + 1], below)
            below = np.logaddexp(own, split) - np.log(2)
            weight[d] = np.exp(own - np.log(2) - below)
        offset = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        column = np.full(256, len(seen), np.int64)
        column[seen] = np.arange(len(seen))
        child = np.full((offset[-1], len(seen) + 1), -1, np.int32)
        log10 = np.empty((offset[-1], 256), np.float32)
        mixed, left = np.zeros_like(ratio[0]), np.ones_like(ratio[0])
        for d in range(depth + 1):
            if d:
                older = (keys[d] >> np.uint64(8 * (d - 1))).astype(np.int64)
                child[offset[d - 1] + up[d], column[older]] = offset[d] + np.arange(len(keys[d]))
                mixed, left = mixed[up[d]], left[up[d]]
            if d < depth:
                mixed = mixed + left * weight[d] * ratio[d]
                left = left * (1 - weight[d])
                one = mixed + left * alone[d]
            else:
                one = mixed + left * ratio[d]
            log10[offset[d] : offset[d + 1]] = np.log10(one) @ bit[1].T + np.log10(1 - one) @ bit[0].T + rest
        return cls(depth, column, child, log10)

    def score(self, joined: list[bytes]) -> np.ndarray:
        """Log10 of each text's probability, its end included."""
        g = _grams(joined, self.depth)
        node, live = np.zeros(len(g), np.int64), np.arange(len(g))
        flat, wide = self.child.ravel(), self.child.shape[1]
        for d in range(self.depth):
            older = self.alphabet[(g[live] >> np.uint64(8 * (d + 1))) & np.uint64(255)]
            to = flat[node[live] * wide + older]
            found = to >= 0
            live = live[found]
            node[live] = to[found]
        each = self.log10.ravel()[node * 256 + (g & np.uint64(255)).astype(np.int64)].astype(np.float64)
        size = np.array([len(x) + 1 for x in joined])
        return np.add.reduceat(each, np.concatenate(([0], np.cumsum(size)[:-1])))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts, a few MB at a time, with the first one's place."""
    first, held, size = 0, [], 0
    for i, x in enumerate(batch.column("text")):
        held.append(x.as_py())
        size += len(held[-1])
        if size > SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _counted(rows_in: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): counts of tokens (kind 0, by hash) and of byte grams (kind 1), summed within tasks first.

    Counts come from training rows; grams that only other rows have count zero.
    """

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for first, texts in _slices(batch):
                joined: tuple[list[bytes], list[bytes]] = ([], [])
                for t, out in zip(texts, batch.column("held_out").slice(first, len(texts)).to_pylist(), strict=True):
                    w = tokens(t)
                    if not out:
                        words.update(w)
                        words[b""] += 1
                    joined[out].append(b" ".join(w))
                for out, some in enumerate(joined):
                    if some:
                        k, n = np.unique(_grams(some, depth), return_counts=True)
                        both, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
                        keys, counts = both, np.bincount(at, np.concatenate((counts, n * (1 - out))), len(both)).astype(np.int64)
                if len(words) > HELD:
                    yield rows(0, *_hashed(words))
                    words = Counter()
                if len(keys) > HELD:
                    yield rows(1, keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield rows(0, *_hashed(words))
        yield rows(1, keys, counts)

    return rows_in.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _hashed(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.fromiter(words.values(), np.int64, len(words))


def _climb(code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, steps: int) -> list[tuple]:
    """Nodes of the levels above those given (sorted codes; a code's last byte is its oldest), deepest first.

    Each level is (code, zeros, ones, below, weight, up), with up from the level under it.
    """
    out = []
    for _ in range(steps):
        code = code >> np.uint64(8)
        new = np.concatenate(([True], code[1:] != code[:-1]))
        first, up = np.flatnonzero(new), np.cumsum(new) - 1
        code, zeros, ones, split = code[first], np.add.reduceat(zeros, first), np.add.reduceat(ones, first), np.add.reduceat(below, first)
        own = _kt(zeros, ones) - np.log(2)
        below = np.logaddexp(own, split - np.log(2))
        out.append((code, zeros, ones, below, np.exp(own - below), up))
    return out


def _descend(levels: list[tuple], mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed estimates and what weight is left, at the deepest of the levels, from those of the top one's parents."""
    for i in range(len(levels) - 1, -1, -1):
        _, zeros, ones, _, weight, _ = levels[i]
        mixed, left = mixed + left * weight * (ones + 0.5) / (zeros + ones + 1), left * (1 - weight)
        if i:
            mixed, left = mixed[levels[i][5]], left[levels[i][5]]
    return mixed, left


def _leaves(key: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple]:
    """For each of the eight bits: order of grams, their leaf, bit, and the leaves (code, zeros, ones, below).

    A code is the bits before this one, after a one, and then the context's bytes, the last one first.
    """
    symbol, back = key & np.uint64(255), np.zeros_like(key)
    for d in range(depth):
        back = back << np.uint64(8) | (key >> np.uint64(8 * (d + 1)) & np.uint64(255))
    for k in range(8):
        code = (np.uint64(1 << k) | symbol >> np.uint64(8 - k)) << np.uint64(8 * depth) | back
        order = np.argsort(code, kind="stable")
        code, bit = code[order], (symbol[order] >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        new = np.concatenate(([True], code[1:] != code[:-1]))
        first = np.flatnonzero(new)
        zeros, ones = np.add.reduceat(np.where(bit, 0.0, n[order]), first), np.add.reduceat(np.where(bit, n[order], 0.0), first)
        yield order, np.cumsum(new) - 1, bit, (code[first], zeros, ones, _kt(zeros, ones))


def fit_grams(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, log10): each gram's log10 probability of its last byte after the others, by the tree over all contexts.

    Grams (key, n) are distinct; those with a count of zero are contexts and bytes never seen. The tree is fitted in
    parts, one for each two last bytes of context, in tasks whose number grows with the grams; no context is left
    out. The driver joins the parts' tops: at most 65,536 contexts, whatever the input.
    """
    top = min(2, depth)
    count = grams.count()
    part = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    dealt = grams.select("key", "n", part.alias("part")).repartition(max(1, -(-count // FITTED)), "part")

    def read(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(batches)
        key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(np.float64)
        order = np.argsort(key)
        return key[order], n[order]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        for _, _, _, leaf in _leaves(*read(held), depth):
            at = _climb(*leaf, depth - top)
            code, zeros, ones, below = at[-1][:4] if at else leaf
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], names=["code", "zeros", "ones", "below"])

    got = dealt.mapInArrow(tops, "code long, zeros double, ones double, below double").toArrow()
    code = got.column("code").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(code)
    above: tuple = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if top and len(code):
        levels = _climb(code[order], *(got.column(k).to_numpy()[order] for k in ("zeros", "ones", "below")), top)
        above = (levels[0][0], *_descend(levels, np.zeros(len(levels[-1][0])), np.ones(len(levels[-1][0]))))
    shared = grams.sparkSession.sparkContext.broadcast(above)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        key, n = read(held)
        parents, mixes, lefts = shared.value
        out = np.zeros(len(key))
        for order, at, bit, leaf in _leaves(key, n, depth):
            levels = _climb(*leaf, depth - top)
            code = levels[-1][0] if levels else leaf[0]
            up = np.searchsorted(parents, code >> np.uint64(8)) if top else None
            mixed, left = (mixes[up], lefts[up]) if top else (np.zeros(len(code)), np.ones(len(code)))
            if levels:
                mixed, left = _descend(levels, mixed, left)
                mixed, left = mixed[levels[0][5]], left[levels[0][5]]
            one = (mixed + left * (leaf[2] + 0.5) / (leaf[1] + leaf[2] + 1))[at]
            out[order] += np.log10(np.where(bit, one, 1 - one))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(out)], names=["key", "n", "log10"])

    return dealt.mapInArrow(fit, "key long, n long, log10 double")


def _least(table: DataFrame, most: int, least: int) -> int:
    """The least count of which at most `most` rows have as much; there are far fewer different counts than rows."""
    there = 0
    for n, k in table.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        there += k
        if there > most:
            return n + 1
    return least


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document by a context tree and by a unigram model, both learned from nine tenths of them.

    Training rows are those whose crc32 of the id's text isn't 0 modulo ten. Texts become words (runs of anything but
    ASCII white space, A-Z lower-cased) and an end; the tree reads the words joined by single spaces and a line break
    as the end, byte by byte. Counts come from all training texts, and the tree has all of their contexts. The tables
    of common tokens and grams that each task gets have fixed bounds; figures of the remaining ones are joined.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability),
    code_length (bits a byte of what the tree reads).

    Null and empty texts have one token, the end; a very long one is held whole. Grams and tokens of equal count are
    kept at hand together or not at all, which changes no score. A null id counts as training. Repeated rows are scored and counted
    one by one. An empty table gives an empty result; without training rows all bytes are equally likely and the
    base score is 0. Other columns are ignored.
    """
    ship(docs.sparkSession)
    held = F.when(F.col(id_col).isNotNull(), id_remainder(F.col(id_col), 10) == 0).otherwise(F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = settled(_counted(rows.select("text", "held_out"), depth))
    words = counts.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    table = settled(fit_grams(counts.where("kind = 1").select("key", "n"), depth))
    least, fewest = _least(words, COMMON, 1), _least(table, COMMON_GRAMS, 0)
    near = table.where(F.col("n") >= fewest).select("key", "log10").toArrow()
    gram = near.column("key").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(gram)
    grams = (gram[by], near.column("log10").to_numpy()[by])
    common = words.where(F.col("n") >= least).toArrow()
    key, n = common.column("key").to_numpy().astype(np.int64).view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(key)
    shared = docs.sparkSession.sparkContext.broadcast((grams, key[order], n[order].astype(np.float64)))
    below = total + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, log10), keys, n = shared.value
        value = np.log10((n + 0.1) / below)
        for batch in batches:
            for first, texts in _slices(batch):
                lists = [tokens(t) for t in texts]
                joined = [b" ".join(w) for w in lists]
                size = np.array([len(w) + 1 for w in lists])
                starts = np.concatenate(([0], np.cumsum(size)[:-1]))
                h = np.fromiter((x for w in lists for x in (*map(xxhash.xxh64_intdigest, w), END)), np.uint64, size.sum())
                at = np.searchsorted(keys, h)
                hit = (keys[np.minimum(at, len(keys) - 1)] == h) if len(keys) else np.zeros(len(h), bool)
                each = np.zeros(len(h))
                each[hit] = value[at[hit]]
                miss = np.add.reduceat((~hit).astype(np.int64), starts)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(miss))), pa.int32()), pa.array(h[~hit].view(np.int64)))
                bytes_read = np.array([len(x) + 1 for x in joined])
                g, back = np.unique(_grams(joined, depth), return_inverse=True)
                at = np.searchsorted(known, g)
                have = (known[np.minimum(at, len(known) - 1)] == g) if len(known) else np.zeros(len(g), bool)
                value_g = np.zeros(len(g))
                value_g[have] = log10[at[have]]
                lines = np.concatenate(([0], np.cumsum(bytes_read)[:-1]))
                lost = ~have[back]
                far = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(lost.astype(np.int64), lines)))), pa.int32()), pa.array(g[back[lost]].view(np.int64)))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(size - miss), pa.array(np.add.reduceat(each, starts)), pa.array(np.add.reduceat(value_g[back], lines)), pa.array(bytes_read), rare, far],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "bytes_read", "rare", "far"],
                )

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, bytes_read long, rare array<long>, far array<long>")
    scored = settled(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = rare.join(words.where(F.col("n") < least), "key", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("more"), F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(float(below)))).alias("rest"))
    if fewest:  # not all grams are at hand
        far = scored.select("row", F.explode("far").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
        far = far.join(table.where(F.col("n") < fewest), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("others"))
        scored = scored.join(far, "row", "left").withColumn("score", F.col("score") + F.coalesce("others", F.lit(0.0)))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("bytes_read")).alias("code_length"),
    )


def op9_context_tree_scores(spark, sf_dir: str) -> DataFrame:
    return packed(score(documents(spark, sf_dir)))
