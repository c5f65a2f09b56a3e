"""Substring dedup by content-defined chunks, cut where a gear rolling hash says so."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import documents, settled, ship

#: Bytes of text that a task cuts at a time.
SLICE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Cuts:
    """Sizes in bytes; `bits` bits of the rolling hash must be zero at a cut, `tight_bits` within a gap of `gap` bytes
    without one. `least_run` is what is worth removing."""

    smallest: int = 16
    largest: int = 1024
    bits: int = 2
    gap: int = 256
    tight_bits: int = 5
    least_run: int = 96
    seed: int = 8


def gear(buf: np.ndarray, cuts: Cuts) -> np.ndarray:
    """The rolling hash after each byte: h = 2 h + g(byte) modulo 2**16, so it depends on the last 16 bytes.

    Doubling the window: the hash of 2 n bytes is that of the last n plus 2**n times that of the n before.
    """
    h = np.random.default_rng(cuts.seed).integers(0, 1 << 16, 256, np.uint16)[buf]
    for n in (1, 2, 4, 8):
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint16(n)
        h = longer
    return h


def cut(texts: list[bytes], cuts: Cuts = Cuts()) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of each chunk, in order; chunks cover every text.

    A chunk may end before a word where the top bits of the hash are zero, once it has `smallest` bytes. In a gap of
    over `gap` bytes between such places, as text without spaces has them, it may end before any character where
    `tight_bits` are zero. So cuts depend on the bytes near them, and an insertion only moves the cuts near it. Only
    where a text has neither, such as one character over and over, chunks end after `largest` bytes.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return
    h = gear(buf, cuts)
    may = (h >> np.uint16(16 - cuts.bits)) == 0
    may &= _SPACE[buf]
    may[:-1] &= ~_SPACE[buf[1:]]
    points = np.flatnonzero(may) + 1
    ends = np.cumsum([len(t) for t in texts])
    stops = np.union1d(points, ends)
    wide = np.flatnonzero(np.diff(stops, prepend=0) > cuts.gap)
    if len(wide):
        tight = (h >> np.uint16(16 - cuts.tight_bits)) == 0
        tight[:-1] &= (buf[1:] & 0xC0) != 0x80
        tight = np.flatnonzero(tight) + 1
        inside = np.searchsorted(stops, tight)  # the gap that each lies in
        points = np.union1d(points, tight[np.isin(inside, wide)])
    base = 0
    for t, text in enumerate(texts):
        n = len(text)
        own = points[np.searchsorted(points, base, "right") : np.searchsorted(points, base + n)] - base
        start = 0
        for p in [*own.tolist(), n]:
            while p - start > cuts.largest:
                forced = start + cuts.largest
                while forced < p and text[forced] & 0xC0 == 0x80:
                    forced += 1
                yield t, start, forced
                start = forced
            if p - start >= cuts.smallest or p == n and p > start:
                yield t, start, p
                start = p
        base += n


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, x in enumerate(batch.column("text")):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size > SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def chunk_table(docs: DataFrame, cuts: Cuts, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sig, at, size, h1, h2): each chunk's row, place and digest, 96 of 128 bits; rows without an id have none.

    A row is known by its id and a hash of its text, as an id may have several texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sig = batch.column("doc_id").to_numpy(), batch.column("sig").to_numpy()
            for first, texts in _sliced(batch):
                found = list(cut(texts, cuts))
                if not found:
                    continue
                t, a, b = (np.array(x) for x in zip(*found, strict=True))
                raw = b"".join([xxhash.xxh3_128_digest(texts[i][x:y]) for i, x, y in found])
                h = np.frombuffer(raw, [("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + t]), pa.array(sig[first + t]), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(h["h1"].copy()), pa.array(h["h2"].copy())],
                    names=["doc_id", "sig", "at", "size", "h1", "h2"],
                )

    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sig long, at int, size int, h1 long, h2 int")


def _runs(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    joined: list[list[int]] = []
    for a, n in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], a + n)
        else:
            joined.append([a, a + n])
    return [(a, b) for a, b in joined if b - a >= least]


def dedup(docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text", into: str = "dedup") -> DataFrame:
    """The documents' columns with the text that is left, and one struct: n_bytes, n_removed, n_spans, spans (byte offsets).

    Texts are cut into chunks by content, and chunks are compared by 96 bits of a digest. Each chunk belongs to the
    smallest doc_id that has it; in all others it is a repeat. Runs of neighbouring repeats of at least `least_run`
    bytes are removed. Repeats inside one document stay.

    The smallest id of a digest is found by partial sums before the shuffle, so a passage that a third of the
    documents share costs each task one row; where its chunks are looked up, the join may split its rows.

    A null text counts as empty and stays null; very long texts are cut a slice at a time, but one text is held whole.
    Rows with a null id lose nothing and own nothing. An id may have several texts: each row loses its own repeats of
    smaller ids, rows of one id never take from each other, and rows equal in id and text lose the same.
    An empty table gives an empty result. All other columns are kept, whatever their names; if one is called `into`,
    the struct's name gets underscores until it is free.
    """
    ship(docs.sparkSession)
    while into.lower() in {c.lower() for c in docs.columns}:
        into += "_"
    chunks = chunk_table(docs, cuts, id_col, text_col)
    owners = chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "owner")
    repeats = chunks.join(settled(owners), ["h1", "h2"]).where("doc_id > owner").groupBy("doc_id", "sig").agg(F.collect_set(F.struct("at", "size")).alias("repeats"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("sig"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    inner = rows.join(repeats, ["doc_id", "sig"], "left").select("row", "repeats")
    names, place = docs.columns, docs.columns.index(text_col)
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            columns = row.flatten()
            texts, sizes, removed, counts, spans = [], [], [], [], []
            for text, found in zip(columns[place], batch.column(1), strict=True):
                text, found = text.as_py(), found.as_py()
                raw = (str(text) if text is not None else "").encode()
                runs = _runs([(x["at"], x["size"]) for x in found], cuts.least_run) if found else []
                if runs:
                    edges = [0, *(p for r in runs for p in r), len(raw)]
                    raw_left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    text = raw_left.decode()
                texts.append(None if text is None else str(text))
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in runs))
                counts.append(len(runs))
                spans.append([{"a": a, "b": b} for a, b in runs])
            columns[place] = pa.array(texts, pa.string())
            found = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
            found = pa.StructArray.from_arrays(found, names=["n_bytes", "n_removed", "n_spans", "spans"])
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*names, into])

    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    result = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("spans", span)])
    return inner.mapInArrow(run, T.StructType([*fields, T.StructField(into, result)]))


def op8_gear_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup(docs)
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "text")
