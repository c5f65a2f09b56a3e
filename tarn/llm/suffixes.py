"""Substring dedup over sorted suffixes: every byte of a 50-byte string that starts in an earlier document goes."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import documents, packed, settled, ship

#: Bytes of a string, and of the gram in it that places it.
LENGTH, GRAM = 50, 20
#: Bytes of text of a page, of a slice of it; documents that splitters are sampled from, and anchors of a slice of them.
PAGE, SLICE, SAMPLED, DRAWN = 4 << 20, 1 << 20, 2000, 1024


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number; zeros follow the end."""
    w = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint64)
    for n in (1, 2, 4):
        w = (w[:-n] << np.uint64(8 * n)) | (w[n:] if n == 1 else w[n:])
    return w[: len(buf)]


def multikey_order(word_at, rows: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort by words 0, 1, ... depth - 1 as a multikey quicksort does: each word only where all before it are equal.

    word_at(rows, j) gives word j of rows. Returns the order and, for each place but the first, how many leading words
    it shares with the one before.
    """
    order = np.argsort(word_at(np.arange(rows), 0), kind="stable")
    key = word_at(order, 0)
    shared = np.zeros(rows, np.int64)
    shared[1:] = key[1:] == key[:-1]
    for j in range(1, depth):
        tied = shared == j
        open_ = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(open_):
            break
        part = np.cumsum(~tied)[open_]
        key = word_at(order[open_], j)
        by = np.lexsort((key, part))
        order[open_], key = order[open_][by], key[by]
        more = np.zeros(len(open_), bool)
        more[1:] = (part[1:] == part[:-1]) & (key[1:] == key[:-1])
        shared[open_[more]] = j + 1
    return order, shared


class Anchored:
    """The strings of some texts, dealt to anchors.

    The anchor of a string is the leftmost of its grams of least hash. It depends on the string alone, so equal
    strings have equal grams at equal places in them, and it is enough to bring together suffixes that begin at
    anchors, which are about one in sixteen. An anchor stands for a run of strings: those that start at low..high.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.base = self.ends - sizes
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.buf)
        self.words = _words(self.buf)
        w = np.concatenate((self.words, np.zeros(24, np.uint64)))
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15) + w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + (w[16 : n + 16] >> np.uint64(32)) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # The leftmost place of the least hash among the LENGTH - GRAM + 1 grams from each place on, by doubling:
        # hash and place are one number, so equal hashes leave the smaller place.
        least, width, want = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), 1, LENGTH - GRAM + 1
        while width < want and len(least) > (step := min(width, want - width)):
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        fits = np.flatnonzero(np.repeat(self.ends, sizes) - np.arange(n) >= LENGTH)
        at, owner = at[fits], owner[fits]
        new = np.ones(len(fits), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (fits[1:] != fits[:-1] + 1)
        first = np.flatnonzero(new)
        self.anchor, self.owner, self.low = at[first], owner[first], fits[first]
        self.high = fits[np.append(first[1:], len(fits)) - 1] if len(first) else fits[:0]
        # 48 bits of each anchor's gram, hashed anew: least hashes are small, and would crowd into the first buckets.
        mixed = h[self.anchor] * np.uint64(0x9FB21C651E98DF25)
        self.keys = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)
        # The gram itself, by which suffixes are dealt; it lies within the text, as its string does.
        grams = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.buf, np.zeros(GRAM, np.uint8))), GRAM)
        self.lead = np.ascontiguousarray(grams[self.anchor]).view(f"S{GRAM}").ravel()
        del self.words


def _split(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, Anchored]]:
    """Slices of the texts: which document each piece is of, where in it, and its strings; no string is in two slices."""
    docs, begins, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - LENGTH + 1), SLICE):
            part = t[begin : begin + SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            docs.append(i)
            begins.append(begin)
            held.append(part)
            size += len(part)
            if size >= SLICE:
                yield np.array(docs), np.array(begins), Anchored(held)
                docs, begins, held, size = [], [], [], 0
    if held:
        yield np.array(docs), np.array(begins), Anchored(held)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed value: lengths, then bytes."""
    raw = b"".join(x.tobytes() for x in arrays)
    head = np.array([len(x) for x in arrays], np.int64).tobytes()
    return np.int64(len(head) + len(raw)).tobytes() + pa.compress(head + raw, "zstd", asbytes=True)


def _unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int(np.frombuffer(packed[:8], np.int64)[0]), "zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, byte by byte of all of them, so that high bytes, mostly zero, cost nothing."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def _from_planes(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _noted(info: pa.Table, kind: int) -> pa.Table:
    """The notes of one kind, by their number; a page without any notes has a table without columns."""
    if not info.num_rows:
        return pa.table({"of": pa.array([], pa.int64()), "sig": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    return info.filter(pa.compute.equal(info.column("kind"), kind)).sort_by("of")


def _page(table: pa.Table, info: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The page's ids, texts and hashes in order of id and hash, and which of them are copies of earlier ones (third)."""
    ids, sig = table.column("doc_id").to_numpy(), table.column("sig").to_numpy()
    order = np.lexsort((sig, ids))
    texts = table.column("text")
    info = _noted(info, 0)
    known = set(zip(info.column("of").to_pylist(), info.column("sig").to_pylist(), strict=True))
    copy = np.array([(d, s) in known for d, s in zip(ids[order].tolist(), sig[order].tolist(), strict=True)], bool)
    return ids[order], [texts[i].as_py() or b"" for i in order.tolist()], copy, sig[order]


def _slices(texts: list[bytes], copy: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, Anchored]]:
    return list(_split([b"" if c else t for t, c in zip(texts, copy, strict=True)]))


def _page_keys(ids: np.ndarray, slices: list[tuple[np.ndarray, np.ndarray, Anchored]]) -> tuple[np.ndarray, np.ndarray]:
    """The page's different gram keys, sorted, and whether each is in two or more of its documents."""
    if not slices:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, docs = np.concatenate([a.keys for _, _, a in slices]), np.concatenate([ids[d[a.owner]] for d, _, a in slices])
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.maximum.reduceat(docs, first) != np.minimum.reduceat(docs, first)) if len(keys) else np.zeros(0, bool)


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 48) // buckets for k in range(1, buckets)], np.uint64)


def _joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by row, with those that touch made one."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    # Ends so far, document by document: an offset for each keeps documents apart.
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1])).astype(np.int64)
    wide = int(b.max()) + 2
    reach = np.maximum.accumulate(b + rank * wide)
    new = np.append(True, a[1:] + rank[1:] * wide > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], a[first], (reach - rank * wide)[np.append(first[1:], len(doc)) - 1]


def _match(doc: np.ndarray, low: np.ndarray, off: np.ndarray, size: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of what is in an earlier document, among the runs of strings in one bucket: the run's number, from, to.

    A run is `size` bytes from `low` on, its anchor `off` bytes in. Runs of equal bytes are matched whole; of what is
    left, suffixes are sorted from the anchor on, and where neighbours share their gram, strings are compared.
    """
    start = np.cumsum(size) - size
    owner: dict[bytes, int] = {}
    own = [data[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    docs = doc.tolist()
    for s, d in zip(own, docs, strict=True):
        if owner.setdefault(s, d) > d:
            owner[s] = d
    first = np.fromiter((owner[s] for s in own), np.int64, len(own))
    whole = doc > first
    rest = np.flatnonzero(~whole)
    words = _words(np.concatenate((np.frombuffer(data, np.uint8), np.zeros(LENGTH + 8, np.uint8))))
    origin = start[rest] + off[rest]
    order, shared = multikey_order(lambda r, j: words[origin[r] + 8 * j] if j < 2 else words[origin[r] + 16] >> np.uint64(32), len(rest), 3)
    same = shared >= 3  # the whole gram
    run = np.cumsum(~same) - 1
    many = np.bincount(run, minlength=run.max(initial=-1) + 1) > 1
    rows = rest[order[many[run]]]
    group = run[many[run]]
    bounds = np.flatnonzero(np.append(True, np.diff(group) != 0)).tolist() if len(group) else []
    got, got_a = [], []
    for x, y in zip(bounds, [*bounds[1:], len(rows)], strict=False):
        earliest: dict[bytes, int] = {}  # of the strings around one gram
        for r in rows[x:y].tolist():
            s, d = own[r], docs[r]
            for i in range(len(s) - LENGTH + 1):
                w = s[i : i + LENGTH]
                if earliest.setdefault(w, d) > d:
                    earliest[w] = d
        for r in rows[x:y].tolist():
            s, d, at = own[r], docs[r], int(low[r])
            for i in range(len(s) - LENGTH + 1):
                if earliest[s[i : i + LENGTH]] < d:
                    got.append(r)
                    got_a.append(at + i)
    a = np.array(got_a, np.int64)
    return np.concatenate((np.flatnonzero(whole), np.array(got, np.int64))), np.concatenate((low[whole], a)), np.concatenate((low[whole] + size[whole], a + LENGTH))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (what goes, as byte offsets) and kept (the remaining bytes) of each document.

    A byte goes if it is in a 50-byte string of its document that also starts in a document of smaller id, judged on
    the texts as given. Documents that equal an earlier one wholly are found by sha256 and take no further part.

    The others are dealt into pages of about 4 MB by id and text. (1) Each page lists the hashes of its anchors' grams, sorted
    and packed; buckets of hash ranges say which are in two or more pages. (2) For those, and for grams in two or more
    documents of the page, each page sends suffixes: the run of strings around an anchor, of equal runs only the
    earliest, as the page settles later ones itself. So what the most frequent passage sends grows with pages, not
    documents. Sampled splitters range-partition the suffixes by their whole first gram, so a lead that many grams share
    is spread over buckets. (3) Each bucket sorts its suffixes by multikey quicksort and compares neighbours that
    share a gram. Splitters stand between grams, so suffixes on either side of a bucket's boundary differ within
    the first 20 bytes and have no string in common around their anchors. (4) Pages join the spans. The page table is
    shuffled once and read three times. A page writes at most one value for each of its anchors, so what is written
    grows with the text however many buckets there are.

    A very long text is cut into slices; no string is in two of them. Ties: of equal strings the smallest id keeps its own.

    Null and empty texts lose nothing, nor do texts under 50 bytes. Rows with a null id lose nothing and take nothing
    from others. An id may have several texts: rows of one id never take from each other, and each is judged by its own
    text. Rows equal in id and text are one document until the end, where it is repeated. An empty table gives an
    empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())
    size = F.octet_length("text")
    seen = settled(named.select("doc_id", size.alias("size"), F.xxhash64("text").alias("sig"), F.unhex(F.sha2("text", 256)).alias("full")))
    again = settled(seen.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    if again.limit(1).count():
        named = named.groupBy("doc_id", F.xxhash64("text").alias("sig")).agg(F.first("text").alias("text"))
    total = seen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pages, buckets = max(1, total // PAGE), max(1, total // PAGE)
    page = F.pmod(F.xxhash64("doc_id", "sig"), F.lit(pages)).cast("int").alias("page")
    firsts = seen.groupBy("full").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("full", "first")
    copies = seen.join(settled(firsts), "full").where("doc_id > first").dropDuplicates(["doc_id", "sig"]).select(page, F.lit(0).alias("kind"), F.col("doc_id").alias("of"), "sig", F.lit(None).cast("binary").alias("data"))
    copies = settled(copies)
    table = named.select("doc_id", F.xxhash64("text").alias("sig"), "text").select(page, "doc_id", "sig", "text")
    every = max(1, seen.count() // SAMPLED)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, a in _split([x.as_py() for x in batch.column("text")]):
                lead = a.lead[:: max(1, len(a.lead) // DRAWN)].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary())], names=["gram"])

    drawn = named.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0).select("text").mapInArrow(sample, "gram binary").toArrow()
    drawn = np.sort(np.array(drawn.column("gram").to_pylist(), f"S{GRAM}"))
    splitters = np.unique(drawn[np.linspace(0, len(drawn) - 1, buckets + 1)[1:-1].astype(int)]) if len(drawn) and buckets > 1 else np.zeros(0, f"S{GRAM}")

    def listed(left: pa.Table, right: pa.Table) -> pa.Table:
        number, bucket, data = [], [], []
        if left.num_rows:
            ids, texts, copy, _ = _page(left, right)
            keys, _ = _page_keys(ids, _slices(texts, copy))
            cut = np.concatenate(([0], np.searchsorted(keys, _edges(buckets)), [len(keys)]))
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    number.append(left.column("page")[0].as_py())
                    bucket.append(k)
                    data.append(_pack(_planes(keys[a:b])))
        return pa.table({"page": pa.array(number, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})

    def counted(group: pa.Table) -> pa.Table:
        lists = [_from_planes(_unpack(x.as_py(), np.uint8)[0]) for x in group.column("data")]
        keys = np.sort(np.concatenate(lists))
        shared = np.unique(keys[1:][keys[1:] == keys[:-1]])
        bits = []
        for x in lists:
            at = np.searchsorted(shared, x)
            hit = shared[np.minimum(at, len(shared) - 1)] == x if len(shared) else np.zeros(len(x), bool)
            bits.append(_pack(np.array([len(x)], np.int64), np.packbits(hit)))
        bucket = group.column("bucket").to_numpy().astype(np.int64)
        return pa.table({"page": group.column("page"), "kind": pa.array(np.ones(len(bits), np.int32)), "of": pa.array(bucket), "sig": pa.array(bucket), "data": pa.array(bits, pa.binary())})

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        number, bucket, data = [], [], []
        if left.num_rows:
            ids, texts, copy, _ = _page(left, right)
            slices = _slices(texts, copy)
            keys, twice = _page_keys(ids, slices)
            marks = _noted(right, 1).column("data")
            hit = [np.unpackbits(b)[: n[0]] for n, b in (_unpack(x.as_py(), np.int64, np.uint8) for x in marks)]
            keys = keys[(np.concatenate(hit).astype(bool) if hit else np.zeros(0, bool)) | twice]
            earliest: dict[bytes, int] = {}
            done: list[tuple[int, int, int]] = []  # rows are known by their place in the page
            out: dict[int, list] = {}
            for d, begin, a in slices:
                k = a.keys
                at = np.searchsorted(keys, k)
                pick = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == k) if len(keys) else np.zeros(0, int)
                where = np.searchsorted(splitters, a.lead[pick], side="right")
                row, low = d[a.owner[pick]], a.low[pick]
                size, off = a.high[pick] + LENGTH - low, a.anchor[pick] - low
                place = low - a.base[a.owner[pick]] + begin[a.owner[pick]]
                whole = a.buf.tobytes()
                for b, doc, r, p, o, n, at in zip(*(x.tolist() for x in (where, ids[row], row, place, off, size, low)), strict=True):
                    s = whole[at : at + n]
                    if earliest.setdefault(s, doc) < doc:  # documents come in order of id
                        done.append((r, p, p + n))
                    else:
                        out.setdefault(b, []).append((doc, r, p, o, n, s))
            number_ = left.column("page")[0].as_py()
            spans = _joined(*(np.array(c, np.int64) for c in (zip(*done, strict=True) if done else ((), (), ()))))
            home = number_ % (len(splitters) + 1)  # the bucket that hands the page's own spans on: another for each page
            for k in sorted({*out, home}):
                c = list(zip(*out[k], strict=True)) if k in out else [()] * 6
                number.append(number_)
                bucket.append(k)
                mine = spans if k == home else [x[:0] for x in spans]
                data.append(_pack(*(np.array(x, kind) for x, kind in zip(c[:5], kinds, strict=False)), np.frombuffer(b"".join(c[5]), np.uint8), *mine))
        return pa.table({"page": pa.array(number, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})

    kinds = (np.int64, np.int32, np.int64, np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.int64)

    def compared(group: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), *kinds) for x in group.column("data")]
        of = np.concatenate([np.full(len(p[0]), n) for p, n in zip(parts, group.column("page").to_pylist(), strict=True)])
        doc, row, low, off, size, data = (np.concatenate([p[i] for p in parts]) for i in range(6))
        runs, a, b = _match(doc, low, off.astype(np.int64), size.astype(np.int64), data.tobytes())
        by, found = of[runs], (row[runs].astype(np.int64), a, b)
        number, out = [], []
        for p, n in zip(parts, group.column("page").to_pylist(), strict=True):
            spans = _joined(*(np.concatenate((x[by == n], y)) for x, y in zip(found, p[6:], strict=True)))
            number.append(n)
            out.append(_pack(*spans))
        none = pa.nulls(len(out), pa.int64())
        return pa.table({"page": pa.array(number, pa.int32()), "kind": pa.array(np.full(len(out), 2, np.int32)), "of": none, "sig": none, "data": pa.array(out, pa.binary())})

    def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, copy, sig = _page(left, right) if left.num_rows else (np.zeros(0, np.int64), [], np.zeros(0, bool), np.zeros(0, np.int64))
        packed = [_unpack(x.as_py(), np.int64, np.int64, np.int64) for x in _noted(right, 2).column("data")]
        row, a, b = _joined(*(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in packed)]) for i in range(3)))
        spans, kept = [], []
        for r, (t, c) in enumerate(zip(texts, copy.tolist(), strict=True)):
            i, j = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
            own = ([(0, len(t))] if len(t) >= LENGTH else []) if c else list(zip(a[i:j].tolist(), b[i:j].tolist(), strict=True))
            edges = [0, *(x for s in own for x in s), len(t)]
            kept.append(b"".join([t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]))
            spans.append([{"a": x, "b": y} for x, y in own])
        return pa.table({"doc_id": pa.array(ids), "sig": pa.array(sig), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    blobs, notes = "page int, bucket int, data binary", "page int, kind int, of long, sig long, data binary"
    of_page = table.groupBy("page")
    lists = of_page.cogroup(copies.groupBy("page")).applyInArrow(listed, blobs)
    marks = lists.groupBy("bucket").applyInArrow(counted, notes)
    suffixes = of_page.cogroup(copies.unionAll(marks).groupBy("page")).applyInArrow(sent, blobs)
    found = suffixes.groupBy("bucket").applyInArrow(compared, notes)
    out = of_page.cogroup(copies.unionAll(found).groupBy("page")).applyInArrow(cleaned, "doc_id long, sig long, n_bytes long, spans array<struct<a: long, b: long>>, kept binary")
    if again.limit(1).count():
        out = out.join(again, ["doc_id", "sig"], "left").withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    return out.select("doc_id", "n_bytes", "spans", "kept").unionAll(rows.where(F.col("doc_id").isNull()).select("doc_id", size.cast("long"), none, "text"))


def op2_suffix_sorted_dedup(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return packed(dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k
      FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM m)),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, k),
found AS (SELECT r, sum(b - a) AS removed, count(*) AS n, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY r)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, n + 1), lambda k:
         substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1, 2 * ((CASE WHEN k = n THEN length(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE b[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN found ON d.r = found.r
"""
