import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tarn.llm import chunks, simhash, suffixes
from tarn.llm.components import components


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def removed(rows):
    """What op2 asks for, string by string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    mask[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("page", [1 << 23, 3000])
def test_suffix_dedup(spark, odd, monkeypatch, page):
    monkeypatch.setattr(suffixes, "PAGE", page)
    got = [(r["doc_id"], r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.dedup(odd).collect()]
    assert sorted(got, key=str) == removed(rows_of(odd))
    assert sum(g[2] for g in got) > 1000


def test_rows_of_one_id_keep_their_own_spans(spark):
    """Texts under one id that share nothing lose nothing of each other's, whatever their characters."""
    r = np.random.default_rng(12)
    letters = lambda n, low: "".join(map(chr, r.integers(low, low + 200, n)))
    passage, b, c = letters(500, 0x3B1), letters(700, 0xC0), letters(337, 0x4E00)
    rows = [(1, passage), (5, passage + c), (5, b), (5, b), (5, None), (5, ""), (7, c + b), (7, letters(90, 0x61) + passage[:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x["doc_id"], x["n_bytes"], sum(s["b"] - s["a"] for s in x["spans"]), len(x["spans"]), hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffixes.dedup(df).collect()]
    assert sorted(got, key=str) == removed(rows)
    chunked = [(x["doc_id"], x["text"], x["dedup"]["n_bytes"], x["dedup"]["n_removed"], x["dedup"]["n_spans"]) for x in chunks.dedup(df).collect()]
    assert sorted(chunked, key=str) == plain_chunk_dedup(rows, chunks.Cuts())
    assert [(t, n) for _, t, _, n, _ in chunked if t == b] == [(b, 0)] * 2


def test_suffix_dedup_of_nothing(empty):
    assert suffixes.dedup(empty).count() == 0


def test_anchors_depend_on_the_string_alone(monkeypatch):
    r = np.random.default_rng(3)
    text = bytes(r.integers(97, 101, 4000, np.uint8))

    def places(slices):
        out = {}
        for d, begin, a in slices:
            for p, o, low, high in zip(a.anchor, a.owner, a.low, a.high, strict=True):
                for i in range(low, high + 1):
                    key = (int(d[o]), int(begin[o] + i - a.base[o]))
                    assert key not in out
                    out[key] = int(p - i)
        return out

    whole = places(suffixes._split([text, text[1000:2500]]))
    monkeypatch.setattr(suffixes, "SLICE", 700)  # a long text in slices: the same strings, each once
    assert places(suffixes._split([text, text[1000:2500]])) == whole
    assert len(whole) == 4000 - 49 + 1500 - 49
    assert all(whole[1, i] == whole[0, 1000 + i] for i in range(1500 - 49))


def test_multikey_order():
    r = np.random.default_rng(5)
    keys = r.integers(0, 3, (500, 4), np.uint64)
    order, shared = suffixes.multikey_order(lambda rows, j: keys[rows, j], 500, 4)
    listed = keys[order].tolist()
    assert listed == sorted(keys.tolist())
    for a, b, n in zip(listed, listed[1:], shared[1:], strict=False):
        assert n == next((k for k in range(4) if a[k] != b[k]), 4)


def plain_fingerprint(text, width=4):
    w = [x for x in (text or "").encode().translate(simhash.LOWER).split()]
    if not w:
        return 0
    count = [0] * 64
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def plain_components(fps, most):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = list(parent)
    for i, a in enumerate(known):
        for b in known[:i]:
            if bin(a ^ b).count("1") <= most:
                parent[find(a)] = find(b)
    return {f: find(f) for f in known}


@pytest.mark.parametrize(("width", "most"), [(4, 4), (5, 6)])
def test_near_duplicates(odd, width, most):
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(odd, width, most).collect()]
    rows = rows_of(odd)
    roots = plain_components({plain_fingerprint(t, width) for _, t in rows}, most)
    smallest = defaultdict(list)
    for i, t in rows:
        if i is not None:
            smallest[roots[plain_fingerprint(t, width)]].append(i)
    want = [(i, f := plain_fingerprint(t, width), min(smallest[roots[f]])) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_links_keep_all_components(spark, monkeypatch):
    """Dense balls of fingerprints, with keys that must be split."""
    monkeypatch.setattr(simhash, "HALF", 20)
    r = np.random.default_rng(2)
    fps = {int(x) for x in r.integers(0, 2**64, 300, np.uint64)}
    for c in list(fps)[:3]:
        fps |= {c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (120, 2))}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "node long, fp long")
    links = simhash.links(df, 4)
    assert links.count() < 20_000
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in components(links).collect()}
    want = plain_components(fps, 4)
    groups = lambda roots: sorted(sorted(g) for g in _groups(roots).values())
    assert groups({f: got.get(f, f) for f in fps}) == groups(want)


def _groups(roots):
    out = defaultdict(list)
    for k, v in roots.items():
        out[v].append(k)
    return out


def test_components_of_paths_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100), (7, 3), (200, 201), (201, 200), (None, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_cover_and_resist_insertions():
    r = np.random.default_rng(1)
    words = ["".join(map(chr, r.integers(97, 123, r.integers(1, 9)))) for _ in range(3000)]
    a = " ".join(words).encode()
    b = " ".join([*words[:50], "something", "new", *words[50:]]).encode()
    cuts = chunks.Cuts()
    parts = [[t[x:y] for _, x, y in chunks.cut([t], cuts)] for t in (a, b)]
    assert b"".join(parts[0]) == a and b"".join(parts[1]) == b
    assert len(set(parts[0]) ^ set(parts[1])) < 8
    assert all(len(p) <= cuts.largest + 3 for p in parts[0])
    assert [x for x in chunks.cut([b"", b"ab"], cuts)] == [(1, 0, 2)]
    long = "é".encode() * 3000
    assert b"".join(long[x:y].decode().encode() for _, x, y in chunks.cut([long], cuts)) == long


def plain_cuts(text, cuts):
    """The chunks of one text, byte by byte."""
    table, n = np.random.default_rng(cuts.seed).integers(0, 1 << 16, 256, np.uint16).tolist(), len(text)

    def zero(end, bits):  # the rolling hash after byte end - 1, of the batch's last 16 bytes
        h = 0
        for c in text[max(0, end - 16) : end]:
            h = (2 * h + table[c]) % 65536
        return h >> (16 - bits) == 0

    space = b" \t\n\x0b\x0c\r"
    words = [p for p in range(1, n) if text[p - 1] in space and text[p] not in space and zero(p, cuts.bits)]
    points = list(words)
    for a, b in zip([0, *words], [*words, n], strict=True):
        if b - a > cuts.gap:
            points += [p for p in range(a + 1, b) if text[p] & 0xC0 != 0x80 and zero(p, cuts.tight_bits)]
    out, start = [], 0
    for p in [*sorted(set(points)), n]:
        while p - start > cuts.largest:
            end = start + cuts.largest
            while end < p and text[end] & 0xC0 == 0x80:
                end += 1
            out.append((start, end))
            start = end
        if start < p and (p - start >= cuts.smallest or p == n):
            out.append((start, p))
            start = p
    return out


def plain_chunk_dedup(rows, cuts):
    """(id, text, bytes, removed, runs): what is left of each text, found with dictionaries of whole chunks."""
    texts = [(t or "").encode() for _, t in rows]
    parts = [plain_cuts(t, cuts) for t in texts]
    owner = {}
    for (i, _), t, own in zip(rows, texts, parts, strict=True):
        if i is not None:
            for a, b in own:
                owner[t[a:b]] = min(owner.get(t[a:b], i), i)
    out = []
    for (i, text), t, own in zip(rows, texts, parts, strict=True):
        gone = bytearray(len(t))
        if i is not None:
            for a, b in own:
                if owner[t[a:b]] < i:
                    gone[a:b] = b"\1" * (b - a)
        runs, a = [], 0
        while a < len(t):
            b = a
            while b < len(t) and gone[b] == gone[a]:
                b += 1
            if gone[a] and b - a >= cuts.least_run:
                runs.append((a, b))
            a = b
        left = b"".join(t[k : k + 1] for k in range(len(t)) if not any(a <= k < b for a, b in runs)) if runs else t
        out.append((i, None if text is None else left.decode(), len(t), sum(b - a for a, b in runs), len(runs)))
    return sorted(out, key=str)


def test_cuts_equal_the_rules():
    r = np.random.default_rng(9)
    for text in [bytes(r.choice(list(b"abc  "), 1500)), "日本語の文字列は続く。".encode() * 60, bytes(r.integers(97, 123, 3000, np.uint8)), b"x" * 3000, b"ab " * 300, b"", b"a"]:
        assert [(a, b) for _, a, b in chunks.cut([text])] == plain_cuts(text, chunks.Cuts())


def test_unspaced_passages_are_found(spark):
    r = np.random.default_rng(10)
    letters = [chr(c) for c in range(0x4E00, 0x4F00)]
    passage = "".join(r.choice(letters, 600))
    rows = [(k, "".join(r.choice(letters, 200 + 37 * k)) + passage + "".join(r.choice(letters, 300))) for k in range(4)]
    got = {x["doc_id"]: x["dedup"]["n_removed"] for x in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[k] > 0.7 * 1800 for k in (1, 2, 3))


def test_chunk_dedup(odd):
    want = plain_chunk_dedup(rows_of(odd), chunks.Cuts())
    got = [(r["doc_id"], r["text"], r["dedup"]["n_bytes"], r["dedup"]["n_removed"], r["dedup"]["n_spans"]) for r in chunks.dedup(odd).collect()]
    assert sorted(got, key=str) == want
    assert sum(w[3] for w in want) > 1000


def test_chunk_dedup_of_the_corpus(spark, data):
    rows = [(i, t) for i, t in rows_of(spark.read.parquet(f"{data}/documents.parquet"))]
    got = [(r["doc_id"], r["text"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in chunks.op8_gear_chunk_dedup(spark, data).collect()]
    assert sorted(got, key=str) == plain_chunk_dedup(rows, chunks.Cuts())


def test_chunk_dedup_keeps_columns(spark, odd, empty):
    out = chunks.dedup(odd)
    assert out.columns == [*odd.columns, "dedup"]
    assert sorted(map(str, out.drop("dedup", "text").collect())) == sorted(map(str, odd.drop("text").collect()))
    assert chunks.dedup(empty).count() == 0
    row = spark.createDataFrame([(1, "some text", 7, "x", 8, "y")], "doc_id long, text string, n_bytes long, __repeats_of string, row int, dedup string")
    got = chunks.dedup(row).first()
    assert got.asDict()["n_bytes"] == 7 and got["__repeats_of"] == "x" and got["dedup"] == "y" and got["dedup_"]["n_bytes"] == 9
