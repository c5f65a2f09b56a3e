import random

import numpy as np

import corpus_pipeline
from tarn.llm import shingles, simhash


def plain_shingles(text, width=5):
    w = (text or "").encode().translate(simhash.LOWER).split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_kept(rows):
    """The smallest id of each component of the graph of all pairs of similarity 0.8 or more; and those pairs."""
    sets, root, pairs = {i: plain_shingles(t) for i, t in rows}, {i: i for i, _ in rows}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(sets)
    for k, a in enumerate(known):
        for b in known[:k]:
            s, t = sets[a], sets[b]
            if s == t or 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                pairs.append((a, b))
    return {i for i in known if find(i) == i}, pairs


def edited(r, words, edits):
    w = list(words)
    for k in r.sample(range(len(w)), edits):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_stage_finds_all_pairs_of_similarity_4_5(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HALF", 12)  # groups in parts
    monkeypatch.setattr(shingles, "HELD", 20)
    r, texts = random.Random(4), []
    licence = " ".join(f"w{r.randrange(500)}" for _ in range(60))
    for _ in range(12):
        words = [f"w{r.randrange(500)}" for _ in range(r.randint(100, 300))]
        texts += [" ".join(words), " ".join(words) + " " + licence, *(edited(r, words, e) for e in (1, 3, 4, 5, 6, 9, 15))]
    texts += [licence, licence, "one", "ONE", "in " * 700, "in " * 300, "", None]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0], (None, texts[0])], "doc_id long, text string")
    kept, pairs = plain_kept(rows)
    got = [x["doc_id"] for x in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()]
    assert sorted(got) == sorted(kept)  # the row without an id equals a named one
    fp = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in rows}
    assert sum((fp[a] ^ fp[b]).bit_count() > 6 for a, b in pairs) > 20  # these 64-bit fingerprints lose


def test_stage_keeps_the_same_documents_as_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, _ = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, data).collect()} == kept


def test_near_copies_of_odd_rows(odd, empty):
    rows = shingles.near_copies(odd).collect()
    assert len(rows) == odd.count()
    firsts = [(r["component"], r["doc_id"], r["text_hash"]) for r in rows if r["stays"]]
    assert len({c for c, _, _ in firsts}) == len(set(firsts)) == len({r["component"] for r in rows})
    assert shingles.near_copies(empty).count() == 0 and shingles.one_of_each(empty).columns == empty.columns


def test_repeated_ids_and_rows(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, a, "x"), (3, a, "x"), (9, c, "x"), (9, c, "x"), (9, c, "y"), (None, d, "x"), (None, d, "x"), (None, a, "x")]
    got = shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, own_id string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", a), ("2", b), ("9", c), ("None", d)]


def test_small_sets_stay_within_the_bits():
    """Of pairs of similarity 0.8, whatever their size, hardly any differ in more bits than the last round takes."""
    r, beyond = np.random.default_rng(1), []
    for n in (4, 5, 8, 9, 16, 17, 33, 90, 180):
        for _ in range(60):
            h = r.integers(0, 2**64, 2 * n + 4, np.uint64)
            both = n
            x, y = 0, n // 4  # 5 * both >= 4 * (both + x + y)
            if n % 2:
                x = y // 2
                y -= x
            one, other = h[: both + x], np.concatenate((h[:both], h[both + x : both + x + y]))
            assert shingles.similar(np.sort(one), np.sort(other))
            far = np.bitwise_count(shingles.wide_fingerprint(one) ^ shingles.wide_fingerprint(other)).sum()
            beyond.append(far > shingles.ROUNDS[-1][1])
    assert np.mean(beyond) < 0.01


def test_bands_meet():
    r, met = np.random.default_rng(2), 0
    for _ in range(200):
        h = r.integers(0, 2**64, 250, np.uint64)
        met += bool(set(shingles.bands(h[:225]).tolist()) & set(shingles.bands(h[25:]).tolist()))  # similarity 0.8
    assert met >= 198


def test_forest_takes_near_pairs_first():
    a, b, far = np.array([0, 0, 1, 5]), np.array([1, 2, 2, 6]), np.array([3, 9, 1, 7])
    assert sorted(shingles.forest(a, b, far).tolist()) == [0, 2, 3]
