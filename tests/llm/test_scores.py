import itertools
import math
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from tarn.llm import classifier, ctw, pieces
from tarn.llm.common import documents


def test_base_scores(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
    n = sum(c.values())
    want = sorted((str(i), h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w), 6)) for (i, _), h, w in zip(rows, held, tokens, strict=True))
    got = ctw.score(odd).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["code_length"] > 0 for r in got)


def test_rare_tokens_are_joined(odd, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6), r["score"]) for r in ctw.score(odd).collect()}
    monkeypatch.setattr(ctw, "COMMON", 3)
    got = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6), r["score"]) for r in ctw.score(odd).collect()}
    assert got == want


def test_scores_of_nothing(empty):
    assert ctw.score(empty).count() == 0


def plain_tree(texts, depth):
    """Context-tree weighting straight from its definition: a recursion over suffixes, for each binary node."""
    counts = Counter()
    for t in texts:
        b = b"\n" * depth + t + b"\n"
        for p in range(depth, len(b)):
            for k in range(8):
                prefix = (1 << k) | (b[p] >> (8 - k))
                for d in range(depth + 1):
                    counts[b[p - d : p], prefix, b[p] >> (7 - k) & 1] += 1

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    contexts = {c for c, _, _ in counts}
    kids = {c: [x for x in contexts if len(x) == len(c) + 1 and x.endswith(c)] for c in contexts}
    memo = {}

    def weighted(c, prefix):
        if (c, prefix) not in memo:
            own = kt(counts[c, prefix, 0], counts[c, prefix, 1])
            if len(c) < depth:
                split = sum(weighted(x, prefix)[0] for x in kids[c])
                both = np.logaddexp(own, split) - math.log(2)
                memo[c, prefix] = (both, math.exp(own - math.log(2) - both))
            else:
                memo[c, prefix] = (own, 1.0)
        return memo[c, prefix]

    def one(history, prefix):
        total, left = 0.0, 1.0
        for d in range(depth + 1):
            c = history[len(history) - d :]
            if c not in contexts:
                return total + left * 0.5
            w = weighted(c, prefix)[1]
            total += left * w * (counts[c, prefix, 1] + 0.5) / (counts[c, prefix, 0] + counts[c, prefix, 1] + 1)
            left *= 1 - w
        return total

    def score(t):
        b, s = b"\n" * depth + t + b"\n", 0.0
        for p in range(depth, len(b)):
            for k in range(8):
                q = one(b[p - depth : p], (1 << k) | (b[p] >> (8 - k)))
                s += math.log10(q if b[p] >> (7 - k) & 1 else 1 - q)
        return s

    return score


def fitted(texts, depth):
    g, n = np.unique(ctw._grams(texts, depth), return_counts=True)
    level, context, symbol, count = [], [], [], []
    for d in range(depth + 1):
        for (c, s), k in _summed(g, n, d).items():
            level.append(d)
            context.append(c)
            symbol.append(s)
            count.append(k)
    return ctw.ContextTree.fit(depth, np.array(level), np.array(context, np.uint64), np.array(symbol), np.array(count, float))


def _summed(g, n, d):
    out = Counter()
    for x, k in zip(g.tolist(), n.tolist(), strict=True):
        out[(x >> 8) & ((1 << 8 * d) - 1), x & 255] += k
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_equals_the_definition(depth):
    texts = [b"abra cadabra", b"abracadabra abra", b"", b"cab"]
    tree, plain = fitted(texts, depth), plain_tree(texts, depth)
    for t in (b"abra", b"zebra cab", b"", "é".encode(), b"aaaa aaaa"):
        assert tree.score([t])[0] == pytest.approx(plain(t), rel=1e-5)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_scores_equal_the_definition(spark, depth):
    """The whole operator, over held-out and training rows, against the recursion."""
    rows = [(k, t) for k, t in enumerate(["abra cadabra", "Abracadabra  abra", "", None, "cab ab", "the cat sat", "é über", "a\nb\tc", "abra cadabra", "cat cab abra", "zz top", "a", "b a b a", "no"])]
    joined = {i: b" ".join(ctw.tokens((t or "").encode())) for i, t in rows}
    train = [x for i, x in joined.items() if zlib.crc32(str(i).encode()) % 10]
    assert len(train) < len(rows)
    plain = plain_tree(train, depth)
    for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), depth).collect():
        assert r["score"] == pytest.approx(plain(joined[r["doc_id"]]), rel=1e-6)
        assert r["code_length"] == pytest.approx(-plain(joined[r["doc_id"]]) * math.log2(10) / (len(joined[r["doc_id"]]) + 1), rel=1e-6)


def test_tree_is_a_distribution():
    tree = fitted([b"the cat sat on the mat", b"a cat"], 3)
    np.testing.assert_allclose((10.0 ** tree.log10.astype(float)).sum(axis=1), 1, rtol=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e6])
    np.testing.assert_allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-11)


def test_tree_beats_the_base_on_held_out_text(spark):
    rows = ctw.score(documents(spark, "/root/testdata/sf0.01")).where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()


def test_classifier_on_held_out_rows(spark):
    rows = classifier.op3_additive_quality(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").rename(columns={"quality": "label"})
    both = rows.merge(labels, on="doc_id")
    assert classifier.held_out_auc(both) > 0.97
    assert (both["predicted"] == both["label"]).mean() > 0.95


def test_classifier_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 1), (7, 0), (999, 1)], "doc_id long, quality int")
    model = classifier.train(odd, labels)
    rows = classifier.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.score(empty, model).count() == 0
    blank = classifier.train(odd, labels.limit(0))
    assert {r["score"] for r in classifier.score(odd, blank).collect()} == {0.5}
    assert [r["score"] for r in classifier.score(odd, classifier.train(odd, labels)).orderBy("doc_id", "score").collect()] == [r["score"] for r in classifier.score(odd, model).orderBy("doc_id", "score").collect()]


def plain_features(text):
    """The features by their meaning, with strings and loops."""
    b = (text or "").encode()
    w = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", b) if x]
    if not w:
        return dict.fromkeys(classifier.FEATURES, 0.0)
    n, size = len(w), len(b)
    count = lambda chars: sum(b.count(bytes([x])) for x in chars)
    upper, lower = sum(65 <= x <= 90 for x in b), sum(97 <= x <= 122 for x in b)
    lines = [x for x in b.split(b"\n") if x.strip()]
    mean = sum(map(len, w)) / n
    marks = set(b"!#$%&*+/<=>@\\^_`{|}~")
    return {
        "log_words": math.log(1 + n), "word_bytes": mean, "upper": upper / max(1, upper + lower), "digits": sum(48 <= x <= 57 for x in b) / size,
        "symbols": count(b"#*$%&<>") / n, "bangs": count(b"!") / n, "bars": count(b"|") / n, "ends": count(b".?") / n, "commas": count(b",") / n,
        "distinct": len(set(w)) / n, "echoes": sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, "top_word": max(Counter(w).values()) / n,
        "same_lines": 1 - len(set(lines)) / len(lines), "line_words": n / len(lines), "ended_lines": sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        "beyond_ascii": sum(x > 127 for x in b) / size, "short_words": sum(len(x) <= 3 for x in w) / n, "marked_words": sum(x[-1] in marks for x in w) / n,
        "deviation": math.sqrt(sum((len(x) - mean) ** 2 for x in w) / n),
    }


def test_scores_equal_plain_sums(spark, odd):
    """Every document's score from its text and the model's tables, term by term."""
    docs = documents(spark, "/root/testdata/sf0.001")
    model = classifier.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for rows in (docs, odd):
        texts = sorted(((str(r["doc_id"]), r["text"]) for r in rows.select("doc_id", "text").collect()), key=str)
        want = []
        for i, t in texts:
            x = plain_features(t)
            # A value on an edge may round to either side of it: both scores are right then, no other.
            near = [{sum(e <= x[f] + d for e in edges) for d in (1e-12, -1e-12)} for f, edges in zip(classifier.FEATURES, model.edges, strict=True)]
            both = []
            for at in itertools.islice(itertools.product(*near), 1 << 14):
                total = model.base + sum(table[k] for table, k in zip(model.single, at, strict=True)) + sum(table[at[f], at[g]] for f, g, table in model.pairs)
                both.append(1 / (1 + math.exp(-total)))
            want.append((i, t or "", both))
        left = Counter()
        for r in classifier.score(rows, model).collect():
            left[str(r["doc_id"])] += 1
            assert any(abs(r["score"] - s) < 1e-9 for i, _, both in want if i == str(r["doc_id"]) for s in both)
        assert left == Counter(i for i, _, _ in want)


def test_each_tree_is_the_best_step():
    """Two leaves: the cut of the greatest gain among all; four: each further cut the best of what is left."""
    r = np.random.default_rng(3)
    g, h = r.normal(size=12), r.random(12) + 0.1
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    m = max(range(1, 12), key=lambda k: worth(0, k) + worth(k, 12))
    want = np.concatenate((np.full(m, g[:m].sum() / (h[:m].sum() + 1)), np.full(12 - m, g[m:].sum() / (h[m:].sum() + 1))))
    np.testing.assert_allclose(classifier._steps(g, h, 2), want)
    assert len(set(classifier._steps(g, h, 4))) == 4


def test_scores_are_sums_of_tables():
    r = np.random.default_rng(0)
    x = r.random((400, len(classifier.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair can tell
    model = classifier.fit(x, y)
    assert model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    b = model.bins(x[:1])[0]
    total = model.base + sum(t[k] for t, k in zip(model.single, b, strict=True)) + sum(t[b[f], b[g]] for f, g, t in model.pairs)
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_ids_equal_the_library(spark, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]  # an id may have several texts
    encoded = pieces.encode(odd)
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["exact"]) for r in encoded.collect()) == sorted((str(i), model.encode(t), "▁" not in t) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(encoded).collect()) == sorted((str(i), t.replace("▁", " ")) for i, t in rows)


def test_ids_on_corpus(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pieces.encode(docs).collect():
        assert r["ids"] == model.encode(rows[r["doc_id"]]) and r["exact"]


def test_small_indexes_and_long_units(monkeypatch):
    monkeypatch.setattr(pieces, "INDEXED", 40)
    monkeypatch.setattr(pieces, "LONG", 5)
    encoder, model = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL)), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["portioning the eding", "aaaaaaaaaaaa", "   spaces    x", "𝔘𝔫😀", "", "a\n\nb", "<0x41><s>"]
    assert [x.tolist() for x in encoder.encode(texts)] == [model.encode(t) for t in texts]


def test_windows_of_a_long_unit(monkeypatch):
    monkeypatch.setattr(pieces, "INDEXED", 60)
    encoder, model = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL)), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/")
    texts = ["".join(r.choice(letters, 2000)), "日本語の文字列" * 40, "a" * 500, "ab" * 300 + "".join(r.choice(letters, 300)), "x" * 100 + " word " + "".join(r.choice(letters, 500)) + " end"]
    assert [x.tolist() for x in encoder.encode(texts)] == [model.encode(t) for t in texts]


def test_long_repeats_equal_the_library(monkeypatch):
    """Repeats of one to many characters, with and without neighbours, at all remainders of their cycle."""
    monkeypatch.setattr(pieces, "INDEXED", 3000)
    monkeypatch.setattr(pieces, "RUN", 1500)
    monkeypatch.setattr(pieces, "AROUND", 400)
    encoder, model = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL)), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    shortened, windows = [], encoder._windows
    monkeypatch.setattr(encoder, "_windows", lambda u: shortened.append(len(u)) or windows(u))
    texts = [c * (9000 + k) for k, c in enumerate(["a", "ab", "the", "=", "-", "haha", "0", "é", "日本", "x1"])] + ["a" * n for n in range(7000, 7040)]
    texts += ["start" + "a" * 8000 + "end", "q" * 7001 + "ing" * 3000 + "zz", "word " + "-" * 9001 + " and " + "=" * 7000, " " * 9000 + "x", "z" * 20 + "😀" * 4000 + "lol" * 3000]
    assert [x.tolist() for x in encoder.encode(texts)] == [model.encode(t) for t in texts]
    assert sum(n < 5000 for n in shortened) > len(shortened) * 0.8


def test_memory_of_a_long_unit():
    """Four million characters without a space, in a process of its own: the index never holds more than a window."""
    code = """
import resource, sys
import numpy as np
from tarn.llm import pieces
encoder = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL))
encoder.encode(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = np.random.default_rng(1).integers(97, 123, 4_000_000, np.uint8).tobytes().decode()
for text in (text, "a" * 20_000_000, "ab-" * 2_000_000 + "c" * 5_000_000):
    ids = encoder.encode([text])[0]
    assert pieces.Decoder(encoder.v).decode(ids.tolist()) == text
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert grown < 800


def test_pieces_of_nothing(empty):
    assert pieces.encode(empty).count() == 0


def test_the_bound_holds_where_one_id_has_many_texts(spark, monkeypatch):
    """At most `bound` rows reach the fit, whatever the ids."""
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda x, y, **_: seen.append(len(x)))
    docs = spark.createDataFrame([(i if i < 40 else 1, f"some words of text number {i}.") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for bound in (10, 3, 1000):
        classifier.train(docs, labels, bound)
    assert seen[0] <= 10 and seen[1] <= 3 and seen[2] > 200


def plain_boosting(x, y, rounds, pair_rounds, pairs, bins, rate, leaves):
    """The whole fit row by row: (base, single tables, pairs with their tables)."""
    n, width = len(x), len(x[0])
    edges = [sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(width)]
    at = [[sum(e <= r[f] for e in edges[f]) for f in range(width)] for r in x]
    p = (sum(y) + 1) / (n + 2)
    base = math.log(p / (1 - p))
    margin = [base] * n
    single = [[0.0] * (len(e) + 1) for e in edges]
    value = lambda rows, slope: (sum(slope[i][0] for i in rows), sum(slope[i][1] for i in rows))
    worth = lambda s: s[0] ** 2 / (s[1] + 1)
    newton = lambda s: s[0] / (s[1] + 1)

    def slopes():
        q = [1 / (1 + math.exp(-m)) for m in margin]
        return [(t - v, v * (1 - v)) for t, v in zip(y, q, strict=True)]

    for _ in range(rounds):
        for f in range(width):
            s, parts = slopes(), [(0, len(single[f]))]
            own = lambda a, b, f=f: [i for i in range(n) if a <= at[i][f] < b]
            while len(parts) < leaves:
                best, cut = 1e-9, None
                for k, (a, b) in enumerate(parts):
                    for m in range(a + 1, b):
                        gain = worth(value(own(a, m), s)) + worth(value(own(m, b), s)) - worth(value(own(a, b), s))
                        if gain > best + 1e-12:
                            best, cut = gain, (k, m)
                if not cut:
                    break
                k, m = cut
                parts[k : k + 1] = [(parts[k][0], m), (m, parts[k][1])]
            for a, b in parts:
                step = rate * newton(value(own(a, b), s))
                for m in range(a, b):
                    single[f][m] += step
                for i in own(a, b):
                    margin[i] += step

    def quadrants(f, k, s):
        best = (-1.0, None)
        for i in range(1, len(single[f])):
            for j in range(1, len(single[k])):
                four = [[r for r in range(n) if (at[r][f] < i) == top and (at[r][k] < j) == left] for top in (True, False) for left in (True, False)]
                gain = sum(worth(value(rows, s)) for rows in four)
                if gain > best[0] + 1e-12:
                    best = gain, (i, j, [newton(value(rows, s)) for rows in four])
        return best

    s = slopes()
    chosen = sorted(((quadrants(f, k, s)[0], f, k) for f in range(width) for k in range(f)), reverse=True)[:pairs]
    tables = [(f, k, np.zeros((len(single[f]), len(single[k])))) for _, f, k in chosen]
    for _ in range(pair_rounds):
        for f, k, table in tables:
            i, j, v = quadrants(f, k, slopes())[1]
            for a in range(len(single[f])):
                for b in range(len(single[k])):
                    table[a, b] += rate * v[(a >= i) * 2 + (b >= j)]
            for r in range(n):
                margin[r] += rate * v[(at[r][f] >= i) * 2 + (at[r][k] >= j)]
    return base, single, tables


def test_the_whole_fit_equals_plain_boosting():
    r = np.random.default_rng(11)
    x = r.random((60, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * r.random(60)) > 0.8).astype(float)
    options = dict(rounds=5, pair_rounds=3, pairs=2, bins=6, rate=0.3, leaves=3)
    model, (base, single, tables) = classifier.fit(x, y, **options), plain_boosting(x.tolist(), y.tolist(), **options)
    assert model.base == pytest.approx(base)
    for mine, want in zip(model.single, single, strict=True):
        np.testing.assert_allclose(mine, want, atol=1e-9)
    assert [(f, k) for f, k, _ in model.pairs] == [(f, k) for f, k, _ in tables]
    for (_, _, mine), (_, _, want) in zip(model.pairs, tables, strict=True):
        np.testing.assert_allclose(mine, want, atol=1e-9)
