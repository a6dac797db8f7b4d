import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kestrelgrid.llm import quality_gam as gam
from kestrelgrid.llm import quality_llr as llr
from kestrelgrid.llm import queries

from .cases import documents

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_classifier_on_rows_it_has_not_seen(spark, truth):
    rows = queries.op8_quality_gam(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    seen = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good = [p for y, p in seen if y == 1]
    assert np.mean(good) >= 0.97
    assert np.mean([y == p for y, p in seen]) >= 0.95


def test_scores_ignore_labels_of_held_out_rows_and_other_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.select("doc_id", (1 - labels.quality).alias("quality")).where(gam.held_out()).unionByName(labels.where(~gam.held_out()).select("doc_id", "quality"))
    score = lambda d, l: {r.doc_id: r.score for r in gam.score_documents(d, l).collect()}  # noqa: E731, E741
    assert score(docs, labels) == score(docs.drop("lang", "source"), flipped)


def test_classifier_on_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    df = documents(spark)
    assert gam.score_documents(df, labels).count() == df.count()
    none = gam.score_documents(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert gam.score_documents(df.limit(0), labels).count() == 0
    kept = gam.keep_predicted(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == df.count()


def test_tables_add_up_to_the_trees():
    """A pair's effect that no single feature shows is learned."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x[:2000], y[:2000])
    assert (0, 1) in [(i, j) for i, j, _ in m.pairs]
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def plain_features(text):
    words, counts = re.findall(r"[^\x20\x09-\x0D]+", text), plain_counts(text)
    w, c, lines = max(len(words), 1), max(counts[1], 1), text.count("\n") + 1
    of = lambda chars: len(re.findall(chars, text))
    upper, lower, size = of("[A-Z]"), of("[a-z]"), len(text.encode())
    tail = text.rstrip(" \t\n\r\x0b\x0c")
    return [
        np.log1p(len(words)), counts[1] / w, counts[2] / c, upper / max(upper + lower, 1), of("[0-9]") / c, of(r"[.,;:?\"'()\-]") / c, of(r"\|") / w, of("!") / w,
        counts[3] / lines, counts[4] / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, np.log1p(len(words) / lines),
        1 - sum(ord(ch) < 128 for ch in text) / max(size, 1), sum(len(x.encode()) < 4 for x in words) / w, float(tail[-1:] in (".", "!", "?")),
    ]


@pytest.mark.parametrize("text", ["", " \n ", "a", "A b! c? (1) |x|\nnaïve 日本 the end.\n", "w w w\nw w w\n", "É!"])
def test_features_equal_a_plain_version(text):
    assert gam.features(text) == pytest.approx(plain_features(text), abs=1e-12)


def plain_fit(x, y):
    """Trees one after the other, each a list of (feature bins, value); a function that adds them up for a row."""
    n, width = x.shape
    cuts = [sorted(set(np.quantile(x[:, j], [k / gam.BINS for k in range(1, gam.BINS)]).tolist())) for j in range(width)]
    pair_cuts = [sorted(set(np.quantile(x[:, j], [k / gam.PAIR_BINS for k in range(1, gam.PAIR_BINS)]).tolist())) for j in range(width)]
    place = lambda c, v: sum(b <= v for b in c)
    share = (sum(y) + 1) / (n + 2)
    base, trees = float(np.log(share / (1 - share))), []
    one = [[place(cuts[j], r[j]) for j in range(width)] for r in x]
    two = [[place(pair_cuts[j], r[j]) for j in range(width)] for r in x]
    value = lambda t, a, b: t[1][a[t[0]]] if isinstance(t[0], int) else t[1][b[t[0][0]] > t[2][0], b[t[0][1]] > t[2][1]]
    total = [base] * n
    gain = lambda rows: sum(p - v for p, v in rows) ** 2 / (sum(p * (1 - p) for p, _ in rows) + gam.L2)
    leaf = lambda rows: -gam.RATE * sum(p - v for p, v in rows) / (sum(p * (1 - p) for p, _ in rows) + gam.L2)

    def add(t):
        trees.append(t)
        for i in range(n):
            total[i] += value(t, one[i], two[i])

    def now():
        return [(1 / (1 + np.exp(-s)), v) for s, v in zip(total, y, strict=True)]

    for _ in range(gam.ROUNDS):
        for j in range(width):
            rows, size = now(), len(cuts[j]) + 1
            part = lambda a, b: [r for r, at in zip(rows, one, strict=True) if a <= at[j] < b]  # noqa: B023, E731
            edges = [0, size]
            for _ in range(gam.CUTS):
                best = (1e-9, 0)
                for a, b in zip(edges, edges[1:], strict=False):
                    found = [(gain(part(a, k)) + gain(part(k, b)) - gain(part(a, b)), -k) for k in range(a + 1, b)]
                    if found and max(found)[0] > best[0]:
                        best = (max(found)[0], -max(found)[1])
                if not best[1]:
                    break
                edges = sorted([*edges, best[1]])
            add((j, [leaf(part(max(e for e in edges if e <= k), min(e for e in edges if e > k))) for k in range(size)]))

    def pair(i, j):
        rows, best = now(), (0.0, None)
        for a in range(len(pair_cuts[i])):
            for b in range(len(pair_cuts[j])):
                quads = {(p, q): [r for r, at in zip(rows, two, strict=True) if ((at[i] > a), (at[j] > b)) == (p, q)] for p in (False, True) for q in (False, True)}
                g = sum(map(gain, quads.values())) - gain(rows)
                if best[1] is None or g > best[0] + 1e-12:
                    best = (g, ((i, j), {k: leaf(v) for k, v in quads.items()}, (a, b)))
        return best

    ranked = sorted(((pair(i, j)[0], i, j) for i in range(width) for j in range(i + 1, width)), key=lambda r: (-r[0], r[1], r[2]))[: gam.PAIRS]
    for _ in range(gam.PAIR_ROUNDS):
        for _, i, j in ranked:
            add(pair(i, j)[1])

    def score(row):
        a, b = [place(c, v) for c, v in zip(cuts, row, strict=True)], [place(c, v) for c, v in zip(pair_cuts, row, strict=True)]
        return 1 / (1 + np.exp(-base - sum(value(t, a, b) for t in trees)))

    return score


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_lookup_tables_equal_the_sum_of_plainly_boosted_trees(monkeypatch, seed):
    for name, v in {"BINS": 6, "PAIR_BINS": 4, "ROUNDS": 4, "PAIR_ROUNDS": 3, "PAIRS": 2}.items():
        monkeypatch.setattr(gam, name, v)
    rng = np.random.default_rng(seed)
    x = rng.random((90, 4)).round(2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 90)) > 0.8).astype(float)
    plain = plain_fit(x, y)
    assert gam.fit(x, y).score(x) == pytest.approx([plain(r) for r in x], abs=1e-9)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", ["", " \n ", "a", "a a a", "a a a a", "é ß\x0b# x y\x85z", "x\nx\n\n \nx\r\nx\r\n", "a b c d a b c e a b c", "1 2 3 " * 9])
def test_base_counts(text):
    assert llr.base_counts(text) == plain_counts(text)


def test_query_equals_a_plain_version(spark, truth):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = {d for d, q in truth.items() if q == 1}

    def grams(t):
        b = b" ".join(t.encode().split())
        out = []
        for i in range(len(b) - llr.N + 1):
            h = 0
            for c in b[i : i + llr.N]:
                h = (h ^ c) * 0x01000193 % (1 << 32)
            h = (h ^ h >> 15) * 0x85EBCA6B % (1 << 32)
            out.append(h >> 16)
        return out

    few = dict(list(texts.items())[:40])
    for t in few.values():
        assert grams(t) == llr.ngram_buckets(t.encode()).tolist()
    raw, target = np.zeros(llr.BUCKETS), np.zeros(llr.BUCKETS)
    for d, t in texts.items():
        c = np.bincount(llr.ngram_buckets(t.encode()), minlength=llr.BUCKETS)
        raw += c
        target += c if d in good else 0
    p = lambda c: np.log((c + llr.SMOOTH) / (c.sum() + llr.SMOOTH * llr.BUCKETS))
    table = p(target) - p(raw)
    for r in queries.op9_quality_llr(spark, DATA).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.llr == pytest.approx(llr.score(t, table), abs=1e-12)
        assert r.kept == (not r.base_failed and r.llr >= llr.THRESHOLD)
        if truth.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept


def test_rules_on_hard_rows(spark):
    df = documents(spark)
    trusted = spark.createDataFrame([(1,), (None,), (1,), (77,)], "doc_id long")
    got = llr.judge(df, trusted).collect()
    assert len(got) == df.count()
    assert {r.llr for r in llr.judge(df, trusted.limit(0)).collect()} == {0.0}
    assert llr.judge(df.limit(0), trusted).count() == 0
    kept = llr.keep_good(df, trusted)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_a_full_sieve_still_gives_exactly_the_trusted_rows(spark, monkeypatch):
    monkeypatch.setattr(llr, "SIEVE", 64)
    df = documents(spark)
    trusted = spark.createDataFrame([(5,), (7,)], "doc_id long")
    assert llr.trusted_rows(df, trusted, "doc_id", "text").count() == 3
