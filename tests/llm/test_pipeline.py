"""Each stage against a version that is written without the operator, and on hard rows."""

import bisect
import hashlib
import heapq
import re
import zlib
from collections import Counter
from math import ceil

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrelgrid.llm import mixing, queries
from kestrelgrid.llm import quality_gam as gam
from kestrelgrid.llm import quality_llr as llr

from .cases import DOCS, LONG, documents
from .test_mixing import fill
from .test_quality import plain_counts, plain_features
from .test_simhash import components, plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that each stage gave, by its name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs, _ = corpus_pipeline.materialise(f(spark, docs, DATA), name)
        out[name] = docs
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_columns_stay_until_the_last_stage(stages):
    assert [stages[n].columns for n, _ in corpus_pipeline.STAGES[:-1]] == [stages["documents"].columns] * 4


def test_classifier_equals_a_plain_version(stages, labels):
    docs = texts(stages["documents"])
    seen = sorted(d for d in docs if labels.get(d) in (0, 1) and zlib.crc32(str(d).encode()) % 5)
    model = gam.fit(np.array([plain_features(docs[d]) for d in seen]), np.array([labels[d] for d in seen], dtype=float))

    def score(text):  # row by row; tests/llm/test_quality.py holds the tables against plainly boosted trees
        x = plain_features(text)
        total = model.base + sum(t[bisect.bisect_right(c, v)] for c, t, v in zip(model.cuts, model.tables, x, strict=True))
        at = [bisect.bisect_right(c, v) for c, v in zip(model.pair_cuts, x, strict=True)]
        return 1 / (1 + np.exp(-total - sum(t[at[i], at[j]] for i, j, t in model.pairs)))

    assert ids(stages["quality_classifier"]) == Counter(d for d, t in docs.items() if score(t) >= 0.3)


def test_rules_equal_a_plain_version(stages, labels):
    docs = texts(stages["quality_classifier"])
    count = lambda some: sum((np.bincount(llr.ngram_buckets(docs[d].encode()), minlength=llr.BUCKETS) for d in some), np.zeros(llr.BUCKETS))
    p = lambda c: np.log((c + 1) / (c.sum() + llr.BUCKETS))
    ratios = p(count([d for d in docs if labels.get(d) == 1])) - p(count(docs))
    kept = []
    for d, t in docs.items():
        n, *_, repeat = plain_counts(t)
        at = llr.ngram_buckets(t.encode())
        if n >= 50 and 100 * repeat <= 50 * n and (ratios[at].mean() if len(at) else 0) >= -0.5:
            kept.append(d)
    assert ids(stages["quality_rules"]) == Counter(kept)


def test_near_dedup_equals_a_plain_version(stages):
    comps = components({d: plain(t) for d, t in texts(stages["quality_rules"]).items()})
    assert ids(stages["near_dedup"]) == Counter(set(comps.values()))


def seats_up_to(votes, n, room):
    """Sainte-Lague seat by seat, no one above its room."""
    got, queue = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v > 0 and room[i] > 0]
    heapq.heapify(queue)
    for _ in range(n):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < room[i]:
            heapq.heappush(queue, (-(votes[i] / (2 * got[i] + 1)), i))
    return got


def plain_mix(rows):
    """(key, text) of every row of the mix, from (key, text, source) with unique keys."""
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t, _ in rows}
    draw = {k: hashlib.md5(f"{mixing.SEED}|{k}".encode()).hexdigest() for k, _, _ in rows}
    by = {s: [k for k, _, x in rows if x == s] for s in sorted({s for _, _, s in rows})}
    size = {s: sum(words[k] for k in ks) for s, ks in by.items()}
    total, shards = sum(size.values()), {s: ceil(len(ks) / mixing.SHARD_ROWS) for s, ks in by.items()}
    target = fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(by)}, total)
    block = max(1, min(total // (mixing.SHARD_BLOCKS * sum(shards.values())), min(v for v in size.values() if v) * 3 // mixing.SOURCE_BLOCKS))
    quota = dict(zip(by, seats_up_to([target[s] for s in by], total // block, [size[s] * 3 // block for s in by]), strict=True))
    text, out = {k: t for k, t, _ in rows}, []
    for s, ks in by.items():
        cells = [sorted((k for k in ks if int(draw[k][:8], 16) % shards[s] == c), key=lambda k: (draw[k], words[k])) for c in range(shards[s])]
        cell = [sum(words[k] for k in c) for c in cells]
        for c, n, blocks in zip(cells, cell, seats_up_to(cell, quota[s], [ceil(3 * n / block) for n in cell]), strict=True):
            left = min(blocks * block, 3 * n)
            while left > 0:
                for k in c:
                    if words[k] and left > 0:
                        cut = re.match(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % left, text[k])[0] if left < words[k] else text[k]
                        out.append((k, cut))
                        left -= min(left, words[k])
    return Counter(out)


def test_mix_equals_a_plain_version(stages):
    rows = [(r.doc_id, r.text or "", r.source) for r in stages["near_dedup"].collect()]
    assert Counter((r.doc_id, r.text) for r in stages["source_mix"].collect()) == plain_mix(rows)


def test_encoding_equals_the_library(stages):
    library = Tokenizer.from_file(queries.TOKENIZER)
    want = Counter()
    for r in stages["source_mix"].collect():
        found = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages["encode"].collect()) == want


def test_clean_labelled_documents_stay(spark, stages):
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 AND toxic = 0")
    clean = ids(stages["documents"].join(good, "doc_id", "left_semi"))
    assert len(set(clean) & set(ids(stages["quality_classifier"]))) >= 0.97 * len(clean)


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == Counter(map(tuple, stages["encode"].collect()))


GOOD = "The river runs past the old mill, and people walk there on quiet evenings to talk about their gardens. " * 4
HARD = [*DOCS, (8, GOOD + " ".join(f"first{k}" for k in range(60)), None), (8, GOOD[::-1] + " ".join(f"other{k}" for k in range(60)), "s1"), (None, " ".join(f"keyless{k} story" for k in range(60)), "s2"), (None, " ".join(f"another{k} tale" for k in range(60)), None)]


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_on_hard_rows(spark, name):
    """Nulls in every column, empty and very long texts, ties, repeated rows and keys, columns that the operators use inside; then no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    df = documents(spark, HARD).withColumn("n_chars", F.length("text").cast("long"))
    out, given = stage(spark, df, DATA), rows_of(df)
    if name == "encode":
        assert Counter(r.doc_id for r in out.collect()) == Counter(k for k, _, _ in given.elements())
    else:
        assert out.columns == df.columns
        got = rows_of(out)
        if name in ("quality_classifier", "quality_rules"):  # a row stays or goes by its text alone, with all its repeats
            assert all(got[r] == given[r] for r in got)
            assert len({t for _, t, _ in given} & {t for _, t, _ in got}) == len({t for _, t, _ in got})
        if name == "near_dedup":  # nothing but one row of each group
            assert set(got.values()) == {1}
            assert {t for _, t, _ in got} | {"", None, "  \n\t "} >= {t for _, t, _ in given}
            assert LONG in {t for _, t, _ in got}
        if name == "source_mix":  # every taken row is one of the rows or the beginning of one, under its own key and source
            assert all(any((k, s) == (a, b) and (x or "").startswith(t) for a, x, b in given) for k, t, s in got)
            words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) * n for (_, t, _), n in rows.items())
            assert words(got) == pytest.approx(words(given), rel=0.01)
    assert stage(spark, df.limit(0), DATA).count() == 0
