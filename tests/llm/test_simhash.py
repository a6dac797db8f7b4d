import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kestrelgrid.llm import queries
from kestrelgrid.llm import simhash_covering as sh

from ..oracle import DATA
from .cases import documents


def plain(text):
    """The fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """doc -> smallest doc reachable, over all pairs."""
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: root(d) for d in fps}


def test_masks_cover_every_pair_within_the_radius():
    masks = sh.covering_masks()
    assert len(masks) == 31
    rnd = random.Random(0)
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
        assert any(not diff & m for m in masks)
    assert all(24 <= m.bit_count() <= 40 for m in masks)


def test_fingerprint_equals_sparks_hash(spark):
    for text in ("one two three", "A b C d"):
        got = spark.range(1).select(F.xxhash64(F.lit(text.lower())).alias("h")).first().h
        assert got % (1 << 64) == sh.fingerprint(text) == plain(text)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {d: plain(t) for d, t in texts.items()}
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_covering(spark, DATA).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in texts}


def test_chains_of_links_within_dense_groups(spark):
    """Fingerprints a few bits apart, found through divided buckets as well as direct ones."""
    rnd = random.Random(5)
    fps = {}
    for g in range(4):
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps[len(fps)] = x
            for _ in range(rnd.choice((1, 2, 4, 5, 9))):
                x ^= 1 << rnd.randrange(64)
    want = components(fps)
    first = {}
    for d, f in fps.items():
        first.setdefault(f, d)
    rows = spark.createDataFrame([(sh._signed(f), d) for f, d in first.items()], "fp long, rep long")
    from kestrelgrid.operators.components import connected_components

    for direct in (4_096, 8, 1):
        edges = sh.links(rows, direct=direct)
        by = {d: f for f, d in first.items()}
        assert all((by[r.a] ^ by[r.b]).bit_count() <= 4 for r in edges.collect())
        got = {r.node: r.component for r in connected_components(edges).collect()}
        assert {d: got.get(first[f], first[f]) for d, f in fps.items()} == want


def test_hard_rows(spark):
    got = {}
    for r in sh.near_duplicates(documents(spark)).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    zero = "0" * 16
    assert got[2] == got[3] == got[6] == {(zero, 2)}
    assert len(got[5]) == 1
    assert next(iter(got[None]))[1] is None
    assert sh.near_duplicates(documents(spark).limit(0)).count() == 0


def test_one_row_of_each_group_stays_with_all_columns(spark):
    df = documents(spark)
    kept = sh.keep_one_row(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 5, 7, None]
    assert sh.keep_one_row(df.limit(0)).count() == 0


def test_the_pipeline_keeps_one_row_of_groups_with_null_and_repeated_keys(spark):
    import corpus_pipeline

    from .cases import DOCS, LONG

    more = [(8, "one text of key eight", "s1"), (8, "quite another story told under this key", "s2"), (None, "No key here", "s1"), (None, "Another without a key", "s1")]
    df = documents(spark, DOCS + more)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    got = sorted((r.text or "" for r in kept.collect()))
    naive = DOCS[-1][1]
    assert got == sorted(["", DOCS[0][1], LONG, "No key here", "Same text twice", naive, more[0][1], more[1][1], more[3][1]])


@pytest.mark.parametrize("n", [1, 3, 4, 5, 70_000])
def test_fingerprint_lengths(n):
    text = " ".join(f"W{i % 977}" for i in range(n))
    assert sh.fingerprint(text) == plain(text)
