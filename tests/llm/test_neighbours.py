import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelgrid.llm import permutation_index as pi
from kestrelgrid.llm import queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_query_recall_and_scores(spark):
    data = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want, got = brute(ids, x, 20, 20), found(queries.op3_permutation_index(spark, data))
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, near in got.items():
        assert len(near) == 20
        assert near == sorted(near, key=lambda r: (-r[1], r[0]))
        assert all(s == pytest.approx(float(x[at[q]] @ x[at[v]]), abs=1e-12) and v != q for v, s in near)


def test_with_every_vector_scored_the_search_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 5)).astype(float)
    x[:, 0] += 0.5
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(5)
    assert found(pi.nearest(df, k=7, pivots=64, rerank=100.0)) == brute(np.arange(300), x, 7, 20)


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA)
    monkeypatch.setattr(pi, "QUERY_BLOCK", 5)
    got = found(pi.nearest(df.repartition(3), k=5, pivots=64, rerank=100.0))
    want = brute(np.arange(400), x, 5, 20)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}


@pytest.mark.parametrize("n", [1_000, 4_000, 16_000])
def test_recall_of_the_index_alone_at_three_sizes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA)
    every = n // 80
    got, want = found(pi.nearest(df, every=every)), brute(np.arange(n), x, 20, every)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.93
    assert pi.RERANK / n**0.5 <= {1_000: 0.32, 4_000: 0.16, 16_000: 0.08}[n]  # the share that is scored exactly falls


def test_repeated_ids(spark):
    rng = np.random.default_rng(4)
    many = [(7, rng.normal(size=6).tolist()) for _ in range(300)]
    others = [(i, rng.normal(size=6).tolist()) for i in range(100, 160)]
    twice = [(20, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (20, [2.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows = many + others + twice
    a, b = (found(pi.nearest(spark.createDataFrame(r, SCHEMA).repartition(n), k=5, pivots=64, rerank=100.0)) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert a == b  # whatever the order of the rows
    assert len(a[20]) == 5
    assert len({v for v, _ in a[20]}) == 5
    best = max(v[0] for _, v in many)  # the query is the lesser vector of id 20, and id 7 has its best score
    assert dict(a[20]).get(7, best) == pytest.approx(best, rel=1e-6)


def test_hard_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]), (120, []), (None, [1.0, 1.0]), (140, [1.0, 1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit("x"), "score": F.lit("x")})
    assert found(pi.nearest(df, k=3)) == {0: [(1, 2.0), (2, 1.0), (3, 1.0)]}
    assert pi.nearest(df.limit(0)).count() == 0
    assert pi.nearest(df.where("vec_id = 20")).count() == 0


@pytest.mark.parametrize("read", [3, 6])
def test_footrule_is_what_the_posting_lists_add_up_to(read):
    rng = np.random.default_rng(2)
    x, p = rng.normal(size=(50, 8)), rng.normal(size=(12, 8))
    orders = pi._orders(x, p, 6)
    assert (orders == np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :6]).all()
    full = lambda o: np.array([list(o).index(k) if k in o else 6 for k in range(12)])
    q = rng.normal(size=8)
    mine = pi._orders(q[None], p, read)[0]
    distance = [np.abs(full(o) - full(mine)).sum() for o in orders]
    s = pi.Shard(np.arange(50), x, orders, 12)
    best = s.search(-1, q, mine, 9, 0.2)[0]
    cut = sorted(zip(distance, range(50), strict=True))[:10]
    assert set(best.tolist()) <= {i for _, i in cut}
