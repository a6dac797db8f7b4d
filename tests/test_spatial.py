import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrelgrid.operators import components, sampling, spatial, stats


def frame(spark, xy, base=0):
    return spark.createDataFrame([(base + i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


def near(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(2)
    return np.concatenate([rng.normal(0, 1, (60, 2)), rng.uniform(-40, 40, (30, 2)), np.zeros((5, 2))])


def test_knn_is_exact_with_clusters_outliers_and_ties(spark, xy):
    got = {}
    for r in spatial.knn(frame(spark, xy), frame(spark, xy), 7, others_only=True).collect():
        got.setdefault(r.left_id, {})[r.rank] = r.right_id
    for i, p in enumerate(xy):
        want = sorted((near(p, q), j) for j, q in enumerate(xy) if j != i)[:7]
        assert [got[i][k + 1] for k in range(7)] == [j for _, j in want]


def test_knn_of_few_and_of_none(spark, xy):
    assert spatial.knn(frame(spark, xy[:3]), frame(spark, xy[:2]), 25).count() == 6
    assert spatial.knn(frame(spark, xy[:3]), frame(spark, xy[:0]), 25).count() == 0


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_knn_of_far_points_and_crowds(spark, leaf):
    rng = np.random.default_rng(5)
    crowd = np.concatenate([rng.normal(0, 1e-6, (300, 2)), rng.normal(500, 1, (40, 2)), [[0.0, 0.0]] * 12])
    seekers = np.concatenate([crowd[:20], rng.uniform(-1e6, 1e6, (10, 2)), [[499.0, 501.0]]])
    got = {}
    for r in spatial.knn(frame(spark, seekers), frame(spark, crowd), 4, leaf=leaf).collect():
        got.setdefault(r.left_id, {})[r.rank] = r.right_id
    d = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    for i, p in enumerate(seekers):
        want = sorted((d(p, q), j) for j, q in enumerate(crowd))[:4]
        assert [d(p, crowd[got[i][n]]) for n in (1, 2, 3, 4)] == [x for x, _ in want]


def test_a_hundred_thousand_points_in_one_place(spark):
    """Neither the search nor thinning makes the pairs of a crowd."""
    crowd = spark.range(100_000).select("id", (F.rand(3) * 1e-3).alias("x"), (F.rand(4) * 1e-3).alias("y"))
    far = frame(spark, [(0, 0), (1000, 1000), (-5e5, 3)], 1_000_000)
    got = spatial.knn(far, crowd.unionByName(far), 3, others_only=True)
    assert got.count() == 9
    assert sampling.greedy_thin(crowd, 1.0).count() == 1


@pytest.mark.parametrize("crowd", [1, 3, 4_096])
def test_crowded_buckets_are_dealt_without_loss(spark, xy, crowd):
    got = {(r.id, r.right_id) for r in spatial.within(frame(spark, xy), frame(spark, xy), 1.5, crowd=crowd).collect()}
    assert got == {(i, j) for i, p in enumerate(xy) for j, q in enumerate(xy) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 1.5 * 1.5}


def test_radius_joins_at_the_edge(spark):
    a, b = frame(spark, [(0, 0), (999, 0), (1001, 0), (5000, 5000)]), frame(spark, [(0, 0)], 100)
    assert sorted(r.id for r in spatial.radius_anti_join(a, b, 1000.0).collect()) == [2, 3]
    assert sorted((r.id, r.right_id) for r in spatial.within(a, b, 1000.0).select("id", "right_id").collect()) == [(0, 100), (1, 100)]


def sequential(points, order, radius):
    kept = []
    for i in order:
        if all(near(points[i], points[j]) > radius for j in kept):
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("radius", [0.3, 1.0, 5.0])
def test_thinning_equals_the_sequential_visit(spark, xy, radius):
    df = frame(spark, xy)
    order = [r.id for r in df.orderBy(sampling.uniform(["id"], 42), "id").collect()]
    assert {r.id for r in sampling.greedy_thin(df, radius).collect()} == sequential(xy, order, radius)


def test_seam_trim_reports_before_and_after(spark):
    df = frame(spark, [(0, 0), (0.4, 0), (3, 0), (10, 0)]).withColumn("fold", F.when(F.col("id") % 2 == 0, "A").otherwise("B"))
    kept, report = spatial.seam_trim(df, "fold", 0.5)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    r = report.first()
    assert (r.min_dist_before, r.min_dist_after, r.dropped) == (pytest.approx(0.4), pytest.approx(2.6), 1)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_are_those_of_the_graph(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges or [(0, 0)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_vif_equals_numpy_and_skips_constants(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1, (50, 3))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    df = spark.createDataFrame([(*map(float, r), 0.0) for r in x], "a double, b double, c double, d double")
    got = {r.feature: r.vif for r in stats.vif(df, ["a", "b", "c", "d"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for i, n in enumerate("abc"):
        rest = np.delete(x, i, 1)
        res = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[n] == pytest.approx((x[:, i] ** 2).sum() / (res**2).sum())


def test_scores_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert stats.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(0.875)
    assert stats.average_precision(df, "y", "s").first().avg_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    one = df.where("y = 1")
    assert stats.roc_auc(one, "y", "s").first().roc_auc is None
    t = stats.tss_threshold(df, "y", "s").first()
    assert (t.threshold, t.tss) == (pytest.approx(0.11), pytest.approx(0.5))


def test_weighted_sample_prefers_heavy_rows(spark):
    df = spark.range(400).select(F.col("id"), F.lit("a").alias("s"), F.when(F.col("id") < 200, 100.0).otherwise(0.01).alias("w"))
    got = [r.id for r in sampling.weighted_stratified_sample(df, "s", "w", {"a": 100}, ["id"]).collect()]
    assert len(got) == 100
    assert sum(i < 200 for i in got) >= 95


def test_borrowed_dates_come_from_the_nearest(spark):
    p = frame(spark, [(i, 0) for i in range(60)]).withColumns({"year": (F.col("id") + 2000).cast("int"), "month": F.lit(1)})
    got = sampling.temporal_borrow(frame(spark, [(0, 0), (59, 0)], 1000), p, 1.0).collect()
    years = {r.id: r.year for r in got}
    assert 2000 <= years[1000] < 2025
    assert 2035 <= years[1001] < 2060


def test_quantiles_equal_sparks_exact_percentile(spark):
    rows = [(float(v), None if v % 3 else v / 7, 5) for v in [3, 3, 3, 1, 9, -2, 0, 40, 12, 7, 7]] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {(r.feature, r.p): r.value for r in stats.quantiles(df, dict.fromkeys("abc", ps)).collect()}
    want = df.agg(*[F.percentile(c, p).alias(f"{c}{p}") for c in "abc" for p in ps]).first()
    assert got == {(c, p): pytest.approx(want[f"{c}{p}"]) for c in "abc" for p in ps}
    assert stats.quantile_row(df.where("a > 100"), {"m": ("a", 0.5)}).first().m is None


def test_split_and_auc_of_large_counts(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 3 else None) for i in range(100)], "id long, k int")
    got = sampling.split(df, "k", ["id"], 0.1)
    assert got.columns == ["id", "k", "is_validation"]
    assert {r.k: r.n for r in got.where("is_validation").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} == {None: 3, 1: 3, 2: 3}
    huge = spark.createDataFrame([(0.1, 0, 4_000_000_000), (0.9, 4_000_000_000, 0)], "s double, p long, n long")
    assert stats.auc_of_histogram(huge, "s").first().roc_auc == 1.0
