from kestrelgrid.operators import training
from kestrelgrid.plans.catalog import QUERIES

from .oracle import DATA


def test_training_queries_run_the_operators_tier_and_the_null_model(spark, monkeypatch):
    seen = []

    def cv(df, features, key, t=None, null_model=False):
        seen.append((t, null_model))
        return spark.createDataFrame([(0, 0.4 if null_model else 0.7, 1.0)], "fold int, auc double, time double")

    def importance(df, features, t, key):
        seen.append(t)
        return spark.createDataFrame([("f0", 1.0)], "feature string, importance double")

    monkeypatch.setattr(training, "spatial_cv", cv)
    monkeypatch.setattr(training, "importance", importance)
    got = QUERIES["gbt_spatial_cv"](spark, DATA).collect()
    assert [r.asDict() for r in got] == [{"fold": 0, "auc": 0.7, "null_auc": 0.4}]
    assert sorted(seen, key=str) == [(None, False), (None, True)]
    seen.clear()
    QUERIES["feature_importance"](spark, DATA)
    assert seen == [training.TIERS[1]]  # 254 presences


def test_trees_against_a_plain_tree(spark):
    import numpy as np

    from kestrelgrid.operators import boosting

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.fit(x, y, 2, 80, 0.3, 7)
    for row, margin in zip(x[:50], m.margin(x[:50]), strict=True):
        total = m.base
        for feature, split, leaf in zip(m.feature, m.split, m.leaf, strict=True):
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + (sum(c <= row[feature[k]] for c in m.cuts[feature[k]]) >= split[k])
            total += leaf[k - len(feature)]
        assert abs(total - margin) < 1e-9
    assert ((m.margin(x) > 0) == y).mean() > 0.97
    assert set(np.argsort(-m.gain)[:2]) == {0, 1}
    early = boosting.fit(x, rng.integers(0, 2, 400).astype(float), 2, 300, 0.3, 7, held_out=np.arange(400) % 5 == 0)
    assert len(early.feature) < 300
    a, b = boosting.logistic_curve(np.array([-2.0, -1, 1, 2, 3, -3]), np.array([0.0, 1, 0, 1, 1, 0]))
    p = 1 / (1 + np.exp(-(a * np.array([-2.0, -1, 1, 2, 3, -3]) + b)))
    assert abs((p - np.array([0.0, 1, 0, 1, 1, 0])).sum()) < 1e-4


def test_a_corrupt_model_is_not_a_missing_one(spark, tmp_path):
    import pytest

    assert training.load_models(spark, str(tmp_path), "No such") == {}
    (tmp_path / "Odd_one").mkdir()
    (tmp_path / "Odd_one" / "part-0.parquet").write_bytes(b"PAR1 not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        training.load_models(spark, str(tmp_path), "Odd one")


def test_the_training_queries_themselves(spark):
    """The operator's own tier, 300 trees a model: scores are in range, and calibrated ones beat a coin where labels can be learned."""
    rows = QUERIES["gbt_spatial_cv"](spark, DATA).collect()
    assert [r.fold for r in sorted(rows)] == [0, 1, 2, 3]
    assert all(0 <= v <= 1 for r in rows for v in (r.auc, r.pr_auc, r.brier, r.ece, r.null_auc))
    got = QUERIES["feature_importance"](spark, DATA).orderBy("rank").collect()
    assert sum(r.importance for r in got) == pytest_approx(1.0)
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def pytest_approx(v):
    import pytest

    return pytest.approx(v, abs=1e-6)
