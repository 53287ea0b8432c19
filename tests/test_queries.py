"""Every query that has SQL, side by side with DuckDB: and the values of fitted models."""

from functools import partial

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from oracle import registry
from usagekit.operators import models

SMALL, MODELS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SQL = registry.oracle_sql()
FITTED = [
    "cross_validate_all_users", "cross_validate_agent_users", "feature_importance", "hold_out_quality", "churn_score", "churn_cross_validation", "churn_hold_out",
    "churn_drivers", "model_driven_interventions", "model_driven_struggle", "ces_cross_validation", "ces_confusion", "ces_batch_score", "fleet_models", "fleet_drift",
    "feature_ablation", "kmeans_archetypes", "kmeans_elbow", "propensity_scores", "propensity_match", "matched_effect",
]
IN_BOUNDS = (
    "auc", "average_precision", "accuracy", "importance", "churn_probability", "intervention_priority_score", "churn_risk_signal", "abandonment_risk_after_struggle",
    "precision", "recall", "f1", "success_probability", "auc_rf", "auc_lr", "auc_mean", "ap_mean", "propensity_score", "success_rate",
)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_starts_no_job_and_has_rows(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("entry", "entry")
    df = entry.entry(spark)
    jobs = tracker.getJobIdsForGroup("entry")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a parquet footer is the only job that building may start
    assert len(jobs) <= 3 and "segment" in df.columns
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ok, note, _ = compare(spark, con, entry.queries()[name], SQL[name], SMALL)
    assert ok, note


@pytest.fixture()
def fewer_trees(monkeypatch):
    for fit, fewer in (
        ("success_estimators", {"trees": 20, "rounds": 3}), ("ces_estimators", {"trees": 20, "rounds": 3}), ("churn_estimators", {"trees": 20}),
        ("ablation", {"trees": 10}), ("fleet_models", {"trees": 10}), ("fleet_drift", {"trees": 10}), ("random_forest", {}),
    ):
        monkeypatch.setattr(models, fit, partial(getattr(models, fit), **fewer))
    plain = models.random_forest.func
    monkeypatch.setattr(models, "random_forest", lambda columns, trees=300, *rest, **more: plain(columns, min(trees, 20), *rest, **more))


def values(spark, name):
    """The rows of a query, doubles to nine digits."""
    df = entry.queries()[name](spark, MODELS)
    rows = [tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()]
    return df, sorted(rows, key=str)


@pytest.mark.parametrize("name", FITTED)
def test_model_query_returns_its_values(spark, fewer_trees, name):
    """Values, not flags: there are rows, doubles within their bounds, and rates that differ."""
    assert name not in SQL
    df, rows = values(spark, name)
    assert rows
    for c in set(IN_BOUNDS) & set(df.columns):
        found = [r[df.columns.index(c)] for r in rows if r[df.columns.index(c)] is not None]
        assert all(0 <= v <= 1 for v in found) and (found or c in ("auc_rf", "auc_lr"))


@pytest.mark.parametrize("name", ["churn_drivers", "churn_score", "hold_out_quality", "cross_validate_agent_users"])
def test_fitted_values_repeat(spark, fewer_trees, name):
    assert values(spark, name)[1] == values(spark, name)[1]
