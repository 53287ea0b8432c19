"""The chain of user tables: features, segments, canvas measures, churn labels, scores.

Each function declares its table from the ones before. The user tables are written to the shared
folder once, as every report reads them: the log is aggregated once, not once per report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagekit.functions.derive import clip
from usagekit.operators import canvas, features, scoring, segments
from usagekit.session import materialize, once
from usagekit.sources.testtables import ingested_log

KEY = "person_id"
# Users of the test tables have 45 to 99 events each: the lowest tenth stands for the ghosts.
TEST_RULES = segments.SegmentRules(ghost_max_events=55)


def segmented_users(log: DataFrame, rules: segments.SegmentRules = segments.SegmentRules()) -> DataFrame:
    return segmented(features.assemble_features(log), rules)


def segmented(users: DataFrame, rules: segments.SegmentRules = segments.SegmentRules()) -> DataFrame:
    return segments.with_adoption(segments.assign_segment(users, rules))


def user_table(log: DataFrame, rules: segments.SegmentRules = segments.SegmentRules(), horizon_days: float = 14) -> DataFrame:
    """Features, segment, canvas measures, churn label and struggle counts side by side."""
    return extend_users(segmented_users(log, rules), log, horizon_days)


def extend_users(users: DataFrame, log: DataFrame, horizon_days: float = 14) -> DataFrame:
    users = canvas.user_canvas_features(canvas.canvas_events(log), users)
    users = users.join(scoring.churn_label_survival_proxy(log, horizon_days), KEY, "left")
    users = users.join(scoring.struggle_counts(log), KEY, "left")
    return users.fillna(0, subset=["is_censored", "is_churn", "had_error_assist", "credit_warning_events"])


def recency_risk(users: DataFrame, days: float = 120.0) -> DataFrame:
    """Churn probability of the churn population from recency alone, for logs without a fitted churn model."""
    return scoring.with_churn(users, clip(F.col("recency_days") / days, 0.0, 1.0))


def test_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented user matrix of the test tables, written once and read by the reports."""
    return once(spark, "users", sf_dir, lambda: segmented_test_users(spark, sf_dir))


def segmented_test_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(features.features_of(test_state(spark, sf_dir)), TEST_RULES)


def test_state(spark: SparkSession, sf_dir: str) -> features.FeatureState:
    """Feature state of the test log, written once: two scans of the log."""
    daily = once(spark, "daily-state", sf_dir, lambda: features.daily_state(ingested_log(spark, sf_dir)))
    runs = once(spark, "run-state", sf_dir, lambda: features.run_state(ingested_log(spark, sf_dir)))
    return features.FeatureState(daily, runs)


def test_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same users with canvas, churn and struggle columns."""
    return once(
        spark, "user-table", sf_dir,
        lambda: recency_risk(extend_users(test_users(spark, sf_dir), ingested_log(spark, sf_dir))),
    )


def intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.intervention_scores(test_table(spark, sf_dir))


def struggle_of(scored: DataFrame, log: DataFrame) -> DataFrame:
    """Struggle quality over given intervention scores; the joined table is written, since ranges and rows read it."""
    return scoring.struggle_quality(materialize(scoring.with_recovery(scored, scoring.struggle_recovery(log)), "struggle"))


def struggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struggle_of(intervention(spark, sf_dir), ingested_log(spark, sf_dir))
