"""Nothing is cut: long sessions, high rates, classes without members, users outside a population."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_literals import T0, log, one

from usagekit.operators import features, models, reports, scoring, timing
from usagekit.sources import events as source


def test_session_of_250_events_is_described_whole(spark):
    rows = [("u1", i, "a", T0 + dt.timedelta(minutes=i), "s1") for i in range(250)]
    events = source.conform(spark.createDataFrame(rows, "person_id string, event_id long, event string, ts timestamp, session_id string"))
    row = one(reports.session_depth(events))
    assert (row["mean"], row["max"]) == (250, 250)


def test_last_buckets_are_open(spark):
    burn = spark.createDataFrame([("u1", 1500.0, "Ghost"), ("u2", 100.0, "Ghost"), ("u3", 0.0, "Ghost")], "person_id string, burn_rate double, segment string")
    assert {r.burn_bucket: r.users for r in reports.burn_by_bucket(burn).collect()} == {"100+": 1, "51-100": 1, "0 (none)": 1}
    users = spark.createDataFrame([(120_000, 1, 3), (0, 0, 0)], "agent_total_events long, is_success int, total_code_runs long")
    assert {r.bucket: r.users for r in reports.volume_flywheel(users).collect()} == {"100+": 1, "0 (none)": 1}
    times = spark.createDataFrame([(10080.0, 1), (3.0, 0), (0.0, 1)], "ttf_manual_run_min double, is_success int")
    assert {r.bucket: r.users for r in reports.time_to_value_curve(times).collect()} == {"clipped (1w+)": 1, "<5m": 1}


def test_users_outside_the_churn_population_have_no_churn(spark):
    names = "person_id string, is_censored int, is_churn int, had_second_session int, days_active long, manual_runs long, p double"
    users = spark.createDataFrame(
        [("outside", 0, 1, 0, 1, 0, 0.9), ("inside", 0, 0, 1, 9, 4, 0.2), ("young", 1, 0, 1, 9, 4, 0.4), ("gone", 0, 1, 0, 2, 0, 0.7)], names
    )
    out = {r.person_id: (r.in_churn_population, r.is_churn, r.churn_probability) for r in scoring.with_churn(users, F.col("p")).collect()}
    assert out == {"outside": (0, 0, 0.0), "inside": (1, 0, 0.2), "young": (0, 0, 0.0), "gone": (1, 1, 0.7)}
    table = scoring.with_churn(users, F.col("p")).withColumns({c: F.lit(0) for c in ("ever_used_agent", "adopted_agent_early")}).withColumn("segment", F.lit("Ghost"))
    assert one(reports.headline_rates(table)).churn_rate == pytest.approx(50.0)


def test_folds_are_stratified_and_spread_a_rare_class(spark):
    rows = [(f"u{i}", float(i < 7)) for i in range(203)]
    frame = spark.createDataFrame(rows, "person_id string, label double")
    folded = models.with_folds(frame, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()
    assert sorted(r.fold for r in folded) == list(range(5))
    assert {r.pos for r in folded} <= {1.0, 2.0} and max(r.n for r in folded) - min(r.n for r in folded) <= 2
    train, test = models.hold_out(frame)
    assert test.count() + train.count() == 203 and test.where("label = 1").count() == 2
    none = models.with_folds(frame.withColumn("label", F.lit(0.0)), 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in none) == [67, 68, 68]


def test_a_fold_without_positives_has_no_area(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(f"u{i}", float(i < 2), rng.random(), 1.0) for i in range(40)], "person_id string, label double, x double, weight double")
    quality = models.cross_validate_folds(frame, {"lr": models.logistic(["x"], 40)}, 4).collect()
    assert sorted(r.positives for r in quality) == [0, 0, 1, 1] and sum(r.users for r in quality) == 40
    assert all((r.auc is None) == (r.positives == 0) for r in quality)


def test_logs_without_event_id_keep_one_order(spark):
    rows = [(f"u{i % 3}", T0, f"e{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "person_id string, ts timestamp, event string")
    first = source.conform(frame)
    assert first.where("event_id IS NULL").count() == 0
    read = lambda df: {r.person_id: r.days_to_kth for r in timing.time_to_kth(df, 3, F.lit(True)).collect()}
    order = lambda df: [(r.event, r.event_id) for r in df.orderBy("ts", "event_id").collect()]
    assert order(first) == order(source.conform(frame.repartition(5))) and read(first) == read(source.conform(frame.repartition(7)))


def test_csv_with_schema_and_split_files(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    spark.createDataFrame([("u1", "2025-01-01 10:00:00", "a"), ("u2", "nonsense", "b")], "person_id string, timestamp string, event string").write.option("header", True).csv(path)
    rows = source.read_events(spark, path, schema="person_id string, timestamp string, event string").collect()
    assert [(r.person_id, r.event) for r in rows] == [("u1", "a")]


def test_tool_columns_of_a_given_list(spark):
    events = log(spark, [("u1", 0, "agent_tool_call_run_block_tool"), ("u1", 1, "agent_tool_call_run_block_tool"), ("u1", 2, "agent_tool_call_get_block_tool")])
    assert {r.tool: r.calls for r in features.tool_call_counts(events).collect()} == {"run_block_tool": 2, "get_block_tool": 1}
    row = one(features.tool_call_columns(events, ["run_block_tool", "create_block_tool"]))
    assert (row.tool_run_block_tool, row.tool_create_block_tool, row.tool_other) == (2, 0, 1)


def test_milestones_and_recovery_do_not_shift_at_midnight(spark):
    late = 13 * 60 + 59  # 23:59
    events = log(spark, [("u1", late, "agent_open_error_assist"), ("u1", late + 2, "run_block"), ("u1", late + 48 * 60, "a"), ("u1", late + 48 * 60 + 1, "b")])
    flags = one(timing.milestone_flags(events))
    assert (flags.ran_code_48h, flags.returned_within_48h) == (1, 1)
    row = one(scoring.struggle_recovery(events))
    assert (row.any_post_struggle_event, row.recovered_within_24h, row.events_within_24h, row.active_days_after_struggle) == (3, 1, 1, 3)
