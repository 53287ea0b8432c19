"""Small literal frames: published unit cases and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from usagekit.functions import derive as d
from usagekit.functions import stats
from usagekit.operators import canvas, features, ordered, scoring, segments, sequences, survival, timing
from usagekit.sources import events as source

T0 = dt.datetime(2025, 1, 1, 10, 0)


def log(spark, rows):
    """Rows of (person, minutes after T0, event[, tool])."""
    data = [(r[0], i, r[2], T0 + dt.timedelta(minutes=r[1]), r[3] if len(r) > 3 else None) for i, r in enumerate(rows)]
    return source.conform(spark.createDataFrame(data, "person_id string, event_id long, event string, ts timestamp, tool_name string"))


def one(df):
    return df.collect()[0]


def test_canvas_id(spark):
    df = spark.createDataFrame([("/canvas/5446a448-57ed-42a4-bb0c-29c6fe264c4e",), ("/canvases/home",), (None,)], "pathname string")
    assert [r[0] for r in df.select(d.canvas_id_of()).collect()] == ["5446a448-57ed-42a4-bb0c-29c6fe264c4e", None, None]


def test_sessions_gap_30(spark):
    rows = ordered.sessionize(log(spark, [("u1", 0, "a"), ("u1", 10, "a"), ("u1", 60, "a")])).orderBy("ts").collect()
    assert [r.session_num for r in rows] == [1, 1, 2]


def test_gap_of_exactly_the_limit_stays_in_session(spark):
    rows = ordered.sessionize(log(spark, [("u1", 0, "a"), ("u1", 30, "a"), ("u1", 60.1, "a")])).orderBy("ts").collect()
    assert [r.session_num for r in rows] == [1, 1, 2]


def test_session_spans_slices(spark):
    minutes = [0, 29, 58, 87, 116, 200, 229, 258]
    rows = ordered.sessionize(log(spark, [("u1", m, "a") for m in minutes])).orderBy("ts").collect()
    assert [r.session_num for r in rows] == [1] * 5 + [2] * 3
    assert [r.events for r in ordered.session_table(log(spark, [("u1", m, "a") for m in minutes])).orderBy("session_num").collect()] == [5, 3]


def test_complexity_score(spark):
    df = spark.createDataFrame([(3, 2, 1, 0, 1, 2)], "structural_actions int, agent_build_actions int, execution_actions int, dependency_actions int, output_actions int, active_days int")
    assert one(df.select(canvas.complexity_score()))[0] == pytest.approx(9.8)


def test_churn_label(spark):
    rows = [("u1", 0, "a"), ("u2", 19 * 1440, "a")]
    out = {r.person_id: r for r in scoring.churn_label_inactivity(log(spark, rows)).collect()}
    assert (out["u1"].is_churn, out["u1"].is_censored) == (1, 0)
    assert (out["u2"].is_churn, out["u2"].is_censored) == (0, 1)


def test_ngrams_and_lift(spark):
    tokens = [("f1", "ABC"), ("f2", "ABD"), ("b1", "ACD"), ("b2", "BCD")]
    df = log(spark, [(p, i, t) for p, seq in tokens for i, t in enumerate(seq)]).withColumn("token", F.col("event"))
    grams = sequences.ngram_counts(df.where("person_id = 'f1'"), 2).collect()
    assert {r.gram: r.occurrences for r in grams} == {"A -> B": 1, "B -> C": 1}
    groups = spark.createDataFrame([("f1", 1), ("f2", 1), ("b1", 0), ("b2", 0)], "person_id string, focal int")
    table = {r.ngram: r for r in sequences.ngram_lift(df, groups, 2, min_count=1, min_baseline=1).collect()}
    assert table["A -> B"].lift > 1
    assert table["A -> B"].focal_count == 2 and table["A -> B"].publishable == 0


def test_ngram_longer_than_sequence_and_blank_tokens(spark):
    df = log(spark, [("u", 0, "A"), ("u", 1, ""), ("u", 2, "B")]).withColumn("token", F.col("event"))
    assert sequences.ngram_counts(df, 3).count() == 0
    assert one(sequences.ngram_counts(df, 2)).gram == "A -> B"


def test_empty_base_corpus(spark):
    df = log(spark, [("u", i, t) for i, t in enumerate("ABAB")]).withColumn("token", F.col("event"))
    groups = spark.createDataFrame([("u", 1)], "person_id string, focal int")
    out = {r.ngram: r for r in sequences.ngram_lift(df, groups, 2, min_count=1).collect()}
    assert out["A -> B"].baseline_support == 0 and out["A -> B"].baseline_count == 0
    assert out["A -> B"].lift == pytest.approx(((2 + 1) / (3 + 2)) / ((0 + 1) / (1 + 2)))


def test_regions(spark):
    df = spark.createDataFrame([("IN",), ("US",), ("fr",), ("BR",), ("",), (None,), ("Unknown",)], "c string")
    assert [r[0] for r in df.select(d.region_of("c")).collect()] == ["India", "US", "EU", "Other", "Unknown", "Unknown", "Other"]


def test_build_events(spark):
    df = spark.createDataFrame(
        [("agent_tool_call_create_block_tool", None), ("x", "refactor_block_tool"), ("agent_message", "Coder Agent"), (None, None)], "event string, tool_name string"
    )
    assert [r[0] for r in df.select(d.is_build()).collect()] == [True, True, False, False]


def test_tool_names(spark):
    df = spark.createDataFrame(
        [("agent_tool_call_run_block_tool", None), ("agent_tool_call_run_block_tool", "  "), ("agent_tool_call_x", " get_block_tool "), ("sign_up", None), ("agent_message", "Coder Agent")],
        "event string, tool_name string",
    )
    rows = d.with_canonical_event(d.with_tool(df)).collect()
    assert [r.tool for r in rows] == ["run_block_tool", "run_block_tool", "get_block_tool", None, "Coder Agent"]
    assert [r.unified_event for r in rows] == ["tool_run_block", "tool_run_block", "tool_get_block", "sign_up", "agent_message"]


def test_first_and_later_days(spark):
    rows = [(0, 1, 1), (60, 0, 0), (1440, 1, 0), (2880, 1, 1)]
    data = [("u1", "c1", "e", T0 + dt.timedelta(minutes=m), s, 0, 0, 0, b) for m, s, b in rows]
    df = spark.createDataFrame(data, "person_id string, canvas_id string, event string, ts timestamp, is_structural int, is_execution int, is_dependency int, is_output int, is_agent_build int")
    row = one(canvas.first_vs_later_days(df))
    assert row.first_day_score == pytest.approx(1 + 1.8 + 0.6)
    assert row.later_active_days == 2
    assert row.later_max_day_score >= row.later_avg_day_score
    assert row.growth_delta == pytest.approx(0.0)


def test_wilson(spark):
    df = spark.createDataFrame([(50, 100), (0, 0), (0, 10), (10, 10)], "k int, n int")
    out = [r.w for r in df.select(stats.wilson_interval(F.col("k"), F.col("n")).alias("w")).collect()]
    assert out[0].low == pytest.approx(0.40383, abs=1e-5)
    assert (out[1].low, out[1].high) == (0.0, 0.0)
    assert out[2].low == 0.0 and out[3].high == 1.0


def test_time_to_first_limits(spark):
    tool = "agent_tool_call_run_block_tool"
    rows = []
    for user, minutes in (("a", 0), ("b", 60), ("c", 61), ("d", 20000)):
        rows += [(user, 0, "sign_up"), (user, minutes, tool)]
    rows.append(("e", 5, tool))
    out = {r.person_id: r for r in features.time_to_first_features(log(spark, rows)).collect()}
    assert [out[u].ttf_agent_tool_min for u in "abcd"] == [0.0, 60.0, 61.0, 10080.0]
    assert [out[u].adopted_agent_early for u in "abcde"] == [1, 1, 0, 0, 0]
    assert out["e"].ttf_agent_tool_min is None and out["e"].ever_used_agent == 1


def test_signup_time_fallback_only_without_any_signup(spark):
    rows = [("a", 0, "sign_up"), ("b", 30, "x")]
    out = {r.person_id: r.signup_hour for r in features.signup_time_features(log(spark, rows)).collect()}
    assert out == {"a": 10, "b": -1}
    assert one(features.signup_time_features(log(spark, [("b", 30, "x")]))).signup_hour == 10


def test_assembled_one_event_user(spark):
    row = one(segments.assign_segment(features.assemble_features(log(spark, [("solo", 0, "x")]))))
    assert (row.total_events, row.days_active, row.total_sessions_derived, row.tenure_days) == (1, 1, 1, 0.0)
    assert row.segment == "Ghost" and row.unique_canvases == 0 and row.ref_google == 0


def test_segment_rules(spark):
    base = dict(total_events=50, days_active=3, ever_used_agent=1, agent_build_calls=0, agent_run_calls=0, agent_conversations=0, manual_runs=0)
    users = [
        {**base, "total_events": 5, "agent_build_calls": 9}, {**base, "agent_build_calls": 3}, {**base, "agent_run_calls": 3},
        {**base, "agent_conversations": 2}, {**base, "ever_used_agent": 0, "agent_build_calls": 3, "manual_runs": 3}, base,
    ]
    rows = segments.assign_segment(spark.createDataFrame(users)).collect()
    assert [r.segment for r in rows] == ["Ghost", "Agent Builder", "Agent Runner", "Agent Runner", "Manual Coder", "Viewer"]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.25, 0.5, 0.8, 1.0, 1.5)], "p double")
    assert [r[0] for r in df.select(scoring.risk_bucket("p")).collect()] == ["Low", "Low", "Medium", "Medium", "High", "Critical", "Critical"]
    assert [r[0] for r in df.select(scoring.priority_bucket("p")).collect()] == ["Low", "Low", "Low", "Medium", "Critical", "Critical", "Critical"]
    timed = spark.createDataFrame([(x,) for x in (0.0, 14.9, 15.0, 1440.0, 10080.0)], "m double")
    from usagekit.operators.reports import TIMING_EDGES, TIMING_LABELS

    assert [r[0] for r in timed.select(d.bucketize("m", TIMING_EDGES, TIMING_LABELS, right=False)).collect()] == ["<15 min", "<15 min", "15-60 min", "1-7 days", None]


def test_zero_denominator_and_constant_column(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 0.0)], "a double, b double")
    assert one(df.select(d.ratio(F.col("a"), F.col("b"))))[0] is None
    scaled = df.withColumn("r", stats.value_ranges(df, ["a"])).select(stats.min_max(F.col("r"), "a"))
    assert [r[0] for r in scaled.collect()] == [0.0, 0.0]


def test_country_mode_ties_go_to_the_smaller_code(spark):
    from usagekit.operators.geo import user_country

    data = [("u", "US", T0), ("u", "IN", T0), ("u", "US", T0), ("u", "IN", T0), ("v", None, T0)]
    df = spark.createDataFrame(data, "person_id string, country_code string, ts timestamp")
    assert [tuple(r) for r in user_country(df).collect()] == [("u", "IN")]


def test_survival_published_points(spark):
    """285 users, 137 of them censored at day 1: S(2) = 83/148 and S(3) = 54/148."""
    days = [1] * 137 + [2] * 65 + [3] * 29 + [4] * 54
    users = spark.createDataFrame([(f"u{i}", n, "g") for i, n in enumerate(days)], "person_id string, days_active long, segment string")
    curve = {r.timeline: r for r in survival.kaplan_meier(survival.activity_survival(users)).collect()}
    assert curve[0].survival == 1.0 and 1 not in curve
    assert curve[2].survival == pytest.approx(0.5608108108)
    assert curve[3].survival == pytest.approx(0.3648648649)
    assert curve[4].survival == 0.0 and curve[4].ci_low is None
    assert curve[2].ci_low < curve[2].survival < curve[2].ci_high
    values = [curve[t].survival for t in sorted(curve)]
    assert values == sorted(values, reverse=True)


def test_branch_prefix_minimum(spark):
    def path(n, a, b, segment):
        return [(f"{a}{b}{i}", a, b, None, None, None, segment) for i in range(n)]

    rows = path(15, "AUTH", "RUN", "Agent Builder") + path(14, "RUN", "AUTH", "Ghost")
    df = spark.createDataFrame(rows, "person_id string, step_1 string, step_2 string, step_3 string, step_4 string, step_5 string, segment string")
    out = sequences.branch_table(df).collect()
    assert [(r.prefix, r.next_event, r.users, r.branch_gap) for r in out] == [("AUTH", "RUN", 15, 100.0)]


def test_path_merges_repeats(spark):
    rows = [("u", i * 50, e) for i, e in enumerate(["sign_up", "sign_in", "run_block", "run_all_blocks", "sign_in", "credits_used", "zzz", "run_block"])]
    assert one(sequences.user_paths(log(spark, rows))).path == "AUTH -> RUN -> AUTH -> CREDITS -> OTHER"


def test_third_build_clip(spark):
    build = "agent_tool_call_create_block_tool"
    rows = [("a", 0, build), ("a", 1, build), ("a", 2, build), ("a", 10, "sign_up"), ("b", 0, build), ("b", 1, build)]
    out = timing.time_to_kth(log(spark, rows)).collect()
    assert [(r.person_id, r.days_to_kth) for r in out] == [("a", 0.0)]


def test_csv_source(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "person_id,distinct_id,event,timestamp,prop_$session_id,prop_flag\n"
        "1,d1,sign_up,2025-01-01 10:00:00,s1,IGAZ\n"
        "2,d2,run_block,not a time,s2,HAMIS\n"
        ",d3,run_block,2025-01-01 11:00:00,,HAMIS\n"
    )
    raw = source.read_events_raw(spark, str(path)).orderBy("distinct_id").collect()
    assert [r.prop_flag for r in raw] == ["true", "false", "false"]
    assert raw[1].ts is None and raw[0].session_id == "s1"
    assert [r.person_id for r in source.read_events(spark, str(path)).collect()] == ["1"]


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "person_id string, n int")
    source.write_twin(df, str(tmp_path / "t"))
    assert one(source.read_features(spark, str(tmp_path / "t.parquet"))).n == 1
    source.write_reports({"r": df}, str(tmp_path / "reports"))
    assert spark.read.option("header", True).csv(str(tmp_path / "reports" / "r.csv")).count() == 1
    with pytest.raises(ValueError):
        source.write_table(df, str(tmp_path / "t.xlsx"))


def test_missing_columns_become_typed_nulls(spark):
    df = source.conform(spark.createDataFrame([("a", "x", T0)], "person_id string, event string, ts timestamp"))
    assert df.columns == [f.name for f in source.EVENT_SCHEMA.fields]
    assert one(df).session_id is None
