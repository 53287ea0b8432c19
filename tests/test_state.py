"""The mergeable feature state, gram levels from one pass and tool runs, against plain Python and whole rebuilds."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_brute_force import T0, by_user, random_log
from usagekit.operators import features, ordered, sequences

EVENTS = (
    "sign_up", "run_block", "block_create", "agent_new_chat", "canvas_open", "agent_tool_call_create_block_tool",
    "agent_tool_call_run_block_tool", "agent_tool_call_refactor_block_tool", "agent_tool_call_finish_ticket_tool",
)
LOG = "person_id string, event_id long, ts timestamp, event string, tool_name string, session_id string, pathname string, referrer string, message_id string"


def event_rows(seed, n=400):
    rnd = random.Random(seed)
    clock, rows = T0, []
    for i in range(n):
        clock += dt.timedelta(minutes=rnd.choice([0, 1, 20, 31, 200]))
        user = "hot" if rnd.random() < 0.5 else f"u{rnd.randrange(5)}"
        session = rnd.choice([None, f"{user}-{clock.date()}"])
        canvas = rnd.choice([None, f"/canvas/{rnd.randrange(3):08d}-1111-2222-3333-444444444444"])
        rows.append((user, i, clock, rnd.choice(EVENTS), None, session, canvas, rnd.choice([None, "https://google.com"]), rnd.choice([None, f"m{i % 7}"])))
    return rows


def table(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_appended_days_equal_a_rebuild(spark, tmp_path):
    log = spark.createDataFrame(event_rows(1), LOG)
    days = sorted(r.day for r in log.select(F.to_date("ts").alias("day")).distinct().collect())
    cut = days[len(days) // 2]
    path = str(tmp_path / "state")
    old, new = log.where(F.to_date("ts") <= F.lit(cut)), log.where(F.to_date("ts") >= F.lit(cut))
    features.FeatureState.of(old).save(path)
    features.FeatureState.of(new).save(path)  # brings the day of the cut again, which replaces it
    features.FeatureState.of(new).save(path)
    merged = features.features_of(features.FeatureState.load(spark, path))
    assert table(merged) == table(features.assemble_features(log))


def test_each_state_table_scans_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(event_rows(2), LOG).write.parquet(path)
    state = features.FeatureState.of(spark.read.parquet(path))
    for part in (state.daily, state.runs):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    written = state.written()
    matrix = features.features_of(written)
    assert path not in str(matrix.inputFiles()) and "collect_set(event" not in matrix._jdf.queryExecution().optimizedPlan().toString()
    assert table(matrix) == table(features.assemble_features(spark.read.parquet(path)))
    written.drop()


@pytest.mark.parametrize("seed", [3, 4])
def test_tool_pairs_and_sessions_of_the_state(spark, seed):
    rows = event_rows(seed)
    log = spark.createDataFrame(rows, LOG)
    users = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        users.setdefault(r[0], []).append(r)
    want, sessions = {}, {}
    for user, own in users.items():
        calls = [r[3].removeprefix("agent_tool_call_").removesuffix("_tool") for r in own if r[3].startswith("agent_tool_call_")]
        pairs = Counter(zip(calls, calls[1:]))
        if len(calls) > 1:
            want[user] = (pairs["create_block", "run_block"], pairs["run_block", "refactor_block"], len(calls) - 1)
        cuts = [i for i in range(len(own)) if i == 0 or own[i][2] - own[i - 1][2] > dt.timedelta(minutes=30)] + [len(own)]
        sizes = [b - a for a, b in zip(cuts, cuts[1:])]
        sessions[user] = (len(sizes), max(sizes))
    got = {r.person_id: (r.create_run_transitions, r.run_refactor_transitions, r.agent_tool_transitions_total) for r in features.tool_transition_features(log).collect()}
    assert got == want
    assert {r.person_id: (r.total_sessions_derived, r.max_events_per_session) for r in features.session_structure_features(log).collect()} == sessions


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_gram_levels(spark, n):
    rows, df = random_log(spark, 11 + n, n=350)
    numbered = ordered.sessionize(df.where("token != 'C' OR event_id % 3 = 0"), 30)
    kept = {r.event_id: r.session_num for r in numbered.collect()}
    want = Counter()
    for user, own in by_user([r for r in rows if r[1] in kept]).items():
        for i in range(len(own)):
            for m in range(1, min(n, len(own) - i) + 1):
                part = own[i:i + m]
                want[user, m, " -> ".join(t for _, _, t in part), int(len({kept[e] for e, _, _ in part}) == 1)] += 1
    got = ordered.gram_levels(numbered, n, ["person_id"], within="session_num").groupBy("person_id", "n", "gram", "together").count().collect()
    assert Counter({(r.person_id, r.n, r.gram, r.together): r["count"] for r in got}) == want


def test_gram_levels_of_empty_and_null_tokens(spark):
    schema = "person_id string, event_id long, ts timestamp, token string"
    assert ordered.gram_levels(spark.createDataFrame([], schema), 3, ["person_id"]).count() == 0
    rows = [("u", 1, T0, "a"), ("u", 2, T0, None), ("u", 3, T0, ""), ("u", 4, T0 + dt.timedelta(hours=9), "b")]
    got = ordered.gram_levels(spark.createDataFrame(rows, schema), 3, ["person_id"]).collect()
    assert sorted((r.n, r.gram) for r in got) == [(1, "a"), (1, "b"), (2, "a -> b")]


def test_tool_sessions(spark):
    rows, df = random_log(spark, 21)
    labels = {"A": "CREATE", "B": "RUN", "C": "FINISH"}
    calls = df.withColumn("token", F.expr("CASE token WHEN 'A' THEN 'CREATE' WHEN 'B' THEN 'RUN' ELSE 'FINISH' END"))
    want = {}
    for user, own in by_user(rows).items():
        number, before = 0, None
        for _, ts, token in own:
            number += before is None or ts - before > dt.timedelta(minutes=30)
            before = ts
            want.setdefault((user, number), []).append((ts, labels[token]))
    got = {(r.person_id, r.session_num): r for r in sequences.tool_sessions(calls).collect()}
    assert set(got) == set(want)
    for key, own in want.items():
        row, names = got[key], [t for _, t in own]
        assert (row.total_calls, row.tool_diversity, row.build_calls, row.run_calls) == (len(own), len(set(names)), names.count("CREATE"), names.count("RUN"))
        assert row.has_finish == int("FINISH" in names) and row.duration_min == pytest.approx((own[-1][0] - own[0][0]).total_seconds() / 60)
    shuffles = sequences.tool_sessions(calls)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 2  # calls by (user, hour), runs by user


def test_events_tools_and_days_are_counted_once_without_sets(spark):
    """Several rows per event, tool and day; null events, days and users; no aggregation holds a set or expands rows."""
    day, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
    late = at + dt.timedelta(days=1)
    rows = [
        ("a", day, "run_block", None, 2, at, at), ("a", day, "run_block", None, 1, at, late), ("a", day + dt.timedelta(1), "run_all_blocks", None, 1, late, late),
        ("a", day, "agent_tool_call_run_block_tool", "run_block", 3, at, at), ("a", None, "agent_tool_call_run_block_tool", "run_block", 1, at, at),
        ("a", day, "agent_tool_call_get_block_tool", "get_block", 1, at, at), ("a", day, None, None, 0, at, at), (None, day, "sign_up", None, 1, at, at),
    ]
    schema = "person_id string, day date, event string, tool string, n long, first_ts timestamp, last_ts timestamp"
    out = features.rollup_features(spark.createDataFrame(rows, schema))
    got = {r.person_id: r for r in out.collect()}
    a = got["a"]
    assert (a.total_events, a.unique_event_types, a.days_active, a.manual_runs, a.manual_run_days) == (9, 4, 2, 4, 2)
    assert (a.agent_tool_calls_total, a.agent_tool_types_used, a.agent_tool_call_days, a.agent_run_calls, a.agent_inspect_calls) == (5, 2, 1, 4, 1)
    assert (a.first_seen, a.last_seen) == (at, late)
    assert (got[None].total_events, got[None].days_active, got[None].signed_up, got[None].agent_tool_types_used) == (1, 1, 1, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Expand" not in plan and "ObjectHashAggregate" not in plan
