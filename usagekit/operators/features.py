"""User feature matrix: one row per user.

The log becomes a state of two tables, each from one scan, and every family is read from them:

* ``daily_state``: one row per (user, day, event, tool, session, canvas, referrer, chat message) with
  numeric aggregates only, so the shuffle carries map-side combined rows and a user with a third of the
  log is spread over many groups. Counts, flags, day counts, first times, native sessions, canvases,
  conversations and referrers are sums, minima and maxima over it.
* ``run_state``: one row per (user, hour, run of activity) with what depends on the order of events:
  bounds, sizes, flags and tool pairs of the run, first and last tool of it.

Both carry the day and add up over days, so a new day is merged into a written state (``FeatureState``)
without reading the older log again. Families that a report does not read are removed by the optimizer
(left joins on the unique user key).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import one_of, clip, elapsed, fill_numeric, flag, ratio, referrer_class, tool_of, with_canvas_id
from usagekit.operators.ordered import _number_segments, _with_local_run, time_slice
from usagekit.session import drop_table, materialize
from usagekit.vocabulary import DEFAULT, Vocabulary

KEY = "person_id"
REFERRER_CLASSES = ("google", "github", "linkedin", "twitter", "direct", "other")

FAMILIES = (
    "volume", "canvas", "manual", "agent_start", "agent_tool", "transitions", "output", "onboarding",
    "time_to_first", "credit_recency", "first_session", "returning", "session_structure", "signup_time", "referrer",
)


STATE_KEYS = (KEY, "day", "event", "tool", "session_id", "canvas_id", "referrer", "message_id")
RUN_KEYS = (KEY, "day", "slice", "run")
PAIRS = {
    "create_run_transitions": ("create_block", "run_block"),
    "run_refactor_transitions": ("run_block", "refactor_block"),
    "finish_summary_transitions": ("finish_ticket", "get_canvas_summary"),
}


def daily_state(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Event count, first and last time per STATE_KEYS; the tool is kept for agent-tool events only,
    the message for chats only. Columns that the log lacks are NULL."""
    tool = F.when(one_of(vocab.tool_events), tool_of(vocab=vocab))
    session, referrer, message = [F.col(c) if c in log.columns else F.lit(None).cast("string") for c in ("session_id", "referrer", "message_id")]
    rows = with_canvas_id(log).select(
        KEY, F.to_date("ts").alias("day"), "event", tool.alias("tool"), session.alias("session_id"),
        "canvas_id", referrer.alias("referrer"), F.when(one_of(vocab.agent_start), message).alias("message_id"), "ts",
    )
    return rows.groupBy(*STATE_KEYS).agg(F.count("event").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def run_state(log: DataFrame, gap_min: float = 30, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Runs of activity of a user inside an hour: bounds, events, flags, tool pairs by the later call, first
    and last tool call. One shuffle by (user, hour); pairs and sessions across hours come from the rows' ends."""
    built = one_of(("block_create", *vocab.build_events))
    ran = one_of((*vocab.runs, vocab.tool_prefix + "run_block_tool"))
    token = F.replace(F.coalesce(tool_of(vocab=vocab), F.lit("")), F.lit("_tool"), F.lit(""))
    rows = log.select(
        KEY, F.to_date("ts").alias("day"), time_slice().alias("slice"), "ts", "event_id", flag(built).alias("built"), flag(ran).alias("ran"),
        F.when(one_of(vocab.tool_events), F.nullif(token, F.lit(""))).alias("token"),
    )
    window = Window.partitionBy(KEY, "slice").orderBy("ts", "event_id")
    before = F.last("token", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = _with_local_run(rows.withColumn("before", before), window, gap_min)
    call = F.when(F.col("token").isNotNull(), F.struct("ts", "event_id", "token"))
    return rows.groupBy(*RUN_KEYS).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"),
        F.max("built").alias("built"), F.max("ran").alias("ran"),
        *[F.count_if((F.col("before") == a) & (F.col("token") == b)).alias(name) for name, (a, b) in PAIRS.items()],
        F.count_if(F.col("before").isNotNull() & F.col("token").isNotNull()).alias("agent_tool_transitions_total"),
        F.min(call)["token"].alias("first_token"), F.max(call)["token"].alias("last_token"),
    )


@dataclass(frozen=True)
class FeatureState:
    """What the feature matrix needs of a log, day by day."""

    daily: DataFrame
    runs: DataFrame
    gap_min: float = 30

    @classmethod
    def of(cls, log: DataFrame, gap_min: float = 30, vocab: Vocabulary = DEFAULT) -> FeatureState:
        return cls(daily_state(log, vocab), run_state(log, gap_min, vocab), gap_min)

    def written(self) -> FeatureState:
        """Both tables in the shared folder: each is read several times, the log once for each."""
        return FeatureState(materialize(self.daily, "daily-state"), materialize(self.runs, "run-state"), self.gap_min)

    def drop(self) -> None:
        """Delete the files that ``written`` made, once nothing reads them any more."""
        drop_table(self.daily)
        drop_table(self.runs)

    def save(self, path: str) -> None:
        """Both tables as parquet by day; days that this state has replace those days at the path, others stay.

        A day is replaced whole, so writing the same days twice changes nothing. Late events of a
        day need the log of that whole day.
        """
        for name, table in (("daily", self.daily), ("runs", self.runs)):
            out = table.repartition("day", F.pmod(F.xxhash64(KEY), F.lit(64))).write.mode("overwrite").partitionBy("day")
            out.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, gap_min: float = 30) -> FeatureState:
        return cls(spark.read.parquet(f"{path}/daily"), spark.read.parquet(f"{path}/runs"), gap_min)


def _n(condition: Column, amount: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(amount))), F.lit(0)).cast("long")


def _days(kind: str) -> Column:
    """Days of a kind; a row without a time is none."""
    return F.count_if(F.col("day").isNotNull() & (F.col(kind) == 1))


def _ever(condition: Column) -> Column:
    return F.max(flag(condition))


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("first_ts")))


def rollup_features(rollup: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Everything that counts, flags or dates events by name. Event and tool names are open domains: a user has one row
    per event, one per tool and one per day, which are small, and these are counted together; no set is held."""
    event, tool = F.col("event"), F.col("tool")
    by_tool = one_of(vocab.tool_events)
    manual, chat = one_of(vocab.runs), one_of(vocab.agent_start)
    name = F.lower(F.replace(tool, F.lit(" "), F.lit("_")))
    groups = {
        "agent_build_calls": "create_block|refactor_block|create_edges",
        "agent_run_calls": "run_block",
        "agent_inspect_calls": "get_block|get_canvas|get_variable",
        "agent_finish_calls": "finish_ticket",
        "agent_delete_calls": "delete_block",
    }
    per_event = rollup.groupBy(KEY, "event").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    per_tool = rollup.where(by_tool).groupBy(KEY, "tool").agg(F.sum("n").alias("tool_n"))
    kinds = {"manual_day": manual, "chat_day": chat, "tool_day": by_tool}
    per_day = rollup.groupBy(KEY, "day").agg(*[F.max(flag(c)).alias(k) for k, c in kinds.items()])
    rows = per_event.unionByName(per_tool, True).unionByName(per_day, True)
    return rows.groupBy(KEY).agg(
        F.sum("n").alias("total_events"),
        F.count("event").alias("unique_event_types"),
        F.count("day").alias("days_active"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        _n(manual).alias("manual_runs"),
        _days("manual_day").alias("manual_run_days"),
        _n(chat).alias("agent_messages"),
        _days("chat_day").alias("agent_start_days"),
        _n(by_tool).alias("agent_tool_calls_total"),
        F.count("tool").alias("agent_tool_types_used"),
        _days("tool_day").alias("agent_tool_call_days"),
        *[_n(tool == t, "tool_n").alias("tool_" + t) for t in vocab.tools],
        *[_n(name.rlike(pattern), "tool_n").alias(alias) for alias, pattern in groups.items()],
        _n(event == vocab.fullscreen_open).alias("fullscreen_opens"),
        _ever(event == vocab.preview).alias("previewed_output"),
        _ever(event == vocab.sign_up).alias("signed_up"),
        _ever(event == vocab.tour_finished).alias("completed_onboarding"),
        _ever(event == vocab.form_skipped).alias("skipped_onboarding_form"),
        _ever(event == vocab.form_submitted).alias("submitted_onboarding"),
        _n(event == vocab.sign_in).alias("sign_in_count"),
        _first(event == vocab.sign_up).alias("signup_at"),
        _first(manual).alias("first_manual_run_at"),
        _first(by_tool).alias("first_agent_tool_at"),
        _first(chat).alias("first_agent_chat_at"),
        _n(one_of(vocab.credit_events)).alias("credit_events"),
        _ever(event == vocab.credits_exceeded).alias("had_credit_exceeded"),
        _ever(event == vocab.addon_credits).alias("had_addon_credits"),
    )


def _volume(base: DataFrame) -> DataFrame:
    return base.withColumns(
        {
            "tenure_days": clip(elapsed("last_seen", "first_seen", 86400), low=0.0),
            "signup_cohort": F.date_format("first_seen", "yyyy-MM"),
        }
    )


def _session_count(daily: DataFrame) -> DataFrame:
    sessions = daily.where(F.col("session_id").isNotNull()).select(KEY, "session_id").distinct()
    return sessions.groupBy(KEY).agg(F.count(F.lit(1)).alias("unique_sessions"))


def volume_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    daily = daily_state(log, vocab)
    base = _volume(rollup_features(daily, vocab)).join(_session_count(daily), KEY, "left")
    return base.withColumn("unique_sessions", F.coalesce("unique_sessions", F.lit(0))).select(
        KEY, "total_events", "unique_event_types", "days_active", "unique_sessions",
        "first_seen", "last_seen", "tenure_days", "signup_cohort",
    )


def _canvas(daily: DataFrame) -> DataFrame:
    per_day = daily.where(F.col("canvas_id").isNotNull()).groupBy(KEY, "canvas_id", "day").agg(F.sum("n").alias("n"))
    per_canvas = per_day.groupBy(KEY, "canvas_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))
    return per_canvas.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("unique_canvases"),
        ratio(F.max("n"), F.sum("n")).alias("primary_canvas_event_share"),
        F.count_if(F.col("days") >= 2).alias("repeat_canvas_count_raw"),
        ratio(F.count_if(F.col("days") == 1), F.count(F.lit(1))).alias("one_day_canvas_share"),
    )


def canvas_features(log: DataFrame) -> DataFrame:
    """Distinct canvases, share of the busiest one, canvases seen on two or more days, share seen on one."""
    return _canvas(daily_state(log))


def manual_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return rollup_features(daily_state(log, vocab), vocab).select(KEY, "manual_runs", "manual_run_days")


def _conversations(daily: DataFrame, vocab: Vocabulary) -> DataFrame:
    chats = daily.where(one_of(vocab.agent_start)).select(KEY, "message_id").distinct()
    return chats.groupBy(KEY).agg(F.count("message_id").alias("agent_conversations"))


def agent_start_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    daily = daily_state(log, vocab)
    base = rollup_features(daily, vocab).select(KEY, "agent_messages", "agent_start_days")
    return fill_numeric(base.join(_conversations(daily, vocab), KEY, "left"))


def tool_call_counts(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Calls per user and tool, one row each, for whatever tools there are."""
    calls = log.where(one_of(vocab.tool_events)).select(KEY, tool_of(vocab=vocab).alias("tool"))
    return calls.where(F.col("tool").isNotNull()).groupBy(KEY, "tool").agg(F.count(F.lit(1)).alias("calls"))


def tool_call_columns(log: DataFrame, tools: Sequence[str], vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The same with one column per tool of a given list; other tools are summed in ``tool_other``."""
    counts = tool_call_counts(log, vocab)
    named = F.when(F.col("tool").isin(*tools), F.concat(F.lit("tool_"), "tool")).otherwise("tool_other")
    names = [*(f"tool_{t}" for t in tools), "tool_other"]
    return fill_numeric(counts.withColumn("c", named).groupBy(KEY).pivot("c", names).agg(F.sum("calls")))


def agent_tool_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    base = rollup_features(daily_state(log, vocab), vocab)
    return base.select(
        KEY, "agent_tool_calls_total", "agent_tool_types_used", "agent_tool_call_days",
        *["tool_" + t for t in vocab.tools],
        "agent_build_calls", "agent_run_calls", "agent_inspect_calls", "agent_finish_calls", "agent_delete_calls",
    )


def _transitions(runs: DataFrame) -> DataFrame:
    """Pairs inside the hours are in the state; a pair across hours is the last call of one hour that has
    calls and the first of the next, one row per (user, hour)."""
    names = [*PAIRS, "agent_tool_transitions_total"]
    calls = runs.where(F.col("first_token").isNotNull())
    hours = calls.groupBy(KEY, "slice").agg(
        F.min(F.struct("start", "first_token"))["first_token"].alias("first_token"),
        F.max(F.struct("start", "last_token"))["last_token"].alias("last_token"),
        *[F.sum(name).alias(name) for name in names],
    )
    before = F.lag("last_token").over(Window.partitionBy(KEY).orderBy("slice"))
    hours = hours.withColumn("before", before)
    crossing = {name: (F.col("before") == a) & (F.col("first_token") == b) for name, (a, b) in PAIRS.items()}
    crossing["agent_tool_transitions_total"] = F.col("before").isNotNull()
    out = hours.groupBy(KEY).agg(*[F.sum(F.col(name) + flag(crossing[name])).alias(name) for name in names])
    out = out.where(F.col("agent_tool_transitions_total") > 0)
    total = F.col("agent_tool_transitions_total")
    return out.withColumns(
        {
            "create_run_alternation_rate": ratio(F.col("create_run_transitions"), total),
            "refactor_after_run_rate": ratio(F.col("run_refactor_transitions"), total),
            "finish_summary_rate": ratio(F.col("finish_summary_transitions"), total),
        }
    )


def tool_transition_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Counts of consecutive tool pairs per user and their rates over all pairs."""
    return _transitions(run_state(log.where(one_of(vocab.tool_events)), vocab=vocab))


def output_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return rollup_features(daily_state(log, vocab), vocab).select(KEY, "fullscreen_opens", "previewed_output")


def onboarding_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return rollup_features(daily_state(log, vocab), vocab).select(
        KEY, "signed_up", "completed_onboarding", "skipped_onboarding_form", "submitted_onboarding", "sign_in_count"
    )


def _time_to_first(base: DataFrame) -> DataFrame:
    def minutes(name: str) -> Column:
        return clip(elapsed(name, "signup_at", 60), 0.0, 10080.0)

    base = base.withColumns(
        {
            "ttf_manual_run_min": minutes("first_manual_run_at"),
            "ttf_agent_tool_min": minutes("first_agent_tool_at"),
            "ttf_agent_chat_min": minutes("first_agent_chat_at"),
        }
    )
    # The flag is taken before missing times are filled with 0: no sign-up or no call is not early.
    return base.withColumns(
        {
            "adopted_agent_early": flag(F.col("ttf_agent_tool_min") <= 60),
            "ever_used_agent": flag(F.col("first_agent_tool_at").isNotNull()),
            "ever_ran_manually": flag(F.col("first_manual_run_at").isNotNull()),
        }
    )


def time_to_first_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    base = _time_to_first(rollup_features(daily_state(log, vocab), vocab))
    return base.select(
        KEY, "ttf_manual_run_min", "ttf_agent_tool_min", "ttf_agent_chat_min",
        "adopted_agent_early", "ever_used_agent", "ever_ran_manually",
    )


def observation_end(log: DataFrame) -> Column:
    """Last event time of the log as a scalar subquery."""
    return log.agg(F.max("ts")).scalar()


def credit_recency_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    base = rollup_features(daily_state(log, vocab), vocab)
    return base.select(
        KEY, "credit_events", "had_credit_exceeded", "had_addon_credits",
        elapsed(observation_end(log), "last_seen", 86400).alias("recency_days"),
    )


def native_sessions(daily: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One row per (user, native session) of a daily state. The first step groups by event too, so the
    second sees each event type once and needs no distinct count."""
    per_event = (
        daily.where(F.col("session_id").isNotNull())
        .groupBy(KEY, "session_id", "event")
        .agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    )
    agent = one_of((*vocab.tool_events, *vocab.agent_start))
    return per_event.groupBy(KEY, "session_id").agg(
        F.min("first_ts").alias("start"),
        F.max("last_ts").alias("end"),
        F.sum("n").alias("events"),
        F.count("event").alias("event_types"),
        _ever(agent).alias("had_agent"),
        _ever(one_of(vocab.runs)).alias("had_run"),
    )


def _first_two_sessions(daily: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The two earliest native sessions per user; the rank limit is applied before the shuffle."""
    window = Window.partitionBy(KEY).orderBy("start", "session_id")
    return native_sessions(daily, vocab).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= 2)


def _session_start_features(daily: DataFrame, vocab: Vocabulary) -> DataFrame:
    first, second = F.col("rank") == 1, F.col("rank") == 2

    def of_first(value: Column) -> Column:
        return F.max(F.when(first, value))

    out = _first_two_sessions(daily, vocab).groupBy(KEY).agg(
        of_first(F.col("events")).alias("first_session_events"),
        of_first(F.col("event_types")).alias("first_session_event_types"),
        of_first(elapsed("end", "start", 60)).alias("first_session_duration_min"),
        of_first(F.col("had_agent")).alias("first_session_had_agent"),
        of_first(F.col("had_run")).alias("first_session_had_run"),
        _ever(second).alias("had_second_session"),
        F.max(F.when(first, F.col("start"))).alias("__first"),
        F.max(F.when(second, F.col("start"))).alias("__second"),
    )
    hours = clip(elapsed("__second", "__first", 3600), 0.0, 720.0)
    return out.withColumn("time_to_return_hours", F.coalesce(hours, F.lit(0.0))).drop("__first", "__second")


def first_session_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return _session_start_features(daily_state(log, vocab), vocab).select(
        KEY, "first_session_events", "first_session_event_types", "first_session_duration_min",
        "first_session_had_agent", "first_session_had_run",
    )


def return_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return _session_start_features(daily_state(log, vocab), vocab).select(KEY, "had_second_session", "time_to_return_hours")


def _session_structure(runs: DataFrame, gap_min: float) -> DataFrame:
    sessions = _number_segments(runs, gap_min).groupBy(KEY, "session_num").agg(
        F.sum("events").alias("events"), F.max("built").alias("built"), F.max("ran").alias("ran")
    )
    out = sessions.groupBy(KEY).agg(
        F.count_if((F.col("built") == 1) & (F.col("ran") == 1)).alias("productive_sessions"),
        F.count(F.lit(1)).alias("total_sessions_derived"),
        F.max("events").alias("max_events_per_session"),
    )
    total = F.greatest(F.col("total_sessions_derived"), F.lit(1))
    return out.withColumn("productive_session_share", ratio(F.col("productive_sessions"), total))


def session_structure_features(log: DataFrame, gap_min: float = 30, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Derived sessions: how many, how many both build and run something, the largest."""
    return _session_structure(run_state(log, gap_min, vocab), gap_min)


def _signup_time(base: DataFrame, daily: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Hour and weekday of the sign-up; -1 without one. In a log without any sign-up event the first
    event stands in, which a one-row subquery decides."""
    any_signup = daily.where(F.col("event") == vocab.sign_up).select("event").limit(1).agg(F.count(F.lit(1))).scalar()
    at = F.when(any_signup > 0, F.col("signup_at")).otherwise(F.col("first_seen"))
    none = F.lit(-1)
    return base.withColumns(
        {
            "signup_hour": F.coalesce(F.hour(at), none),
            "signup_dow": F.coalesce(F.weekday(at), none),
            "signup_is_weekend": F.when(at.isNull(), none).otherwise(flag(F.weekday(at) >= 5)),
        }
    )


def signup_time_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return _signup_time(rollup_features(daily_state(log, vocab), vocab), log, vocab).select(KEY, "signup_hour", "signup_dow", "signup_is_weekend")


def earliest_value(log: DataFrame, column: str) -> DataFrame:
    """Earliest non-NULL value of a column per user; on equal times the smaller value."""
    seen = log.where(F.col(column).isNotNull()).groupBy(KEY, column).agg(F.min("ts").alias("at"))
    return seen.groupBy(KEY).agg(F.min(F.struct("at", column))[column].alias(column))


def _referrers(source: DataFrame) -> DataFrame:
    source = source.select(KEY, referrer_class("referrer").alias("referrer_source"))
    return source.select(
        KEY, *[flag(F.col("referrer_source") == c).alias("ref_" + c) for c in REFERRER_CLASSES]
    )


def referrer_features(log: DataFrame) -> DataFrame:
    return _referrers(earliest_value(log, "referrer"))


def assemble_features(log: DataFrame, gap_min: float = 30, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """All families side by side, declared on the log; see ``features_of`` for a written state."""
    return features_of(FeatureState.of(log, gap_min, vocab), vocab)


def features_of(state: FeatureState, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """All families side by side; missing numbers become 0 after the flags are computed."""
    daily, runs = state.daily, state.runs
    base = _signup_time(_time_to_first(_volume(rollup_features(daily, vocab))), daily, vocab)
    end = daily.agg(F.max("last_ts")).scalar()
    base = base.withColumn("recency_days", elapsed(end, "last_seen", 86400))
    base = base.drop("signup_at", "first_manual_run_at", "first_agent_tool_at", "first_agent_chat_at")
    parts = [
        _session_count(daily),
        _canvas(daily),
        _conversations(daily, vocab),
        _transitions(runs),
        _session_start_features(daily, vocab),
        _session_structure(runs, state.gap_min),
        _referrers(earliest_value(daily.withColumnRenamed("first_ts", "ts"), "referrer")),
    ]
    out = base
    for part in parts:
        out = out.join(part, KEY, "left")
    return fill_numeric(out)
