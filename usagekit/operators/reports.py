"""Report tables over the user matrix and the log: cohorts, funnels, hours, credits, overview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import (
    one_of, bucketize, clip, elapsed, flag, hour_band, label_rank, ratio, return_cohort, share, weekend_label,
)
from usagekit.functions.stats import column_max_share, describe, describe_exact, exact_quantiles, group_share
from usagekit.operators.segments import BUILDER, CODER, GHOST, RUNNER, VIEWER, pct_segment
from usagekit.vocabulary import DEFAULT, EVENT_FUNNEL, SEGMENTS, Vocabulary

KEY = "person_id"


def _mean(name: str) -> Column:
    return F.avg(F.col(name).cast("double"))


def _pct(name: str) -> Column:
    return share(F.col(name) == 1)


# ----------------------------------------------------------------------------- funnels


def funnel_steps() -> dict[str, Column]:
    return {
        "Registered": F.col("signed_up") >= 1,
        "Ran code manually": F.col("manual_runs") >= 1,
        "Started agent chat": F.col("agent_conversations") >= 1,
        "Used agent tool": F.col("agent_tool_calls_total") >= 1,
        "Agent built": F.col("agent_build_calls") >= 1,
        "5+ active days": F.col("days_active") >= 5,
    }


def activation_steps() -> dict[str, Column]:
    return {
        "Registered": F.lit(True),
        "Ran >=1 tool": F.col("agent_tool_calls_total") > 0,
        "Used AI agent": F.col("ever_used_agent") == 1,
        "Agent Builder": F.col("segment") == BUILDER,
    }


def funnel(users: DataFrame, steps: Mapping[str, Column] | None = None) -> DataFrame:
    """Users per step, percent of the first step, loss against the previous step.

    One aggregation over the users; the ordered comparison runs over the handful of steps.
    """
    steps = funnel_steps() if steps is None else steps
    names = list(steps)
    wide = users.agg(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("step"), F.count_if(c).alias("users")).alias(f"s{i}") for i, (n, c) in enumerate(steps.items())]
    )
    rows = wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))
    order = Window.partitionBy(F.lit(1)).orderBy("position")
    first = F.first("users").over(order)
    lost = F.lag("users").over(order) - F.col("users")
    return rows.select(
        "position", "step", "users", ratio(F.col("users") * 100.0, first).alias("pct_of_first"),
        F.coalesce(lost, F.lit(0)).alias("lost"), F.coalesce(ratio(lost * 100.0, first), F.lit(0.0)).alias("lost_pct_of_first"),
    )


def funnel_by_cohort(users: DataFrame) -> DataFrame:
    def pct(condition: Column) -> Column:
        return share(condition)

    return users.groupBy("signup_cohort").agg(
        F.count(F.lit(1)).alias("registered"),
        F.count_if(F.col("manual_runs") >= 1).alias("ran_code"),
        F.count_if(F.col("agent_tool_calls_total") >= 1).alias("used_tool"),
        F.count_if(F.col("agent_build_calls") >= 1).alias("built"),
        F.count_if(F.col("days_active") >= 5).alias("five_days"),
        pct(F.col("manual_runs") >= 1).alias("ran_code_pct"),
        pct(F.col("agent_tool_calls_total") >= 1).alias("used_tool_pct"),
        pct(F.col("agent_build_calls") >= 1).alias("built_pct"),
        pct(F.col("days_active") >= 5).alias("five_days_pct"),
    )


def event_funnel(log: DataFrame, events: Sequence[str] = EVENT_FUNNEL) -> DataFrame:
    """Distinct users per named event; an event nobody fired stays with 0."""
    per_user = log.where(one_of(events)).groupBy(KEY, "event").agg(F.lit(1).alias("one"))
    wide = per_user.agg(
        *[F.struct(F.lit(i).alias("position"), F.lit(e).alias("stage"), F.count_if(F.col("event") == e).alias("users")).alias(f"s{i}") for i, e in enumerate(events)]
    )
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(events))])))


# ----------------------------------------------------------------------------- cohorts


def cohort_summary(users: DataFrame) -> DataFrame:
    out = users.groupBy("signup_cohort").agg(
        F.count("total_events").alias("users"),
        _mean("days_active").alias("avg_days_active"),
        _mean("manual_runs").alias("avg_manual_runs"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"),
        _mean("unique_canvases").alias("avg_canvases"),
        _mean("agent_conversations").alias("avg_conversations"),
        _pct("ever_used_agent").alias("pct_ever_agent"),
        _pct("adopted_agent_early").alias("pct_early_adopter"),
        _pct("had_credit_exceeded").alias("pct_credit_exceeded"),
    )
    return out.join(exact_quantiles(users, "tenure_days", {"median_tenure_days": 0.5}, ["signup_cohort"]), "signup_cohort")


def crosstab_pct(users: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised percentages of a crosstab with a fixed set of columns."""
    wide = users.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(row, *[(F.col(v) * 100.0 / F.nullif(total, F.lit(0))).alias(v) for v in values])


ADOPTION = ("Early adopter (<1h)", "Late adopter (1h+)", "Never adopted")
ADOPTION_METRICS = ("avg_days_active", "avg_manual_runs", "avg_agent_tools", "avg_build_calls", "avg_canvases", "pct_credit_exceeded")


def adoption_summary(users: DataFrame) -> DataFrame:
    out = users.groupBy("adoption_cohort").agg(
        F.count("total_events").alias("users"),
        _mean("days_active").alias("avg_days_active"),
        _mean("manual_runs").alias("avg_manual_runs"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"),
        _mean("agent_build_calls").alias("avg_build_calls"),
        _mean("unique_canvases").alias("avg_canvases"),
        _pct("had_credit_exceeded").alias("pct_credit_exceeded"),
    )
    out = out.join(exact_quantiles(users, "tenure_days", {"median_tenure": 0.5}, ["adoption_cohort"]), "adoption_cohort")
    return out.withColumn("pct_of_users", F.col("users") * 100.0 / F.sum("users").over(Window.partitionBy(F.lit(1))))


def adoption_profile(users: DataFrame) -> DataFrame:
    summary = users.groupBy("adoption_cohort").agg(
        _mean("days_active").alias("avg_days_active"), _mean("manual_runs").alias("avg_manual_runs"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"), _mean("agent_build_calls").alias("avg_build_calls"),
        _mean("unique_canvases").alias("avg_canvases"), _pct("had_credit_exceeded").alias("pct_credit_exceeded"),
    )
    return column_max_share(summary, ADOPTION_METRICS)


def adoption_by_segment(users: DataFrame) -> DataFrame:
    counts = users.where(F.col("segment") != GHOST).groupBy("segment").pivot("adoption_cohort", list(ADOPTION)).agg(F.count(F.lit(1)))
    return counts.fillna(0, subset=list(ADOPTION)).unpivot(["segment"], list(ADOPTION), "adoption_cohort", "users")


TIMING_EDGES = (0, 15, 60, 240, 1440, 10080)
TIMING_LABELS = ("<15 min", "15-60 min", "1-4 hours", "4-24 hours", "1-7 days")


def adoption_timing(users: DataFrame, exclude_missing: bool = False) -> DataFrame:
    """Agent users by time to the first tool call and segment.

    A missing time was filled with 0 and lands in the first bucket; the cap value lies outside all.
    """
    minutes = F.col("ttf_agent_tool_min")
    rows = users.where(F.col("ever_used_agent") == 1)
    if exclude_missing:
        rows = rows.where(minutes > 0)
    bucket = bucketize(minutes, TIMING_EDGES, TIMING_LABELS, right=False)
    rows = rows.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    wide = rows.groupBy("bucket").pivot("segment", list(SEGMENTS)).agg(F.count(F.lit(1))).fillna(0, subset=list(SEGMENTS))
    return wide.withColumn("bucket_order", label_rank("bucket", TIMING_LABELS))


def distribution_stats(df: DataFrame, value: str, by: str = "segment", cap: float | None = None, min_n: int = 1, skip_zero: bool = False) -> DataFrame:
    """Quartiles, mean, extremes and count behind a box plot; small groups are left out."""
    v = F.col(value).cast("double")
    rows = df.select(by, v.alias("value")).where(F.col("value").isNotNull() & F.col(by).isNotNull())
    if skip_zero:
        rows = rows.where(F.col("value") != 0)
    if cap is not None:
        rows = rows.withColumn("value", clip(F.col("value"), high=float(cap)))
    return describe_exact(rows, "value", [by]).where(F.col("n") >= min_n)


# ----------------------------------------------------------------------------- sign-up time, return


def signup_hour_stats(users: DataFrame) -> DataFrame:
    return users.where(F.col("signup_hour") >= 0).groupBy("signup_hour").agg(
        F.count("segment").alias("users"),
        F.count_if(F.col("segment") == BUILDER).alias("agent_builders"),
        pct_segment(BUILDER).alias("pct_ab"),
        pct_segment(GHOST).alias("pct_ghost"),
        _pct("ever_used_agent").alias("pct_agent_user"),
        _mean("first_session_events").alias("avg_first_sess"),
    )


def hour_band_stats(users: DataFrame) -> DataFrame:
    return users.where(F.col("signup_hour") >= 0).groupBy(hour_band("signup_hour").alias("time_category")).agg(
        F.count("segment").alias("users"),
        pct_segment(BUILDER).alias("pct_ab"),
        pct_segment(GHOST).alias("pct_ghost"),
        _mean("first_session_events").alias("avg_first_sess"),
        _pct("had_second_session").alias("pct_returned"),
    )


def weekend_stats(users: DataFrame) -> DataFrame:
    return users.groupBy(weekend_label("signup_is_weekend").alias("signup_is_weekend")).agg(
        F.count("segment").alias("users"),
        pct_segment(BUILDER).alias("pct_ab"),
        pct_segment(GHOST).alias("pct_ghost"),
        _mean("first_session_events").alias("avg_first"),
        _pct("had_second_session").alias("pct_ret"),
    )


def return_cohort_stats(users: DataFrame) -> DataFrame:
    return users.groupBy(return_cohort().alias("return_cohort")).agg(
        F.count("days_active").alias("users"), pct_segment(BUILDER).alias("pct_ab"), _mean("days_active").alias("avg_days")
    )


def _per_case(users: DataFrame, cases: list[list[Column]]) -> DataFrame:
    """One aggregation that returns one row per case; every case is a list of aliased aggregates."""
    wide = users.agg(*[F.struct(*case).alias(f"c{i}") for i, case in enumerate(cases)])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cases))])))


def return_threshold_sweep(users: DataFrame, hours: Sequence[int] = (6, 12, 24, 48, 72, 168)) -> DataFrame:
    """Builder share of users who return within each number of hours, and of those who return later."""
    returned, builder = F.col("had_second_session") == 1, F.col("segment") == BUILDER

    def pct(inside: Column) -> Column:
        return F.coalesce(F.avg(F.when(inside, F.when(builder, 100.0).otherwise(0.0))), F.lit(0.0))

    cases = []
    for t in hours:
        early, late = returned & (F.col("time_to_return_hours") <= t), returned & (F.col("time_to_return_hours") > t)
        cases.append([
            F.lit(t).alias("threshold_h"), F.count_if(early).alias("n_early"), pct(early).alias("pct_ab_early"),
            F.count_if(late).alias("n_late"), pct(late).alias("pct_ab_late"),
        ])
    return _per_case(users, cases)


def threshold_sweep(users: DataFrame, builds: Sequence[int] = tuple(range(1, 10))) -> DataFrame:
    """Users and means above each build-call cut; a cut with nobody above or below it gives no row."""
    calls = F.col("agent_build_calls")
    cases = []
    for t in builds:
        above = calls >= t
        cases.append([
            F.lit(t).alias("threshold"), F.count_if(above).alias("users"),
            F.avg(F.when(above, F.col("days_active").cast("double"))).alias("avg_days"),
            F.avg(F.when(above, F.col("agent_tool_calls_total").cast("double"))).alias("avg_tool_calls"),
            F.count_if((calls < t) & (calls > 0)).alias("below"),
        ])
    return _per_case(users, cases).where((F.col("users") > 0) & (F.col("below") > 0)).drop("below")


def success_definitions() -> dict[str, Column]:
    return {
        "Agent Builder (>=3 build calls)": F.col("agent_build_calls") >= 3,
        "Any agent use": F.col("ever_used_agent") == 1,
        "5+ active days": F.col("days_active") >= 5,
        "Manual runs (>=3)": F.col("manual_runs") >= 3,
        "Returned (second session)": F.col("had_second_session") == 1,
    }


def definition_compare(users: DataFrame, definitions: Mapping[str, Column] | None = None) -> DataFrame:
    """Reach and depth of alternative success definitions, in one pass."""
    definitions = success_definitions() if definitions is None else definitions

    def within(condition: Column, value: Column) -> Column:
        return F.avg(F.when(condition, value))

    return _per_case(users, [
        [
            F.lit(name).alias("definition"), share(c).alias("pct_of_users"),
            within(c, F.col("days_active").cast("double")).alias("avg_days"),
            within(c, F.col("agent_tool_calls_total").cast("double")).alias("avg_tools"),
            within(c, F.when(F.col("had_credit_exceeded") == 1, 100.0).otherwise(0.0)).alias("pct_credit"),
        ]
        for name, c in definitions.items()
    ])


def segment_separability(users: DataFrame) -> DataFrame:
    return users.where(F.col("segment").isin(BUILDER, CODER, VIEWER)).select(
        KEY, "segment",
        clip(F.col("time_to_return_hours"), 0.0, 200.0).alias("time_to_return_clip"),
        clip(F.col("first_session_events"), 0, 50).cast("long").alias("first_sess_clip"),
    )


def credit_pressure_ratio(users: DataFrame) -> DataFrame:
    """How much more often builders run out of credits than ghosts."""
    exceeded = F.when(F.col("had_credit_exceeded") == 1, 1.0).otherwise(0.0)
    out = users.agg(
        F.coalesce(F.avg(F.when(F.col("segment") == BUILDER, exceeded)), F.lit(0.0)).alias("builder_rate"),
        F.coalesce(F.avg(F.when(F.col("segment") == GHOST, exceeded)), F.lit(0.0)).alias("ghost_rate"),
    )
    return out.withColumn("pressure_ratio", F.col("builder_rate") / F.greatest(F.col("ghost_rate"), F.lit(0.001)))


# ----------------------------------------------------------------------------- credits and errors

# Edges and names of the burn buckets; the last is open.
BURN_EDGES = (-0.1, 0, 5, 20, 50, 100, float("inf"))
BURN_LABELS = ("0 (none)", "1-5", "6-20", "21-50", "51-100", "100+")


def credit_burn(users: DataFrame, log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Credit events per active day of every user."""
    counts = log.where(one_of(vocab.credit_use)).groupBy(KEY).agg(F.count(F.lit(1)).alias("credit_uses"))
    out = users.select(KEY, "segment", "signup_cohort", "days_active").join(counts, KEY, "left").fillna(0, subset=["credit_uses"])
    return out.withColumn("burn_rate", F.col("credit_uses") / F.greatest(F.col("days_active"), F.lit(1)))


def burn_by_segment(burn: DataFrame) -> DataFrame:
    out = burn.groupBy("segment").agg(
        F.count("burn_rate").alias("users"), F.avg("burn_rate").alias("avg_burn"), share(F.col("credit_uses") > 0).alias("pct_any_burn")
    )
    return out.join(exact_quantiles(burn, "burn_rate", {"median_burn": 0.5}, ["segment"]), "segment")


def burn_by_bucket(burn: DataFrame) -> DataFrame:
    bucket = bucketize("burn_rate", BURN_EDGES, BURN_LABELS)
    return burn.withColumn("burn_bucket", bucket).where(F.col("burn_bucket").isNotNull()).groupBy("burn_bucket").agg(
        F.count("segment").alias("users"), pct_segment(BUILDER).alias("pct_ab")
    )


def first_error(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """First event and first error-assist of each user, hours between them (0..720)."""
    out = log.groupBy(KEY).agg(
        F.min("ts").alias("first_seen"), F.min(F.when(F.col("event") == vocab.error_assist, F.col("ts"))).alias("first_error_at")
    )
    return out.withColumn("hours_to_error", clip(elapsed("first_error_at", "first_seen", 3600), 0.0, 720.0))


def error_assist_contrast(users: DataFrame, log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Users with and without an error-assist event."""
    errors = log.where(F.col("event") == vocab.error_assist).select(KEY).distinct().withColumn("had_error_assist", F.lit(1))
    labelled = users.select(KEY, "segment", "days_active", "agent_tool_calls_total").join(errors, KEY, "left").fillna(0, subset=["had_error_assist"])
    return labelled.groupBy("had_error_assist").agg(
        F.count("segment").alias("users"),
        *[pct_segment(s).alias("pct_" + s.lower().replace(" ", "_")) for s in SEGMENTS],
        _mean("days_active").alias("avg_days"),
        _mean("agent_tool_calls_total").alias("avg_tools"),
    )


def error_timing(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return describe_exact(first_error(log, vocab).where(F.col("hours_to_error").isNotNull()), "hours_to_error")


# ----------------------------------------------------------------------------- overview of the log


def log_overview(log: DataFrame) -> DataFrame:
    """One row: events, users, browser ids, event types, time range, missing times.

    Each distinct count is its own two-step aggregation over one pruned column.
    """
    rows = log.agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
        F.count_if(F.col("ts").isNull()).alias("missing_times"),
    )
    return rows.select(
        "*",
        log.select(F.count_distinct(KEY)).scalar().alias("users"),
        log.select(F.count_distinct("distinct_id")).scalar().alias("browser_ids"),
        log.select(F.count_distinct("event")).scalar().alias("event_types"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequency and share of the values of a column, NULL left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column)).scalar()
    counts = counts.withColumn("pct", F.col("n") * 100.0 / F.nullif(total, F.lit(0)))
    return counts if top is None else counts.orderBy(F.desc("n"), "value").limit(top)


def hourly_volume(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def country_volume(log: DataFrame) -> DataFrame:
    """Browser ids and events per country; counted per (country, id) first, so no distinct count is needed."""
    per_id = log.where(F.col("country_code").isNotNull()).groupBy("country_code", "distinct_id").agg(F.count("event").alias("n"))
    return per_id.groupBy("country_code").agg(F.count("distinct_id").alias("users"), F.sum("n").alias("events"))


def session_depth(log: DataFrame) -> DataFrame:
    """Distribution of events per native session."""
    return describe(log.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("event").alias("n")), "n")


# ----------------------------------------------------------------------------- success reports

# Edges and names of the buckets. Times are clipped at 10080 minutes; the clipped ones have a row of their own.
VALUE_EDGES = (0, 5, 15, 30, 60, 120, 240, 480, 10080, float("inf"))
VALUE_LABELS = ("<5m", "5-15m", "15-30m", "30-60m", "1-2h", "2-4h", "4-8h", ">8h", "clipped (1w+)")
FLYWHEEL_EDGES = (-1, 0, 1, 5, 20, 100, float("inf"))
FLYWHEEL_LABELS = ("0 (none)", "1", "2-5", "6-20", "21-100", "100+")


def time_to_value_curve(labelled: DataFrame, minutes: str = "ttf_manual_run_min") -> DataFrame:
    """Success rate by time to the first run, for users with a positive time."""
    bucket = bucketize(F.when(F.col(minutes) > 0, F.col(minutes)), VALUE_EDGES, VALUE_LABELS, right=False)
    return labelled.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count("is_success").alias("users"), _pct("is_success").alias("success_pct")
    )


def volume_flywheel(labelled: DataFrame) -> DataFrame:
    """Success rate and runs by amount of agent activity."""
    bucket = bucketize("agent_total_events", FLYWHEEL_EDGES, FLYWHEEL_LABELS)
    return labelled.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count("is_success").alias("users"), _pct("is_success").alias("success_pct"), _mean("total_code_runs").alias("avg_code_runs")
    )


def headline_rates(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("segment") == BUILDER).alias("agent_builders"),
        F.count_if(F.col("segment") == GHOST).alias("ghosts"),
        _pct("ever_used_agent").alias("pct_agent"),
        _pct("had_second_session").alias("pct_return"),
        _pct("adopted_agent_early").alias("pct_early"),
        F.avg(F.when(F.col("in_churn_population") == 1, F.col("is_churn") * 100.0)).alias("churn_rate"),
    )


def dashboard_segments(users: DataFrame) -> DataFrame:
    out = users.groupBy("segment").agg(
        F.count("segment").alias("users"),
        _mean("days_active").alias("avg_days"),
        _mean("agent_tool_calls_total").alias("avg_tools"),
        _mean("agent_build_calls").alias("avg_builds"),
        _pct("had_second_session").alias("pct_return"),
        _pct("had_credit_exceeded").alias("pct_credit"),
    )
    return out.withColumn("pct_of_users", F.col("users") * 100.0 / F.sum("users").over(Window.partitionBy(F.lit(1))))


def dashboard_cohorts(users: DataFrame) -> DataFrame:
    return users.groupBy("signup_cohort").agg(
        F.count("segment").alias("users"), pct_segment(BUILDER).alias("pct_ab"),
        _pct("ever_used_agent").alias("pct_agent"), _mean("agent_tool_calls_total").alias("avg_tools"),
    )
