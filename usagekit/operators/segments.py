"""Rule-based user segments and their profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.functions.derive import adoption_cohort, first_match, share
from usagekit.functions.stats import column_max_share

BUILDER, RUNNER, CODER, VIEWER, GHOST = "Agent Builder", "Agent Runner", "Manual Coder", "Viewer", "Ghost"
SEGMENT_ORDER = (BUILDER, RUNNER, CODER, VIEWER, GHOST)


@dataclass(frozen=True)
class SegmentRules:
    """Cut values of the ordered rules; the defaults are the product's own."""

    ghost_max_events: int = 5
    builder_min_builds: int = 3
    runner_min_runs: int = 3
    runner_min_conversations: int = 2
    coder_min_runs: int = 3


def segment_of(rules: SegmentRules = SegmentRules()) -> Column:
    agent = F.col("ever_used_agent") >= 1
    return first_match(
        {
            GHOST: (F.col("total_events") <= rules.ghost_max_events) | (F.col("days_active") == 0),
            BUILDER: agent & (F.col("agent_build_calls") >= rules.builder_min_builds),
            RUNNER: agent
            & (
                (F.col("agent_run_calls") >= rules.runner_min_runs)
                | (F.col("agent_conversations") >= rules.runner_min_conversations)
            ),
            CODER: F.col("manual_runs") >= rules.coder_min_runs,
        },
        default=VIEWER,
    )


def assign_segment(users: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    return users.withColumn("segment", segment_of(rules))


def with_adoption(users: DataFrame) -> DataFrame:
    return users.withColumn("adoption_cohort", adoption_cohort())


def is_segment(name: str) -> Column:
    return F.col("segment") == name


def pct_segment(name: str) -> Column:
    return share(is_segment(name))


def _mean(name: str) -> Column:
    return F.avg(F.col(name).cast("double"))


PROFILE_METRICS = ("avg_days_active", "avg_manual_runs", "avg_agent_tools", "avg_build_calls", "avg_run_calls", "avg_canvases")


def segment_summary(users: DataFrame) -> DataFrame:
    """Size, share of all users and mean activity per segment."""
    out = users.groupBy("segment").agg(
        F.count("total_events").alias("users"),
        _mean("days_active").alias("avg_days_active"),
        _mean("manual_runs").alias("avg_manual_runs"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"),
        _mean("agent_build_calls").alias("avg_build_calls"),
        _mean("agent_run_calls").alias("avg_run_calls"),
        _mean("agent_conversations").alias("avg_conversations"),
        _mean("unique_canvases").alias("avg_canvases"),
        _mean("had_credit_exceeded").alias("pct_credit_exceeded"),
    )
    total = F.sum("users").over(_everything())
    return out.withColumn("pct_of_users", F.col("users") * 100.0 / total)


def _everything():
    """Window over a whole summary table (a handful of rows)."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def segment_profile(users: DataFrame) -> DataFrame:
    """Segment means divided by the largest segment mean."""
    return column_max_share(segment_summary(users).select("segment", *PROFILE_METRICS), PROFILE_METRICS)


def kpi_matrix(users: DataFrame, by: str = "segment") -> DataFrame:
    """Seventeen KPIs per segment."""
    days = F.col("days_active")
    every = users.agg(F.count("total_events")).scalar()
    return users.groupBy(by).agg(
        F.count("total_events").alias("users"),
        _mean("days_active").alias("avg_days_active"),
        F.median(days).alias("median_days_active"),
        _mean("manual_runs").alias("avg_manual_runs"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"),
        _mean("agent_build_calls").alias("avg_agent_build"),
        _mean("agent_conversations").alias("avg_conversations"),
        _mean("unique_canvases").alias("avg_canvases"),
        _mean("agent_tool_types_used").alias("avg_tool_types"),
        _mean("unique_event_types").alias("avg_unique_event_types"),
        share(days >= 3).alias("pct_multi_day"),
        share(days >= 7).alias("pct_week_plus"),
        share(F.col("had_credit_exceeded") == 1).alias("pct_credit_exceeded"),
        share(F.col("had_addon_credits") == 1).alias("pct_addon_credits"),
        share(F.col("ever_used_agent") == 1).alias("pct_ever_agent"),
        share(F.col("adopted_agent_early") == 1).alias("pct_early_adopter"),
    ).withColumn("pct_of_users", F.col("users") * 100.0 / F.nullif(every, F.lit(0)))


KPI_HEAT = (
    "avg_days_active", "avg_manual_runs", "avg_agent_tools", "avg_agent_build", "avg_canvases",
    "pct_multi_day", "pct_week_plus", "pct_credit_exceeded", "pct_ever_agent", "pct_early_adopter",
)


def kpi_heat(users: DataFrame) -> DataFrame:
    return column_max_share(kpi_matrix(users).select("segment", *KPI_HEAT), KPI_HEAT)


def kpi_by_cohort(users: DataFrame) -> DataFrame:
    return users.groupBy("signup_cohort").agg(
        F.count("total_events").alias("users"),
        _mean("days_active").alias("avg_days_active"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"),
        pct_segment(BUILDER).alias("pct_agent_builder"),
        pct_segment(RUNNER).alias("pct_agent_runner"),
        share(F.col("segment").isin(BUILDER, RUNNER)).alias("pct_power_user"),
        pct_segment(GHOST).alias("pct_ghost"),
        share(F.col("ever_used_agent") == 1).alias("pct_ever_agent"),
    )


def success_by_segment(users: DataFrame) -> DataFrame:
    """The evidence table behind the success definition."""
    days = F.col("days_active")
    return users.groupBy("segment").agg(
        F.count("total_events").alias("users"),
        _mean("days_active").alias("avg_days"),
        F.median(days).alias("median_days"),
        _mean("agent_tool_calls_total").alias("avg_agent_tools"),
        _mean("agent_build_calls").alias("avg_build_calls"),
        _mean("agent_tool_types_used").alias("avg_tool_types"),
        share(days >= 3).alias("pct_multi_day"),
        share(F.col("had_credit_exceeded") == 1).alias("pct_credit_exceeded"),
        share(F.col("had_second_session") == 1).alias("pct_returned"),
        _mean("first_session_events").alias("avg_first_sess_events"),
    )
