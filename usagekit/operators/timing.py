"""When users reach milestones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import one_of, clip, elapsed, flag, is_build, share
from usagekit.functions.stats import beside, exact_quantiles
from usagekit.operators.segments import BUILDER
from usagekit.vocabulary import DEFAULT, Vocabulary

KEY = "person_id"


def signup_times(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Earliest sign-up per user, the first event where there is none."""
    return log.groupBy(KEY).agg(
        F.coalesce(F.min(F.when(F.col("event") == vocab.sign_up, F.col("ts"))), F.min("ts")).alias("signup_at")
    )


def kth_event(log: DataFrame, condition: Column, k: int) -> DataFrame:
    """Time of a user's k-th matching event; the rank limit drops later rows before the shuffle."""
    window = Window.partitionBy(KEY).orderBy("ts", "event_id")
    ranked = log.where(condition).select(KEY, "ts", "event_id").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") == k).select(KEY, F.col("ts").alias("reached_at"))


def time_to_kth(log: DataFrame, k: int = 3, condition: Column | None = None, cap_days: float = 120.0, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Days from sign-up to the k-th build call, limited to 0..cap, for the users who reach it."""
    condition = is_build(vocab=vocab) if condition is None else condition
    reached = kth_event(log, condition, k)
    out = signup_times(log, vocab).join(reached, KEY)
    return out.withColumn("days_to_kth", clip(elapsed("reached_at", "signup_at", 86400), 0.0, cap_days))


def time_to_kth_summary(times: DataFrame, by: Sequence[str] = (), within: Sequence[int] = (1, 3, 7, 14, 30, 60)) -> DataFrame:
    """Count, mean, quantiles and the share that arrives within each number of days."""
    days = F.col("days_to_kth")
    counted = times.groupBy(*by).agg(
        F.count(days).alias("users"),
        F.avg(days).alias("mean_days"),
        F.min(days).alias("min_days"),
        F.max(days).alias("max_days"),
        *[share(days <= d).alias(f"pct_within_{d}d") for d in within],
    )
    spread = exact_quantiles(times, "days_to_kth", {"p25_days": 0.25, "median_days": 0.5, "p75_days": 0.75, "p90_days": 0.9}, by)
    if by:
        return counted.join(spread, list(by))
    return beside(counted, spread)


MILESTONES = (
    "ran_code_48h", "opened_agent_48h", "used_agent_tool_48h", "created_block_48h", "refactored_48h", "reached_3_build_48h",
    "fullscreen_48h", "returned_within_48h", "had_10plus_events_48h", "had_5plus_event_types",
)


def milestone_flags(log: DataFrame, hours: float = 48, anchor: str = "first_seen", vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Ten 0/1 flags per user over the first hours after the anchor: the first event, or the sign-up.

    The window is cut first and then counted per (user, event), so only a user's early events are
    aggregated and each event type appears once in the last step. After the first event only the days of
    the window can hold early events: the anchor is joined on user and day, and the rest of the log drops out.
    With the sign-up as anchor earlier events count too, and the join is on the user.
    """
    if anchor == "first_seen":
        start = log.groupBy(KEY).agg(F.min("ts").alias("anchor"))
    else:
        start = signup_times(log, vocab).withColumnRenamed("signup_at", "anchor")
    since = F.unix_micros("ts") - F.unix_micros("anchor")
    rows = log.select(KEY, "event", "ts")
    if anchor == "first_seen":
        until = F.timestamp_micros(F.unix_micros("anchor") + F.lit(int(hours * 3_600_000_000)))
        days = start.select(KEY, "anchor", F.explode(F.sequence(F.to_date("anchor"), F.to_date(until))).alias("day"))
        joined = rows.withColumn("day", F.to_date("ts")).join(days, [KEY, "day"])
    else:
        joined = rows.join(start, KEY)
    early = joined.where(since <= F.lit(int(hours * 3_600_000_000)))
    per_event = early.groupBy(KEY, "event").agg(F.count(F.lit(1)).alias("n"), F.max(since).alias("latest"))
    event, n = F.col("event"), F.col("n")

    def any_of(*names: str) -> Column:
        return F.max(flag(one_of(names)))

    return per_event.groupBy(KEY).agg(
        any_of(*vocab.runs).alias("ran_code_48h"),
        any_of(*vocab.chat_start).alias("opened_agent_48h"),
        any_of(*vocab.tool_events).alias("used_agent_tool_48h"),
        any_of(vocab.build_events[0]).alias("created_block_48h"),
        any_of(vocab.build_events[1]).alias("refactored_48h"),
        flag(F.sum(F.when(one_of(vocab.build_events), n).otherwise(0)) >= 3).alias("reached_3_build_48h"),
        any_of(*vocab.fullscreen).alias("fullscreen_48h"),
        flag(F.max("latest") >= F.lit(12 * 3_600_000_000)).alias("returned_within_48h"),
        flag(F.sum(n) >= 10).alias("had_10plus_events_48h"),
        flag(F.count(event) >= 5).alias("had_5plus_event_types"),
    )


def contrast_lift(df: DataFrame, flags: Sequence[str], target: Column, inf_value: float = 999.0) -> DataFrame:
    """Per flag: target percentage with and without it, their ratio, reach and count."""
    base = df.select(*flags, flag(target).alias("target"))
    long = base.unpivot(["target"], list(flags), "milestone", "did")
    out = long.groupBy("milestone").agg(
        F.coalesce(F.avg(F.when(F.col("did") == 1, F.col("target") * 100.0)), F.lit(0.0)).alias("pct_if_did"),
        F.coalesce(F.avg(F.when(F.col("did") == 0, F.col("target") * 100.0)), F.lit(0.0)).alias("pct_if_not"),
        share(F.col("did") == 1).alias("pct_users"),
        F.count_if(F.col("did") == 1).alias("n_did"),
    )
    lift = F.coalesce(F.col("pct_if_did") / F.nullif(F.col("pct_if_not"), F.lit(0.0)), F.lit(inf_value))
    return out.withColumn("lift", lift)


def milestone_lift(log: DataFrame, users: DataFrame, hours: float = 48) -> DataFrame:
    flags = milestone_flags(log, hours).join(users.select(KEY, "segment"), KEY, "left")
    return contrast_lift(flags, MILESTONES, F.col("segment") == BUILDER)
