"""Canvas complexity: how elaborate the work on one canvas is and whether it grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import canvas_flags, clip, elapsed, flag, share, with_canvas_id, with_tool
from usagekit.operators.segments import BUILDER, pct_segment
from usagekit.vocabulary import COMPLEXITY_WEIGHTS, DEFAULT, Vocabulary

KEY = "person_id"
FLAG_SUMS = {
    "structural_actions": "is_structural",
    "execution_actions": "is_execution",
    "dependency_actions": "is_dependency",
    "output_actions": "is_output",
    "agent_build_actions": "is_agent_build",
}
USER_COLUMNS = (
    "canvases_touched", "avg_canvas_complexity", "max_canvas_complexity", "repeat_canvas_users", "repeat_canvas_count",
    "avg_canvas_growth", "share_of_canvases_with_growth", "avg_canvas_active_days", "avg_revisit_depth", "avg_later_max_complexity",
)


def complexity_score() -> Column:
    """Weighted sum of the action counts and active days."""
    total = F.lit(0.0)
    for name, weight in COMPLEXITY_WEIGHTS.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(weight)
    return total


def canvas_events(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Events on a canvas with their action flags."""
    flagged = canvas_flags(with_tool(with_canvas_id(log), vocab), vocab)
    return flagged.where(F.col("canvas_id").isNotNull()).select(KEY, "canvas_id", "event", "ts", *FLAG_SUMS.values())


def canvas_days(events: DataFrame) -> DataFrame:
    """(user, canvas, day): action counts, events, first and last time. The only pass over the events."""
    return events.groupBy(KEY, "canvas_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.sum(source).cast("long").alias(name) for name, source in FLAG_SUMS.items()],
    )


def _canvas_totals(days: DataFrame) -> DataFrame:
    """Per canvas: totals, day scores of the first and of later days. The window spans the days of one
    canvas, and shares its partitioning with the aggregation after it."""
    first_day = F.min("day").over(Window.partitionBy(KEY, "canvas_id"))
    scored = days.withColumn("active_days", F.lit(1)).withColumn("day_score", complexity_score())
    scored = scored.withColumn("is_first", F.col("day") == first_day)
    score, later = F.col("day_score"), ~F.col("is_first")
    out = scored.groupBy(KEY, "canvas_id").agg(
        F.sum("events").alias("total_events"),
        F.count(F.lit(1)).alias("active_days"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        *[F.sum(name).alias(name) for name in FLAG_SUMS],
        F.max(F.when(F.col("is_first"), score)).alias("first_day_score"),
        F.coalesce(F.avg(F.when(later, score)), F.lit(0.0)).alias("later_avg_day_score"),
        F.coalesce(F.max(F.when(later, score)), F.lit(0.0)).alias("later_max_day_score"),
        F.count_if(later).alias("later_active_days"),
    )
    growth = F.when(F.col("later_active_days") > 0, F.col("later_max_day_score") - F.col("first_day_score")).otherwise(F.lit(0.0))
    return out.withColumn("growth_delta", growth)


def canvas_complexity(events: DataFrame) -> DataFrame:
    """Score and action totals per (user, canvas)."""
    out = _canvas_totals(canvas_days(events))
    return out.select(KEY, "canvas_id", "total_events", "active_days", *FLAG_SUMS, complexity_score().alias("canvas_complexity_score"))


def first_vs_later_days(events: DataFrame) -> DataFrame:
    """Score of the first day on a canvas against the days after it."""
    return _canvas_totals(canvas_days(events)).select(
        KEY, "canvas_id", "first_day_score", "later_avg_day_score", "later_max_day_score", "later_active_days", "growth_delta"
    )


def canvas_metrics(events: DataFrame) -> DataFrame:
    """All measures per (user, canvas)."""
    out = _canvas_totals(canvas_days(events)).withColumn("canvas_complexity_score", complexity_score())
    repeat = F.col("active_days") >= 2
    return out.withColumns(
        {
            "repeat_canvas": flag(repeat),
            "repeat_growth_delta": F.when(repeat, F.col("growth_delta")).otherwise(F.lit(0.0)),
            "revisit_depth_score": F.when(repeat, F.col("later_max_day_score")).otherwise(F.lit(0.0)),
            "complexity_growth_flag": flag(F.col("growth_delta") > 0),
            "tenure_days_on_canvas": clip(elapsed("last_seen", "first_seen", 86400), low=0.0),
        }
    )


def user_canvas_features(events: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Ten canvas measures per user; joined to ``users`` with 0 for users without a canvas."""
    out = canvas_metrics(events).groupBy(KEY).agg(
        F.count("canvas_id").alias("canvases_touched"),
        F.avg("canvas_complexity_score").alias("avg_canvas_complexity"),
        F.max("canvas_complexity_score").alias("max_canvas_complexity"),
        F.max("repeat_canvas").alias("repeat_canvas_users"),
        F.sum("repeat_canvas").alias("repeat_canvas_count"),
        F.avg("repeat_growth_delta").alias("avg_canvas_growth"),
        F.avg("complexity_growth_flag").alias("share_of_canvases_with_growth"),
        F.avg("active_days").alias("avg_canvas_active_days"),
        F.avg("revisit_depth_score").alias("avg_revisit_depth"),
        F.avg("later_max_day_score").alias("avg_later_max_complexity"),
    )
    if users is None:
        return out
    return users.join(out, KEY, "left").fillna(0, subset=list(USER_COLUMNS))


def growth_by_segment(users: DataFrame) -> DataFrame:
    return users.groupBy("segment").agg(
        F.avg("avg_canvas_growth").alias("avg_growth"),
        (F.avg("share_of_canvases_with_growth") * 100.0).alias("pct_growth"),
        F.count("segment").alias("users"),
    )


def repeat_canvas_retention(users: DataFrame) -> DataFrame:
    label = F.when(F.col("repeat_canvas_users") == 1, F.lit("Repeat canvas")).otherwise(F.lit("One-off canvas"))
    return users.groupBy(label.alias("repeat_canvas_label")).agg(
        F.count("segment").alias("users"),
        F.avg(F.col("days_active").cast("double")).alias("avg_days_active"),
        share(F.col("had_second_session") == 1).alias("repeat_session_pct"),
        pct_segment(BUILDER).alias("agent_builder_pct"),
    )
