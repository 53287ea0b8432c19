"""Country and region reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.functions.derive import country_group, region_of, share
from usagekit.functions.stats import min_max, value_ranges, wilson_interval
from usagekit.operators.features import earliest_value
from usagekit.operators.segments import BUILDER, CODER, GHOST, VIEWER, pct_segment
from usagekit.vocabulary import DEFAULT, Vocabulary

KEY = "person_id"


def user_country(log: DataFrame) -> DataFrame:
    """Most frequent country of a user; the smaller code on ties. Counted per (user, country) first."""
    counts = log.where(F.col("country_code").isNotNull()).groupBy(KEY, "country_code").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "country_code"))
    return counts.groupBy(KEY).agg(best["country_code"].alias("country_code"))


def signup_events(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return log.where((F.col("event") == vocab.sign_up) & F.col("country_code").isNotNull())


def country_hour_matrix(log: DataFrame, top: int = 6, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Share of the leading sign-up countries in each UTC hour (percent of the hour's leading-country sign-ups)."""
    counts = signup_events(log, vocab).groupBy("country_code", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("signups"))
    leaders = counts.groupBy("country_code").agg(F.sum("signups").alias("total")).orderBy(F.desc("total"), "country_code").limit(top)
    kept = counts.join(F.broadcast(leaders.select("country_code")), "country_code")
    pct = F.col("signups") * 100.0 / F.sum("signups").over(Window.partitionBy("hour"))
    return kept.withColumn("pct", pct)


def night_day_countries(log: DataFrame, top: int = 8, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Leading sign-up countries of the night (0-5h) and of working hours (9-17h)."""
    hour = F.hour("ts")
    period = F.when(hour.between(0, 5), F.lit("night")).when(hour.between(9, 17), F.lit("day"))
    counts = (
        signup_events(log, vocab).withColumn("period", period).where(F.col("period").isNotNull())
        .groupBy("period", "country_code").agg(F.count(F.lit(1)).alias("signups"))
    )
    group = Window.partitionBy("period")
    counts = counts.withColumn("pct", F.col("signups") * 100.0 / F.sum("signups").over(group))
    rank = F.row_number().over(group.orderBy(F.desc("signups"), "country_code"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def country_stats(users: DataFrame, log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Builder, ghost and agent shares by the country of a user's first sign-up."""
    first = earliest_value(signup_events(log, vocab), "country_code")
    labelled = users.select(KEY, "segment", "ever_used_agent").join(first, KEY, "left")
    return labelled.groupBy(country_group("country_code").alias("country_group")).agg(
        F.count("segment").alias("users"),
        pct_segment(BUILDER).alias("pct_ab"),
        pct_segment(GHOST).alias("pct_ghost"),
        share(F.col("ever_used_agent") == 1).alias("pct_agent"),
    )


def with_country(users: DataFrame, log: DataFrame) -> DataFrame:
    out = users.join(user_country(log), KEY, "left").withColumn("country_code", F.coalesce("country_code", F.lit("Unknown")))
    return out.withColumn("region_group", region_of("country_code"))


def _mean(name: str) -> Column:
    return F.avg(F.coalesce(F.col(name).cast("double"), F.lit(0.0)))


def geo_metrics(users: DataFrame) -> DataFrame:
    """Ten measures per country with the Wilson interval of the builder share.

    ``users`` comes from :func:`with_country` and carries canvas and churn columns.
    """
    out = users.groupBy("country_code").agg(
        F.count("segment").alias("users"),
        pct_segment(BUILDER).alias("pct_agent_builder"),
        share(F.col("ever_used_agent") == 1).alias("pct_ever_agent"),
        share(F.col("had_second_session") == 1).alias("pct_repeat_session"),
        _mean("avg_canvas_complexity").alias("avg_canvas_complexity"),
        _mean("avg_canvas_growth").alias("avg_canvas_growth"),
        _mean("credit_events").alias("avg_credit_events"),
        _mean("signup_hour").alias("avg_signup_hour"),
        _mean("churn_probability").alias("avg_churn_probability"),
        share(F.col("is_churn") == 1).alias("actual_churn_pct"),
        F.count_if(F.col("segment") == BUILDER).alias("__builders"),
    )
    bounds = wilson_interval(F.col("__builders"), F.col("users"))
    out = out.withColumn("__bounds", bounds).withColumns(
        {
            "region_group": region_of("country_code"),
            "agent_builder_ci_low": F.col("__bounds.low") * 100.0,
            "agent_builder_ci_high": F.col("__bounds.high") * 100.0,
        }
    )
    return out.drop("__builders", "__bounds")


def region_metrics(users: DataFrame) -> DataFrame:
    """Long table of four rates per region, users of unknown country left out."""
    rates = {
        "pct_ever_agent": F.col("ever_used_agent") == 1,
        "pct_repeat_session": F.col("had_second_session") == 1,
        "pct_onboarding_complete": F.col("completed_onboarding") == 1,
        "pct_agent_builder": F.col("segment") == BUILDER,
    }
    wide = users.where(F.col("country_code") != "Unknown").groupBy("region_group").agg(
        F.count("segment").alias("users"), *[share(c).alias(n) for n, c in rates.items()]
    )
    return wide.unpivot(["region_group", "users"], list(rates), "metric", "value")


def eligible_countries(metrics: DataFrame, min_users: int = 40) -> DataFrame:
    return metrics.where(F.col("users") >= min_users)


HEAT = ("avg_canvas_complexity", "avg_churn_probability", "avg_credit_events", "pct_repeat_session")


def geo_heat(metrics: DataFrame, min_users: int = 40) -> DataFrame:
    """Four measures of the larger countries scaled to 0..1 over those countries."""
    rows = eligible_countries(metrics, min_users).select("country_code", *HEAT)
    ranges = value_ranges(rows, HEAT)
    return rows.withColumn("__ranges", ranges).select("country_code", *[min_max(F.col("__ranges"), c).alias(c) for c in HEAT])


def geo_segment_mix(users: DataFrame, top: int = 10, min_users: int = 40, segments: Sequence[str] = (BUILDER, CODER, VIEWER, GHOST)) -> DataFrame:
    """Users per segment in the largest countries."""
    counts = users.groupBy("country_code").pivot("segment", list(segments)).agg(F.count(F.lit(1))).fillna(0, subset=list(segments))
    sizes = users.groupBy("country_code").agg(F.count("segment").alias("users")).where(F.col("users") >= min_users)
    leaders = sizes.orderBy(F.desc("users"), "country_code").limit(top)
    return counts.join(F.broadcast(leaders.select("country_code")), "country_code")
