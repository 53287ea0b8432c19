"""Churn labels, risk buckets, intervention and struggle scores, success criteria and batch scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.functions.derive import one_of, bucketize, clip, column_or, elapsed, first_match, flag, share
from usagekit.functions.stats import exact_quantiles, min_max, value_ranges
from usagekit.operators.features import observation_end
from usagekit.operators.segments import BUILDER, pct_segment
from usagekit.vocabulary import DEFAULT, Vocabulary

KEY = "person_id"
RISK_LABELS = ("Low", "Medium", "High", "Critical")
RISK_EDGES = (-0.01, 0.2, 0.5, 0.8, 1.0)
PRIORITY_EDGES = (-0.01, 0.25, 0.5, 0.75, 1.0)


def _unit(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def risk_bucket(probability: Column | str) -> Column:
    value = F.col(probability) if isinstance(probability, str) else probability
    return bucketize(_unit(value), RISK_EDGES, RISK_LABELS)


def priority_bucket(score: Column | str) -> Column:
    value = F.col(score) if isinstance(score, str) else score
    return bucketize(_unit(value), PRIORITY_EDGES, RISK_LABELS)


def churn_label_inactivity(log: DataFrame, horizon_days: float = 14) -> DataFrame:
    """Silent for at least the horizon before the end of the data; a shorter silence is censored."""
    out = log.groupBy(KEY).agg(F.max("ts").alias("last_active_at")).withColumn("observation_end", observation_end(log))
    out = out.withColumn("days_until_end", elapsed("observation_end", "last_active_at", 86400))
    short = F.col("days_until_end") < horizon_days
    return out.withColumns({"is_censored": flag(short), "is_churn": flag(~short)})


def churn_label_survival_proxy(log: DataFrame, horizon_days: float = 14) -> DataFrame:
    """Observed for at least the horizon, but all activity lies within less than it."""
    out = log.groupBy(KEY).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    out = out.withColumn("observation_end", observation_end(log))
    out = out.withColumn("days_observed_after_signup", elapsed("observation_end", "first_seen", 86400))
    censored = F.col("days_observed_after_signup") < horizon_days
    brief = elapsed("last_seen", "first_seen", 86400) < horizon_days
    return out.withColumns({"is_censored": flag(censored), "is_churn": flag(brief & ~censored)}).select(
        KEY, "days_observed_after_signup", "is_censored", "is_churn"
    )


def in_churn_population() -> Column:
    """Whether the churn model covers a user: observed long enough and active at all."""
    active = (F.col("had_second_session") == 1) | (F.col("days_active") >= 2) | (F.col("manual_runs") >= 1)
    return F.coalesce((F.col("is_censored") == 0) & active, F.lit(False))


def churn_population(users: DataFrame) -> DataFrame:
    """Users the churn model is fitted on."""
    return users.where(in_churn_population())


def with_churn(users: DataFrame, probability: Column) -> DataFrame:
    """Churn label and probability of the population; everybody else has 0 and 0, and the flag says so."""
    inside = in_churn_population()
    return users.withColumns({
        "in_churn_population": flag(inside),
        "is_churn": F.when(inside, F.col("is_churn")).otherwise(0),
        "churn_probability": F.when(inside, F.coalesce(probability, F.lit(0.0))).otherwise(0.0),
    })


def risk_summary(scored: DataFrame) -> DataFrame:
    """Users, churn and activity per risk bucket; ``scored`` is the churn population."""
    return scored.groupBy("churn_risk_bucket").agg(
        F.count("is_churn").alias("users"),
        F.avg("churn_probability").alias("avg_probability"),
        share(F.col("is_churn") == 1).alias("actual_churn_pct"),
        F.avg(F.col("days_active").cast("double")).alias("avg_days_active"),
        F.avg("avg_canvas_complexity").alias("avg_canvas_complexity"),
    )


def struggle_counts(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Error-assist flag and credit-warning count per user."""
    event = F.col("event")
    return log.where(one_of(vocab.struggle)).groupBy(KEY).agg(
        F.max(flag(event == vocab.error_assist)).alias("had_error_assist"),
        F.count_if(one_of((*vocab.credit_warnings, vocab.credits_exceeded))).alias("credit_warning_events"),
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


SCALED = (
    "first_session_event_types", "first_session_duration_min", "credit_warning_events", "credit_events",
    "avg_canvas_complexity", "avg_canvas_growth", "avg_revisit_depth",
)


def intervention_scores(users: DataFrame) -> DataFrame:
    """Activation, struggle, momentum and churn signals, priority score and recommended intervention.

    ``users`` carries features, canvas measures, churn_probability, had_error_assist and
    credit_warning_events; read it from a table, as the ranges of seven columns are taken first.
    """
    ranges = value_ranges(users, SCALED)
    rows = users.withColumn("__ranges", ranges)

    def scaled(name: str) -> Column:
        return min_max(F.col("__ranges"), name)

    activation = (
        0.30 * _zero("had_second_session") + 0.20 * scaled("first_session_event_types")
        + 0.20 * scaled("first_session_duration_min") + 0.15 * _zero("first_session_had_agent") + 0.15 * _zero("first_session_had_run")
    )
    struggle = (
        0.35 * _zero("had_error_assist") + 0.30 * scaled("credit_warning_events")
        + 0.20 * _zero("had_credit_exceeded") + 0.15 * scaled("credit_events")
    )
    momentum = (
        0.35 * scaled("avg_canvas_complexity") + 0.20 * _zero("repeat_canvas_users") + 0.20 * scaled("avg_canvas_growth")
        + 0.15 * scaled("avg_revisit_depth") + 0.10 * _zero("share_of_canvases_with_growth")
    )
    out = rows.withColumns(
        {
            "activation_signal": _unit(activation),
            "struggle_signal": _unit(struggle),
            "builder_momentum_signal": _unit(momentum),
            "churn_risk_signal": _unit(_zero("churn_probability")),
        }
    ).drop("__ranges")
    a, s, m, c = (F.col(n) for n in ("activation_signal", "struggle_signal", "builder_momentum_signal", "churn_risk_signal"))
    out = out.withColumn("intervention_priority_score", _unit(0.35 * c + 0.25 * s + 0.20 * a + 0.20 * m))
    advice = first_match(
        {
            "Activation nudge": (a < 0.35) & (_zero("had_second_session") == 0),
            "Productive struggle support": (s >= 0.45) & (m >= 0.25),
            "Builder acceleration": (m >= 0.45) & (c >= 0.45),
            "Retention rescue": c >= 0.60,
        },
        default="Monitor",
    )
    return out.withColumns(
        {
            "recommended_intervention": advice,
            "intervention_priority_bucket": priority_bucket("intervention_priority_score"),
            "intervention_risk_bucket": risk_bucket("intervention_priority_score"),
            "churn_risk_bucket": risk_bucket(c),
        }
    )


def intervention_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("recommended_intervention").agg(
        F.count("segment").alias("users"),
        F.avg("intervention_priority_score").alias("avg_priority"),
        F.avg("churn_risk_signal").alias("avg_churn_risk"),
        F.avg("activation_signal").alias("avg_activation"),
        F.avg("struggle_signal").alias("avg_struggle"),
        F.avg("builder_momentum_signal").alias("avg_builder_momentum"),
        pct_segment(BUILDER).alias("pct_agent_builder"),
    )


def top_interventions(scored: DataFrame, k: int = 25) -> DataFrame:
    columns = (
        KEY, "segment", "recommended_intervention", "intervention_priority_score", "activation_signal", "churn_risk_signal",
        "struggle_signal", "builder_momentum_signal",
    )
    return scored.orderBy(F.desc("intervention_priority_score"), KEY).limit(k).select(*columns)


def struggle_recovery(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Struggle counts and what a user does after the first struggle, for users with one.

    The first struggle per user is one small row; it is copied to the user's later days and joined to the
    log on user and day, so a busy user is spread over the days. Later events are first counted per
    (user, day), so the active days need no distinct count.
    """
    event = F.col("event")
    first = log.where(one_of(vocab.struggle)).groupBy(KEY).agg(
        F.min("ts").alias("first_struggle_at"),
        F.count(F.lit(1)).alias("struggle_events"),
        F.count_if(event == vocab.error_assist).alias("error_assist_events"),
        F.count_if(event != vocab.error_assist).alias("credit_struggle_events"),
    )
    after = F.unix_micros("ts") - F.unix_micros("first_struggle_at")
    rows = log.select(KEY, "event", "ts", F.to_date("ts").alias("day"))
    days = rows.select(KEY, "day").distinct().join(first.select(KEY, "first_struggle_at"), KEY)
    later = rows.join(days.where(F.col("day") >= F.to_date("first_struggle_at")), [KEY, "day"]).where(after > 0)
    recovery = one_of(vocab.recovery)
    soon = after <= F.lit(24 * 3_600_000_000)
    daily = later.groupBy(KEY, "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(recovery).alias("r"), F.count_if(soon).alias("soon"),
        F.min(F.when(recovery, after)).alias("first_recovery"),
    )
    post = daily.groupBy(KEY).agg(
        F.sum("n").alias("any_post_struggle_event"),
        F.sum("r").alias("recovery_events_post_struggle"),
        flag(F.sum("soon") > 0).alias("recovered_within_24h"),
        F.sum("soon").alias("events_within_24h"),
        F.count(F.lit(1)).alias("active_days_after_struggle"),
        (F.min("first_recovery") / F.lit(3_600_000_000.0)).alias("hours_to_first_recovery"),
    )
    counts = ("any_post_struggle_event", "recovery_events_post_struggle", "recovered_within_24h", "events_within_24h", "active_days_after_struggle")
    return first.join(post, KEY, "left").fillna(0, subset=list(counts))


STRUGGLE_COUNTS = (
    "struggle_events", "error_assist_events", "credit_struggle_events", "any_post_struggle_event", "recovery_events_post_struggle",
    "recovered_within_24h", "events_within_24h", "active_days_after_struggle",
)


def with_recovery(scored: DataFrame, recovery: DataFrame) -> DataFrame:
    """Scored users with their struggle counts; 0 and 999 hours for users without a struggle."""
    users = scored.join(recovery, KEY, "left").fillna(0, subset=list(STRUGGLE_COUNTS))
    return users.fillna(999.0, subset=["hours_to_first_recovery"])


def struggle_quality(users: DataFrame) -> DataFrame:
    """Recovery intensity, abandonment risk, quality score and class of the users of :func:`with_recovery`."""
    ranges = value_ranges(users, ("recovery_events_post_struggle", "active_days_after_struggle", "avg_revisit_depth", "events_within_24h"))
    rows = users.withColumn("__ranges", ranges)

    def scaled(name: str) -> Column:
        return min_max(F.col("__ranges"), name)

    recovered = F.col("recovered_within_24h").cast("double")
    days = scaled("active_days_after_struggle")
    out = rows.withColumns(
        {
            "had_struggle_signal": flag(F.col("struggle_events") > 0),
            "recovery_intensity": _unit(
                0.35 * recovered + 0.25 * scaled("recovery_events_post_struggle") + 0.20 * days + 0.20 * scaled("avg_revisit_depth")
            ),
            "abandonment_risk_after_struggle": _unit(
                0.45 * _zero("churn_probability") + 0.25 * (1.0 - recovered) + 0.15 * (1.0 - scaled("events_within_24h")) + 0.15 * (1.0 - days)
            ),
        }
    ).drop("__ranges")
    quality = 0.55 * F.col("recovery_intensity") + 0.25 * F.col("builder_momentum_signal") + 0.20 * F.col("activation_signal")
    out = out.withColumn("quality_of_struggle_score", _unit(quality))
    risk = F.col("abandonment_risk_after_struggle")
    return out.withColumn(
        "struggle_class",
        first_match(
            {
                "No visible struggle": F.col("had_struggle_signal") == 0,
                "Productive struggle": (F.col("quality_of_struggle_score") >= 0.45) & (risk < 0.45),
                "Abandonment-prone struggle": risk >= 0.6,
            },
            default="Mixed/uncertain struggle",
        ),
    )


def struggle_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("struggle_class").agg(
        F.count("segment").alias("users"),
        F.avg("quality_of_struggle_score").alias("avg_quality_score"),
        F.avg("abandonment_risk_after_struggle").alias("avg_abandonment_risk"),
        F.avg("recovery_intensity").alias("avg_recovery_intensity"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.avg("builder_momentum_signal").alias("avg_builder_momentum"),
        pct_segment(BUILDER).alias("pct_agent_builder"),
    )


CRITERIA = ("c1_depth", "c2_retention", "c3_complexity", "c4_ai_adoption", "c5_reproducibility")


def engagement_features(log: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The counts the composite engagement score reads, per user."""
    event = F.col("event")
    session = log.groupBy(KEY, "session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(one_of(vocab.all_runs)).alias("runs"),
        F.count_if(event == "agent_block_created").alias("blocks"),
        F.count_if(event == "agent_accept_suggestion").alias("accepted"),
        F.count_if(F.startswith(event, F.lit("agent_"))).alias("agent"),
        F.max(flag(event == "requirements_build")).alias("requirements"),
    )
    named = F.col("session_id").isNotNull()
    return session.groupBy(KEY).agg(
        F.sum("runs").alias("total_code_runs"),
        F.sum("blocks").alias("agent_blocks_created"),
        F.sum("accepted").alias("agent_suggestions_accepted"),
        F.sum("agent").alias("agent_total_events"),
        F.max("requirements").alias("requirements_built"),
        F.coalesce(F.avg(F.when(named, F.col("n").cast("double"))), F.lit(0.0)).alias("avg_session_depth"),
    )


def ces_label(users: DataFrame) -> DataFrame:
    """Five 0/1 criteria, their sum and the success flag (two or more); absent columns count as 0."""
    runs, blocks = column_or(users, "total_code_runs"), column_or(users, "agent_blocks_created")
    out = users.withColumns(
        {
            "c1_depth": flag((runs >= 1) & (blocks >= 1)),
            "c2_retention": flag(column_or(users, "days_active") >= 3),
            "c3_complexity": flag((column_or(users, "requirements_built") >= 1) | (column_or(users, "previewed_output") >= 1)),
            "c4_ai_adoption": flag(column_or(users, "agent_suggestions_accepted") >= 1),
            "c5_reproducibility": flag(runs >= 3),
        }
    )
    score = F.col(CRITERIA[0])
    for name in CRITERIA[1:]:
        score = score + F.col(name)
    return out.withColumn("ces_score", score).withColumn("is_success", flag(F.col("ces_score") >= 2))


def ces_hit_rates(labelled: DataFrame) -> DataFrame:
    long = labelled.select(*CRITERIA, "is_success").unpivot([], [*CRITERIA, "is_success"], "criterion", "hit")
    return long.groupBy("criterion").agg(F.sum("hit").alias("users"), share(F.col("hit") == 1).alias("pct"))


def ces_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("ces_score").agg(F.count(F.lit(1)).alias("users"), F.max("is_success").alias("is_success"))


def ces_correlation(labelled: DataFrame) -> DataFrame:
    """Correlation of the criteria as (a, b, r), in one aggregation; NULL for a constant criterion."""
    pairs = [(a, b) for i, a in enumerate(CRITERIA) for b in CRITERIA[i:]]

    def r(a: str, b: str) -> Column:
        return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))

    wide = labelled.agg(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))


PROFILE = ("days_active", "total_code_runs", "agent_total_events", "unique_canvases", "agent_suggestions_accepted", "avg_session_depth")


def ces_profile(labelled: DataFrame) -> DataFrame:
    """Means of successful and other users, divided by the 95th percentile of all."""
    columns = [c for c in PROFILE if c in labelled.columns]
    long = labelled.select("is_success", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["is_success"], columns, "feature", "value")
    tops = exact_quantiles(long, "value", {"p95": 0.95}, ["feature"])
    means = long.groupBy("feature").agg(
        F.avg(F.when(F.col("is_success") == 1, F.col("value"))).alias("success_mean"),
        F.avg(F.when(F.col("is_success") == 0, F.col("value"))).alias("other_mean"),
    )
    scale = F.nullif(F.col("p95"), F.lit(0.0))
    return means.join(tops, "feature").where(scale.isNotNull()).select(
        "feature", (F.col("success_mean") / scale).alias("success"), (F.col("other_mean") / scale).alias("other")
    )


ADVICE = {
    "run": "Run your first code block.",
    "agent": "Try creating an agent block.",
    "return": "Come back over multiple days.",
    "complexity": "Add requirements to the canvas or open the fullscreen preview.",
    "suggestion": "Accept an agent suggestion.",
    "repeat": "Run the canvas several times.",
    "none": "On track: explore the advanced features.",
}


def batch_score(users: DataFrame, probability: str = "success_probability") -> DataFrame:
    """Decision, confidence, archetype, criteria and up to three recommendations per scored user."""
    p = F.col(probability)
    labelled = ces_label(users)
    unmet = {c: F.col(c) == 0 for c in CRITERIA}
    advice = F.array_compact(
        F.array(
            F.when(unmet["c1_depth"] & (column_or(users, "total_code_runs") == 0), F.lit(ADVICE["run"])).when(unmet["c1_depth"], F.lit(ADVICE["agent"])),
            F.when(unmet["c2_retention"], F.lit(ADVICE["return"])),
            F.when(unmet["c3_complexity"], F.lit(ADVICE["complexity"])),
            F.when(unmet["c4_ai_adoption"], F.lit(ADVICE["suggestion"])),
            F.when(unmet["c5_reproducibility"], F.lit(ADVICE["repeat"])),
        )
    )
    advice = F.when(F.size(advice) == 0, F.array(F.lit(ADVICE["none"]))).otherwise(F.slice(advice, 1, 3))
    return labelled.withColumns(
        {
            "is_success_predicted": p >= 0.5,
            "confidence": first_match({"High": p >= 0.75, "Medium": p >= 0.5}, default="Low"),
            "archetype": first_match(
                {"Power User": p >= 0.65, "Explorer": p >= 0.35, "Ghost User": F.col("total_events") <= 3}, default="Early Adopter"
            ),
            "recommendations": advice,
        }
    ).select(KEY, probability, "is_success_predicted", "confidence", "archetype", *CRITERIA, "ces_score", "recommendations")


def batch_summary(scored: DataFrame, probability: str = "success_probability") -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if("is_success_predicted").alias("predicted_success"),
        F.avg(probability).alias("avg_probability"),
        F.count_if(F.col("archetype") == "Power User").alias("power_users"),
        F.count_if(F.col("archetype") == "Explorer").alias("explorers"),
        F.count_if(F.col("archetype") == "Ghost User").alias("ghost_users"),
    )
