"""Registered queries: one per operator, each over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagekit.functions import derive as d
from usagekit.functions import stats
from usagekit.operators import canvas, features, geo, matching, models, ordered, reports, scoring, segments, sequences, survival, timing
from usagekit.plans import tables
from usagekit.session import ensure_utc, gone_at_exit, materialize, once, scratch_dir
from usagekit.sources import events as source
from usagekit.sources.testtables import conversation_tokens, ingested_log, orders_log, usage_log

KEY = "person_id"
# Segments whose survival is compared.
SURVIVAL_SEGMENTS = ("Agent Builder", "Manual Coder", "Viewer")
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for display."""
    return df.selectExpr(*[f"round(`{n}`, {places}) AS `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes])


def _on_log(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(ingested_log(spark, sf)))


def _on_users(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(tables.test_users(spark, sf)))


def _on_table(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(tables.test_table(spark, sf)))


def _on_both(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(build(ingested_log(spark, sf), tables.test_users(spark, sf)))

    return run


def _on_orders(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(orders_log(ensure_utc(spark), sf)))


# --------------------------------------------------------------------------- sources


def _csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as raw CSV under its export names, read back and cleaned, counted per event."""
    ensure_utc(spark)
    names = {new: old for old, new in source.RAW_COLUMNS.items()}
    log = ingested_log(spark, sf)
    raw = log.select(*[F.col(c).alias(names.get(c, c)) for c in log.columns]).withColumn(
        "prop_flag", F.when(F.col("event_id") % 2 == 0, F.lit("IGAZ")).otherwise(F.lit("HAMIS"))
    )
    raw = raw.withColumn("timestamp", F.when(F.col("event_id") % 97 == 0, F.lit("not a time")).otherwise(F.col("timestamp").cast("string")))
    path = f"{scratch_dir(spark)}/usagekit/raw-{uuid.uuid4().hex}.csv"
    source.write_table(raw, path)
    back = source.read_events(spark, path)
    return back.groupBy("event").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("prop_flag") == "true").alias("flagged"),
        F.max("ts").alias("last_ts"), F.count("session_id").alias("with_session"),
    )


def _features_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The user matrix written as parquet and CSV, read back from the parquet."""
    base = f"{scratch_dir(ensure_utc(spark))}/usagekit/features-{uuid.uuid4().hex}"
    source.write_twin(features.volume_features(ingested_log(spark, sf)), base)
    csv = spark.read.option("header", True).csv(f"{base}.csv")
    users = source.read_features(spark, f"{base}.parquet")
    same = csv.select(KEY, F.col("total_events").cast("long").alias("csv_events"))
    return rounded(users.join(same, KEY).select(KEY, "total_events", "csv_events", "days_active", "tenure_days"))


def _report_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports written as CSV and read back as one table."""
    log = ingested_log(ensure_utc(spark), sf)
    base = f"{scratch_dir(spark)}/usagekit/reports-{uuid.uuid4().hex}"
    source.write_reports({"events": reports.value_counts(log, "event"), "libs": reports.value_counts(log, "lib")}, base)
    parts = [
        spark.read.option("header", True).csv(f"{base}/{name}.csv").select(F.lit(name).alias("report"), "value", F.col("n").cast("long").alias("n"))
        for name in ("events", "libs")
    ]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------------------- derivations


def _derivations(log: DataFrame) -> DataFrame:
    """Row-level columns counted together, so every derivation is checked on every event."""
    rows = d.with_canonical_event(d.with_tool(d.with_canvas_id(log)))
    return rows.groupBy(
        "tool", "canvas_id", "unified_event", d.event_category().alias("category"), d.is_build().alias("is_build"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _places(log: DataFrame) -> DataFrame:
    return log.groupBy(
        "country_code", d.region_of("country_code").alias("region"), d.country_group("country_code").alias("country_group"),
        d.referrer_class("referrer").alias("referrer_class"), d.hour_band(F.hour("ts")).alias("band"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _labels(log: DataFrame) -> DataFrame:
    calls = d.with_tool(log).where(F.col("tool").isNotNull() & (F.col("tool") != "Coder Agent"))
    return calls.groupBy("tool", d.tool_label().alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d.depth_points(d.tool_label())).cast("long").alias("points")
    )


def _flags(log: DataFrame) -> DataFrame:
    rows = d.canvas_flags(d.with_tool(log))
    flags = ("is_structural", "is_execution", "is_dependency", "is_output", "is_agent_build")
    return rows.groupBy("event").agg(*[F.sum(f).cast("long").alias(f) for f in flags])


def _session_ids(log: DataFrame) -> DataFrame:
    rows = ordered.sessionize(log)
    return rows.groupBy(KEY, d.unified_session_id().alias("unified_session_id")).agg(F.count(F.lit(1)).alias("events"))


def _cohort_labels(users: DataFrame) -> DataFrame:
    return users.groupBy(
        "adoption_cohort", d.return_cohort().alias("return_cohort"), d.weekend_label("signup_is_weekend").alias("weekend"),
        d.hour_band("signup_hour").alias("band"),
    ).agg(F.count(F.lit(1)).alias("users"))


def _phases(log: DataFrame) -> DataFrame:
    rows = ordered.sessionize(log, 360)
    return rows.groupBy(KEY, d.session_phase().alias("phase")).agg(F.count(F.lit(1)).alias("events"))


def _sessions(log: DataFrame) -> DataFrame:
    rows = ordered.session_table(log, 30)
    return rows.select(KEY, "session_num", F.col("start"), F.col("end").alias("finish"), "events")


# --------------------------------------------------------------------------- canvas, survival, timing


def _user_canvas(spark: SparkSession, sf: str) -> DataFrame:
    log = ingested_log(spark, sf)
    users = log.select(KEY).distinct()
    return rounded(canvas.user_canvas_features(canvas.canvas_events(log), users))


def _curve(label) -> Query:
    def build(users: DataFrame) -> DataFrame:
        return survival.kaplan_meier(survival.activity_survival(users).withColumn("cohort", label(users)), group="cohort")

    return _on_users(build)


def _survival_segments(users: DataFrame) -> DataFrame:
    chosen = users.where(F.col("segment").isin(*SURVIVAL_SEGMENTS))
    return survival.kaplan_meier(survival.activity_survival(chosen), min_users=10)


def _order_survival(log: DataFrame) -> DataFrame:
    days = log.groupBy(KEY).agg(F.count_distinct(F.to_date("ts")).alias("days_active"))
    return survival.kaplan_meier(survival.activity_survival(days).withColumn("cohort", F.lit("all")), group="cohort")


def _third_urgent(log: DataFrame) -> DataFrame:
    return timing.time_to_kth(log, 3, F.col("event") == "1-URGENT", cap_days=2000.0).select(KEY, "days_to_kth")


def _kth_by_cohort(log: DataFrame, users: DataFrame) -> DataFrame:
    times = timing.time_to_kth(log).join(users.select(KEY, "signup_cohort"), KEY)
    return timing.time_to_kth_summary(times, ["signup_cohort"])


# --------------------------------------------------------------------------- sequences


def _role_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    tokens = conversation_tokens(spark, sf)
    return sequences.ngram_counts(tokens, 3, ["seq_id"], ["pos"], F.floor(F.col("pos") / 4).cast("long"))


def _lift(log: DataFrame, users: DataFrame) -> DataFrame:
    groups = users.select(KEY, d.flag(F.col("segment") == "Agent Builder").alias("focal"))
    return sequences.ngram_lift(sequences.event_tokens(log), groups, 3, min_count=3, min_baseline=2, top_k=40)


def _motifs(spark: SparkSession, sf: str) -> DataFrame:
    log = ingested_log(spark, sf)
    return rounded(sequences.motif_tables(log, tables.test_table(spark, sf)))


def _paths(log: DataFrame, users: DataFrame) -> DataFrame:
    return sequences.user_paths(log, users, 5)


# --------------------------------------------------------------------------- scores


def _ces(spark: SparkSession, sf: str) -> DataFrame:
    log = ingested_log(spark, sf)
    users = tables.test_users(spark, sf).join(scoring.engagement_features(log), KEY)
    return scoring.ces_label(users)


def _on_ces(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(_ces(spark, sf)))


def _probability(labelled: DataFrame) -> DataFrame:
    """Stand-in success probability of a user: activity days over 30, for the scoring rules."""
    return labelled.withColumn("success_probability", d.clip(F.col("days_active") / 30.0, 0.0, 1.0))


def _geo(build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(build(geo.with_country(tables.test_table(spark, sf), ingested_log(spark, sf))))

    return run


SIGNALS = (
    KEY, "activation_signal", "struggle_signal", "builder_momentum_signal", "churn_risk_signal", "intervention_priority_score",
    "recommended_intervention", "intervention_priority_bucket", "intervention_risk_bucket", "churn_risk_bucket",
)
STRUGGLE = (
    KEY, "had_struggle_signal", "recovery_intensity", "abandonment_risk_after_struggle", "quality_of_struggle_score", "struggle_class",
)


def _risk(table: DataFrame) -> DataFrame:
    return scoring.risk_summary(scoring.churn_population(table).withColumn("churn_risk_bucket", scoring.risk_bucket("churn_probability")))


# --------------------------------------------------------------------------- models

# Fits are beyond SQL: their queries return the values and have no SQL; tests hold them against brute force.


def _weighted(users: DataFrame, agent_users_only: bool = False) -> tuple[DataFrame, list[str]]:
    frame, columns = models.success_frame(users, agent_users_only)
    return models.with_balanced_weights(frame), columns


def _folds(frame: DataFrame, estimators, columns) -> DataFrame:
    """Users, positives, areas and accuracy per model and fold."""
    return models.cross_validate_folds(frame, models.with_joint_fits(estimators, columns))


def _cross_validation(agent_users_only: bool) -> Callable[[DataFrame], DataFrame]:
    def build(users: DataFrame) -> DataFrame:
        frame, columns = _weighted(users, agent_users_only)
        return _folds(frame, models.success_estimators(columns, frame.count()), columns)

    return build


def _strengths(frame: DataFrame, columns, forest) -> DataFrame:
    return models.feature_importance(forest.fit(models.in_order(frame)), frame, columns, len(columns))


def _importance(users: DataFrame) -> DataFrame:
    frame, columns = _weighted(users, True)
    return _strengths(frame, columns, models.random_forest(columns))


def _held_out_report(scored: DataFrame) -> DataFrame:
    """Per model: rows, positives and areas."""
    quality = models.curve_quality(models.score_curve(scored, by=["model"]), ["model"])
    counts = scored.groupBy("model").agg(F.count(F.lit(1)).alias("users"), F.sum("label").cast("long").alias("positives"))
    return counts.join(quality, "model")


def _hold_out_quality(users: DataFrame) -> DataFrame:
    frame, columns = _weighted(users)
    return _held_out_report(models.held_out_scores(frame, {"Random Forest": models.random_forest(columns)}))


def _model_file(spark: SparkSession, sf: str) -> DataFrame:
    """A model saved, loaded and applied: the scores of both agree for every user."""
    frame, columns = _weighted(tables.test_users(spark, sf))
    path = f"{scratch_dir(spark)}/usagekit/model-{uuid.uuid4().hex}"
    fitted = models.random_forest(columns).fit(frame)
    models.save_model(fitted, columns, frame, path)
    model, names = models.load_model(spark, path)
    first = models.score(fitted, frame).select(KEY, F.col("score").alias("before"))
    again = models.score(model, frame.select(KEY, "label", "weight", *names)).select(KEY, "score")
    return again.join(first, KEY).select(KEY, (F.abs(F.col("score") - F.col("before")) < 1e-9).alias("same_score"))


def _churn(spark: SparkSession, sf: str) -> DataFrame:
    table = tables.test_table(spark, sf)
    return models.churn_score(table, scoring.churn_population(table))


def _churn_folds(table: DataFrame) -> DataFrame:
    frame, columns = models.churn_frame(table, scoring.churn_population(table))
    return _folds(frame, models.churn_estimators(columns, frame.count()), columns)


def _churn_curve(table: DataFrame) -> DataFrame:
    frame, columns = models.churn_frame(table, scoring.churn_population(table))
    return _held_out_report(models.held_out_scores(frame, models.churn_estimators(columns, frame.count())))


def _churn_drivers(table: DataFrame) -> DataFrame:
    frame, columns = models.churn_frame(table, scoring.churn_population(table))
    return _strengths(frame, columns, models.random_forest(columns, 350, 4))


def _model_table(spark: SparkSession, sf: str) -> DataFrame:
    """The user table with the churn probability of the fitted model, written once."""
    def build() -> DataFrame:
        table = tables.test_table(spark, sf)
        scored = _churn(spark, sf).select(KEY, F.col("churn_probability").alias("model_probability"))
        joined = table.join(scored, KEY, "left")
        return scoring.with_churn(joined, F.col("model_probability")).drop("model_probability")

    return once(spark, "model-table", sf, build)


def _model_interventions(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.intervention_scores(_model_table(spark, sf)).select("in_churn_population", *SIGNALS)


def _model_struggle(spark: SparkSession, sf: str) -> DataFrame:
    return tables.struggle_of(scoring.intervention_scores(_model_table(spark, sf)), ingested_log(spark, sf)).select(*STRUGGLE)


def _ces_folds(labelled: DataFrame) -> DataFrame:
    frame, columns = models.ces_frame(labelled)
    frame = materialize(frame, "ces")
    return _folds(frame, models.ces_estimators(columns, frame.count()), columns)


def _ces_confusion(labelled: DataFrame) -> DataFrame:
    """The report of the forest on its held-out users."""
    frame, columns = models.ces_frame(labelled)
    scored = models.held_out_scores(materialize(frame, "ces"), {"Random Forest": models.random_forest(columns, 300, 5)})
    return models.confusion_report(scored)


def _ces_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Users scored in a batch by a stored success model."""
    labelled = materialize(_ces(spark, sf), "ces-labelled")  # read three times
    frame, columns = models.ces_frame(labelled)
    frame = materialize(frame, "ces")
    path = f"{scratch_dir(spark)}/usagekit/model-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    models.save_model(models.random_forest(columns, 300, 5).fit(models.in_order(frame)), columns, frame, path)
    scored = models.score_stored(labelled, path).select(KEY, F.round("score", 4).alias("success_probability"))
    return scoring.batch_score(labelled.join(materialize(scored, "ces-scores"), KEY)).select(
        KEY, *scoring.CRITERIA, "ces_score", "success_probability", "is_success_predicted", "confidence", "recommendations"
    )


def _archetypes(labelled: DataFrame) -> DataFrame:
    return models.archetype_summary(models.kmeans_archetypes(labelled), labelled)


def _stand_in(table: DataFrame) -> DataFrame:
    """Churn label against the recency score: an input for curves and reports that SQL can rebuild."""
    return table.select(KEY, F.col("is_churn").alias("label"), F.round("churn_probability", 2).alias("score"), d.flag(F.col("churn_probability") >= 0.5).alias("prediction"))


def _propensity(spark: SparkSession, sf: str) -> DataFrame:
    columns = (KEY, "segment", "days_active", "had_second_session", "ever_used_agent", "propensity_score")
    return once(spark, "propensity", sf, lambda: models.propensity_scores(tables.test_users(spark, sf)).select(*columns))


def _propensity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.propensity_match(_propensity(ensure_utc(spark), sf))


def _propensity_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Effect on the pairs of the fitted scores, with intervals of a paired bootstrap."""
    scored = _propensity(ensure_utc(spark), sf)
    return matching.effect_with_intervals(materialize(matching.propensity_match(scored), "pairs"), scored)


def _recency_effect(table: DataFrame) -> DataFrame:
    """Effect on the pairs of the recency score."""
    scored = table.select(KEY, "segment", "days_active", "had_second_session", "ever_used_agent", F.round("churn_probability", 4).alias("propensity_score"))
    scored = materialize(scored, "recency")
    return matching.att(matching.propensity_match(scored), scored)


def _recency_match(table: DataFrame) -> DataFrame:
    """Agent users matched to other users on the recency score, an input SQL can rebuild."""
    scored = table.select(KEY, "ever_used_agent", F.round("churn_probability", 4).alias("propensity_score"))
    return matching.propensity_match(materialize(scored, "recency"))


def _correlation(users: DataFrame) -> DataFrame:
    frame, columns = models.success_frame(users)
    return models.label_correlation(frame, columns)


def _weights(users: DataFrame) -> DataFrame:
    frame, _ = _weighted(users)
    return frame.groupBy("label").agg(F.count(F.lit(1)).alias("users"), F.max("weight").alias("weight"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        # sources and sinks
        "usage_log_adapter": lambda s, sf: usage_log(s, sf),
        "orders_log_adapter": lambda s, sf: orders_log(s, sf),
        "conversation_tokens": lambda s, sf: conversation_tokens(s, sf),
        "csv_event_source": _csv_round_trip,
        "feature_table_sinks": _features_round_trip,
        "report_sinks": _report_sinks,
        "profile_columns": _on_log(lambda log: source.profile_columns(log, limit=None)),
        # row-level derivations
        "event_derivations": _on_log(_derivations),
        "place_derivations": _on_log(_places),
        "tool_labels": _on_log(_labels),
        "canvas_action_flags": _on_log(_flags),
        "unified_session_ids": _on_log(_session_ids),
        "user_cohort_labels": _on_users(_cohort_labels),
        "session_phases": _on_log(_phases),
        # sessions and features
        "sessionize": _on_log(lambda log: ordered.sessionize(log).select(KEY, "event_id", "session_num")),
        "sessionize_six_hours": _on_log(lambda log: ordered.sessionize(log, 360).select(KEY, "event_id", "session_num")),
        "session_table": _on_log(_sessions),
        "volume_features": _on_log(features.volume_features),
        "canvas_features": _on_log(features.canvas_features),
        "manual_features": _on_log(features.manual_features),
        "agent_start_features": _on_log(features.agent_start_features),
        "agent_tool_features": _on_log(features.agent_tool_features),
        "tool_call_counts": _on_log(features.tool_call_counts),
        "tool_call_columns": _on_log(lambda log: features.tool_call_columns(log, ("create_block_tool", "run_block_tool"))),
        "tool_transition_features": _on_log(features.tool_transition_features),
        "output_features": _on_log(features.output_features),
        "onboarding_features": _on_log(features.onboarding_features),
        "time_to_first_features": _on_log(features.time_to_first_features),
        "credit_recency_features": _on_log(features.credit_recency_features),
        "first_session_features": _on_log(features.first_session_features),
        "return_features": _on_log(features.return_features),
        "session_structure_features": _on_log(features.session_structure_features),
        "signup_time_features": _on_log(features.signup_time_features),
        "referrer_features": _on_log(features.referrer_features),
        "feature_matrix": lambda spark, sf: rounded(tables.segmented_test_users(spark, sf)),
        # segments
        "segment_summary": _on_users(segments.segment_summary),
        "segment_profile": _on_users(segments.segment_profile),
        "kpi_matrix": _on_users(segments.kpi_matrix),
        "kpi_heat": _on_users(segments.kpi_heat),
        "kpi_by_cohort": _on_users(segments.kpi_by_cohort),
        "success_by_segment": _on_users(segments.success_by_segment),
        # canvas
        "canvas_complexity": _on_log(lambda log: canvas.canvas_complexity(canvas.canvas_events(log))),
        "first_vs_later_days": _on_log(lambda log: canvas.first_vs_later_days(canvas.canvas_events(log))),
        "user_canvas_features": _user_canvas,
        "canvas_growth_by_segment": _on_table(canvas.growth_by_segment),
        "repeat_canvas_retention": _on_table(canvas.repeat_canvas_retention),
        # survival
        "survival_by_segment": _on_users(_survival_segments),
        "survival_by_return": _curve(lambda users: d.return_cohort()),
        "survival_by_adoption": _curve(lambda users: F.col("adoption_cohort")),
        "survival_of_order_days": _on_orders(_order_survival),
        # timing
        "time_to_third_build": _on_log(lambda log: timing.time_to_kth(log).select(KEY, "days_to_kth")),
        "time_to_third_build_summary": _on_log(lambda log: timing.time_to_kth_summary(timing.time_to_kth(log))),
        "time_to_third_build_by_cohort": _on_both(_kth_by_cohort),
        "time_to_third_urgent_order": _on_orders(_third_urgent),
        "milestone_flags": _on_log(timing.milestone_flags),
        "milestone_lift": _on_both(timing.milestone_lift),
        "onboarding_contrast": _on_ces(
            lambda u: timing.contrast_lift(u, ["completed_onboarding", "skipped_onboarding_form", "submitted_onboarding"], F.col("is_success") == 1)
        ),
        # sequences
        "role_trigrams": _role_trigrams,
        "tool_bigrams_by_segment": _on_both(
            lambda log, u: sequences.top_ngrams_by_segment(sequences.tool_calls(log), u, 2, 8, ("Agent Builder", "Agent Runner", "Manual Coder", "Viewer"))
        ),
        "builder_tool_trigrams": _on_both(
            lambda log, u: sequences.top_ngrams_by_segment(sequences.tool_calls(log), u, 3, 10, ("Agent Builder",))
        ),
        "ngram_lift": _on_both(_lift),
        "motif_tables": _motifs,
        "segment_motifs": _on_both(sequences.segment_motifs),
        "transition_matrix": _on_both(lambda log, u: sequences.transition_matrix(sequences.tool_calls(log), u)),
        "tool_mix": _on_both(lambda log, u: sequences.tool_mix(sequences.tool_calls(log), u, ("Agent Builder", "Agent Runner", "Ghost"))),
        "mean_tool_calls": _on_users(sequences.mean_tool_calls),
        "phase_tool_mix": _on_both(lambda log, u: sequences.phase_tool_mix(sequences.tool_calls(log), u)),
        "tool_sessions": _on_log(lambda log: sequences.tool_sessions(sequences.tool_calls(log), 360)),
        "session_progression": _on_both(lambda log, u: sequences.session_progression(sequences.tool_sessions(sequences.tool_calls(log)), u)),
        "depth_by_session": _on_both(lambda log, u: sequences.depth_by_session(sequences.tool_sessions(sequences.tool_calls(log)), u)),
        "user_paths": _on_both(_paths),
        "path_step_mix": _on_both(lambda log, u: sequences.path_step_mix(_paths(log, u))),
        "path_top_step": _on_both(
            lambda log, u: sequences.path_step_mix(sequences.user_paths(log, u, 8), 8, ("Agent Builder", "Ghost", "Manual Coder"), top=1)
        ),
        "path_divergence": _on_both(
            lambda log, u: sequences.path_step_mix(sequences.user_paths(log, u, 3), 3, ("Agent Builder", "Ghost"), short_paths="NONE")
        ),
        "branch_table": _on_both(lambda log, u: sequences.branch_table(_paths(log, u), min_users=5)),
        "branch_comparison": _on_both(lambda log, u: sequences.branch_comparison(_paths(log, u), min_users=3)),
        "top_branches": _on_both(lambda log, u: sequences.branch_comparison(_paths(log, u), min_users=3, top=20)),
        "top_paths": _on_both(lambda log, u: sequences.top_paths(_paths(log, u))),
        # reports
        "funnel": _on_users(reports.funnel),
        "activation_funnel": _on_users(lambda u: reports.funnel(u, reports.activation_steps())),
        "funnel_by_cohort": _on_users(reports.funnel_by_cohort),
        "event_funnel": _on_log(reports.event_funnel),
        "cohort_summary": _on_users(reports.cohort_summary),
        "segment_by_cohort": _on_users(lambda u: reports.crosstab_pct(u, "signup_cohort", "segment", segments.SEGMENT_ORDER)),
        "adoption_by_cohort": _on_users(lambda u: reports.crosstab_pct(u, "signup_cohort", "adoption_cohort", reports.ADOPTION)),
        "adoption_summary": _on_users(reports.adoption_summary),
        "adoption_profile": _on_users(reports.adoption_profile),
        "adoption_by_segment": _on_users(reports.adoption_by_segment),
        "adoption_timing": _on_users(reports.adoption_timing),
        "first_run_distribution": _on_users(
            lambda u: reports.distribution_stats(u, "ttf_manual_run_min", cap=1440, min_n=6, skip_zero=True)
        ),
        "active_day_distribution": _on_users(lambda u: reports.distribution_stats(u, "days_active", cap=30, min_n=3)),
        "canvas_complexity_distribution": _on_table(lambda u: reports.distribution_stats(u, "avg_canvas_complexity")),
        "signup_hour_stats": _on_users(reports.signup_hour_stats),
        "hour_band_stats": _on_users(reports.hour_band_stats),
        "weekend_stats": _on_users(reports.weekend_stats),
        "return_cohort_stats": _on_users(reports.return_cohort_stats),
        "return_threshold_sweep": _on_users(reports.return_threshold_sweep),
        "build_threshold_sweep": _on_users(reports.threshold_sweep),
        "definition_compare": _on_users(reports.definition_compare),
        "segment_separability": _on_users(reports.segment_separability),
        "credit_pressure_ratio": _on_users(reports.credit_pressure_ratio),
        "country_hour_matrix": _on_log(geo.country_hour_matrix),
        "night_day_countries": _on_log(geo.night_day_countries),
        "country_stats": _on_both(lambda log, u: geo.country_stats(u, log)),
        "geo_metrics": _geo(geo.geo_metrics),
        "region_metrics": _geo(geo.region_metrics),
        "geo_heat": _geo(lambda u: geo.geo_heat(materialize(geo.geo_metrics(u), "geo"), min_users=4)),
        "geo_segment_mix": _geo(lambda u: geo.geo_segment_mix(u, min_users=4)),
        "user_country_mode": _on_log(geo.user_country),
        "credit_burn": _on_both(lambda log, u: reports.credit_burn(u, log)),
        "burn_by_segment": _on_both(lambda log, u: reports.burn_by_segment(reports.credit_burn(u, log))),
        "burn_by_bucket": _on_both(lambda log, u: reports.burn_by_bucket(reports.credit_burn(u, log))),
        "burn_distribution": _on_both(
            lambda log, u: reports.distribution_stats(reports.credit_burn(u, log), "burn_rate", cap=200, min_n=3, skip_zero=True)
        ),
        "error_assist_contrast": _on_both(lambda log, u: reports.error_assist_contrast(u, log)),
        "error_timing": _on_log(reports.error_timing),
        "log_overview": _on_log(reports.log_overview),
        "event_counts": _on_log(lambda log: reports.value_counts(log, "event", 40)),
        "lib_split": _on_log(lambda log: reports.value_counts(log, "lib")),
        "device_split": _on_log(lambda log: reports.value_counts(log, "device_type")),
        "hourly_volume": _on_log(reports.hourly_volume),
        "country_volume": _on_log(reports.country_volume),
        "session_depth": _on_log(reports.session_depth),
        # labels and scores
        "churn_label_inactivity": _on_log(lambda log: scoring.churn_label_inactivity(log, 14)),
        "churn_label_order_silence": _on_orders(lambda log: scoring.churn_label_inactivity(log, 365)),
        "churn_label_survival_proxy": _on_log(scoring.churn_label_survival_proxy),
        "churn_population": _on_table(
            lambda u: scoring.churn_population(u).groupBy("segment").agg(F.count(F.lit(1)).alias("users"), d.share(F.col("is_churn") == 1).alias("churn_pct"))
        ),
        "risk_summary": _on_table(_risk),
        "intervention_scores": lambda s, sf: rounded(tables.intervention(ensure_utc(s), sf).select(*SIGNALS)),
        "intervention_summary": lambda s, sf: rounded(scoring.intervention_summary(tables.intervention(ensure_utc(s), sf))),
        "top_interventions": lambda s, sf: rounded(scoring.top_interventions(tables.intervention(ensure_utc(s), sf))),
        "struggle_recovery": _on_log(scoring.struggle_recovery),
        "struggle_quality": lambda s, sf: rounded(tables.struggle(ensure_utc(s), sf).select(*STRUGGLE)),
        "struggle_summary": lambda s, sf: rounded(scoring.struggle_summary(tables.struggle(ensure_utc(s), sf))),
        "ces_label": _on_ces(lambda u: u.select(KEY, *scoring.CRITERIA, "ces_score", "is_success")),
        "ces_hit_rates": _on_ces(scoring.ces_hit_rates),
        "ces_distribution": _on_ces(scoring.ces_distribution),
        "ces_correlation": _on_ces(scoring.ces_correlation),
        "ces_profile": _on_ces(scoring.ces_profile),
        "time_to_value_curve": _on_ces(reports.time_to_value_curve),
        "volume_flywheel": _on_ces(reports.volume_flywheel),
        "batch_score": _on_ces(lambda u: scoring.batch_score(_probability(u))),
        "batch_summary": _on_ces(lambda u: scoring.batch_summary(scoring.batch_score(_probability(u)))),
        "headline_rates": _on_table(reports.headline_rates),
        "dashboard_segments": _on_users(reports.dashboard_segments),
        "dashboard_cohorts": _on_users(reports.dashboard_cohorts),
        # models
        "balanced_weights": _on_users(_weights),
        "label_correlation": _on_users(_correlation),
        "score_curve": _on_table(lambda u: models.score_curve(_stand_in(u))),
        "score_quality": _on_table(lambda u: models.curve_quality(models.score_curve(_stand_in(u)))),
        "confusion_matrix": _on_table(lambda u: models.confusion_matrix(_stand_in(u))),
        "confusion_report": _on_table(lambda u: models.confusion_report(_stand_in(u))),
        "cross_validate_all_users": _on_users(_cross_validation(False)),
        "cross_validate_agent_users": _on_users(_cross_validation(True)),
        "feature_importance": _on_users(_importance),
        "hold_out_quality": _on_users(_hold_out_quality),
        "model_persistence": _model_file,
        "churn_score": _churn,
        "churn_cross_validation": _on_table(_churn_folds),
        "churn_hold_out": _on_table(_churn_curve),
        "churn_drivers": _on_table(_churn_drivers),
        "model_driven_interventions": _model_interventions,
        "model_driven_struggle": _model_struggle,
        "ces_cross_validation": _on_ces(_ces_folds),
        "ces_confusion": _on_ces(_ces_confusion),
        "ces_batch_score": _ces_scores,
        "fleet_models": _on_users(models.fleet_models),
        "fleet_drift": _on_users(models.fleet_drift),
        "feature_ablation": _on_users(models.ablation),
        "kmeans_archetypes": _on_ces(_archetypes),
        "kmeans_elbow": _on_ces(models.kmeans_elbow),
        "propensity_scores": _on_users(lambda u: models.propensity_scores(u).select(KEY, "ever_used_agent", "propensity_score")),
        "caliper_match": _on_table(_recency_match),
        "propensity_match": _propensity_pairs,
        "matched_effect": _propensity_effect,
        "recency_matched_effect": _on_table(_recency_effect),
    }
    return out
