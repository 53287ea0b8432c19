"""MLlib models for success and churn: features, weights, cross-validation, curves, importances.

Single fits and trees are distributed MLlib jobs; independent ones (folds, cohorts) are submitted from a small thread pool
on the driver, which only waits for them. Logistic models of all folds and feature sets, and all starts of k-means, are
fitted together (``fits``). Fits read their rows in an order that depends on the keys alone, so values repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagekit.functions.derive import flag
from usagekit.operators import fits
from usagekit.operators import trees as tree_models
from usagekit.operators.scoring import risk_bucket
from usagekit.operators.segments import BUILDER
from usagekit.session import materialize

KEY = "person_id"
SEED = 42
FIT_PARTS = 16  # more for larger tables; results repeat for one number of parts

# ---------------------------------------------------------------------------------------------
# Model columns by purpose.
# ---------------------------------------------------------------------------------------------
EARLY_SIGNALS = (
    "ttf_manual_run_min", "ttf_agent_tool_min", "ttf_agent_chat_min", "adopted_agent_early", "ever_used_agent", "ever_ran_manually",
    "signed_up", "skipped_onboarding_form", "submitted_onboarding", "completed_onboarding",
    "first_session_events", "first_session_event_types", "first_session_duration_min", "first_session_had_agent", "first_session_had_run",
    "had_second_session", "time_to_return_hours", "signup_hour", "signup_is_weekend",
)
CHURN_SIGNALS = (
    "manual_runs", "manual_run_days", "agent_conversations", "agent_messages", "agent_tool_calls_total", "agent_build_calls",
    "agent_run_calls", "agent_inspect_calls", "agent_finish_calls", "previewed_output", "signed_up", "completed_onboarding",
    "skipped_onboarding_form", "submitted_onboarding", "ttf_manual_run_min", "ttf_agent_tool_min", "ttf_agent_chat_min",
    "adopted_agent_early", "ever_used_agent", "ever_ran_manually", "first_session_events", "first_session_event_types",
    "first_session_duration_min", "first_session_had_agent", "first_session_had_run", "had_second_session", "time_to_return_hours",
    "signup_hour", "signup_is_weekend", "avg_canvas_complexity", "max_canvas_complexity", "repeat_canvas_users", "repeat_canvas_count",
    "avg_canvas_growth", "share_of_canvases_with_growth", "avg_canvas_active_days", "credit_events", "had_credit_exceeded", "had_addon_credits",
)
CONFOUNDERS = (
    "signed_up", "skipped_onboarding_form", "submitted_onboarding", "completed_onboarding", "signup_hour", "signup_is_weekend",
    "first_session_events", "first_session_duration_min",
)
ABLATION_FAMILIES = {
    "iteration_quality": (
        "create_run_transitions", "run_refactor_transitions", "finish_summary_transitions", "agent_tool_transitions_total",
        "create_run_alternation_rate", "refactor_after_run_rate", "finish_summary_rate",
    ),
    "session_structure": ("productive_sessions", "total_sessions_derived", "max_events_per_session", "productive_session_share"),
    "canvas_commitment": ("primary_canvas_event_share", "repeat_canvas_count_raw", "one_day_canvas_share"),
}
SUCCESS_LEAKAGE = (
    "is_success", "ces_score", "c1_depth", "c2_retention", "c3_complexity", "c4_ai_adoption", "c5_reproducibility",
    "first_seen", "last_seen", "signup_at", "first_run_at",
)
ARCHETYPE_FEATURES = (
    "days_active", "total_code_runs", "agent_total_events", "unique_canvases", "avg_session_depth", "requirements_built",
    "previewed_output", "agent_suggestions_accepted",
)
ARCHETYPES = ("Power Users", "Explorers", "Ghost Users")
# ---------------------------------------------------------------------------------------------


def model_columns(users: DataFrame, names: Sequence[str], drop: Sequence[str] = (), referrers: bool = True) -> list[str]:
    """The named columns the table has, plus the one-hot referrers, in order."""
    refs = [c for c in users.columns if c.startswith("ref_")] if referrers else []
    return [c for c in dict.fromkeys([*names, *refs]) if c in users.columns and c not in drop]


def numeric_columns(users: DataFrame, drop: Sequence[str] = SUCCESS_LEAKAGE) -> list[str]:
    """All numeric columns but the ones that leak the target."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in users.dtypes if t in numeric and n not in drop]


def model_frame(users: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """Key, double features with NULL as 0, and the 0/1 label: the narrow table every fit reads."""
    zero = F.lit(0.0)
    return users.select(KEY, flag(label).cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in columns])


def with_balanced_weights(frame: DataFrame, weight: str = "weight") -> DataFrame:
    """Row weight n / (2 n_class); the class counts are a one-row subquery."""
    counts = frame.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).alias("c")).scalar()
    rows = frame.withColumn("__c", counts)
    n, pos = F.col("__c.n").cast("double"), F.col("__c.pos")
    size = F.when(F.col("label") == 1, pos).otherwise(n - pos)
    return rows.withColumn(weight, n / F.nullif(2.0 * size, F.lit(0.0))).drop("__c")


def _features(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def random_forest(columns: Sequence[str], trees: int = 300, min_leaf: int = 3, max_depth: int = 30, weighted: bool = True, seed: int = SEED) -> tree_models.Forest:
    return tree_models.Forest(columns, trees, min_leaf, max_depth, weighted, seed)


def gradient_boosting(columns: Sequence[str], rounds: int = 200, rate: float = 0.05, depth: int = 4, subsample: float = 1.0, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[_features(columns), GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed)])


def logistic(columns: Sequence[str], rows: int, c: float = 1.0, max_iter: int = 1000, weighted: bool = True) -> Pipeline:
    """Scaled logistic regression; an inverse strength C over n rows is a ridge penalty of 1/(C n)."""
    model = LogisticRegression(regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, maxIter=max_iter, standardization=False)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[_features(columns, "raw"), scaler, model.setWeightCol("weight") if weighted else model])


def with_folds(frame: DataFrame, k: int, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Adds fold (0 to k - 1), stratified: rows of a class (of each group ``by``) are numbered by MD5 of their key, the number modulo k is the fold.

    Folds of a class differ by one row at most. Numbers are given inside 256 cells of the digest and continued
    from one row per cell, so no window holds a class. ``frame`` is read twice.
    """
    rows = frame.withColumn("__md5", F.md5(F.col(KEY).cast("string"))).withColumn("__cell", F.substring("__md5", 1, 2))
    before = Window.partitionBy(*by, label).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*by, label, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.select(*by, label, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*by, label, "__cell").orderBy("__md5", KEY)) - 1 + F.col("__before")
    return rows.join(cells, [*by, label, "__cell"]).withColumn("fold", F.pmod(place, F.lit(k)).cast("int")).drop("__md5", "__cell", "__before")


def in_order(frame: DataFrame, parts: int = FIT_PARTS) -> DataFrame:
    """The rows dealt out and sorted by key: samples of trees are drawn by part and place, so they are the same in every run."""
    return frame.repartition(parts, KEY).sortWithinPartitions(KEY)


def score(model: PipelineModel | tree_models.ForestModel, frame: DataFrame) -> DataFrame:
    if isinstance(model, tree_models.ForestModel):
        return model.score(frame)
    out = model.transform(frame)
    return out.withColumn("score", vector_to_array("probability")[1])


def _parallel(spark: SparkSession, tasks: Iterable[Callable[[], object]], threads: int = 4) -> list:
    """Fits side by side; the session is handed in, as a worker thread of an outer call has no active one."""
    tasks = list(tasks)
    with ThreadPool(min(threads, max(len(tasks), 1))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks)


def hold_out(frame: DataFrame, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, stratified: one of ``parts`` folds is held out."""
    rows = materialize(with_folds(frame, parts), "hold-out")
    return rows.where("fold <> 0").drop("fold"), rows.where("fold = 0").drop("fold")


CURVE_CELLS = 64


def score_curve(scored: DataFrame, score_col: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points at every distinct score, from high to low.

    Rows are counted per distinct score first. The distinct scores are cut by rank into cells of about equal size, written
    once; the running totals are a window inside each cell plus the totals of the cells above, so no task sees all
    scores, wherever they lie.
    """
    keys = list(by) or ["__all"]
    rows = scored.select(*[F.col(c) for c in by], F.col(score_col).cast("double").alias("threshold"), F.col(label).cast("long").alias("y"))
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    points = rows.groupBy(*keys, "threshold").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    points = materialize(points.repartitionByRange(CURVE_CELLS, *keys, "threshold").withColumn("cell", F.spark_partition_id()), "curve")
    cells = points.groupBy(*keys, "cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    above = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    cells = cells.select(
        *keys, "cell", F.coalesce(F.sum("cp").over(above), zero).alias("tp0"), F.coalesce(F.sum("cn").over(above), zero).alias("fp0"),
        F.sum("cp").over(whole).alias("positives"), F.sum("cn").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*keys, "cell").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = points.withColumns({"tp1": F.sum("pos").over(inside), "fp1": F.sum("neg").over(inside)}).join(cells, [*keys, "cell"])
    tp, fp = F.col("tp0") + F.col("tp1"), F.col("fp0") + F.col("fp1")
    out = run.select(
        *keys, "threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "positives", "negatives",
        (tp / F.nullif(F.col("positives"), zero)).alias("tpr"), (fp / F.nullif(F.col("negatives"), zero)).alias("fpr"),
        (tp / F.nullif(tp + fp, zero)).alias("precision"),
    )
    return out if by else out.drop("__all")


def curve_quality(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC area (ties count half) and average precision (step-wise sum)."""
    below = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return curve.groupBy(*by).agg(
        (F.sum(below) / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))).alias("auc"),
        F.sum(F.col("pos") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision")).alias("average_precision"),
    )


def _in_blocks(data: DataFrame, folds: Sequence[str] = ()) -> bool:
    """Whether the rows outside each fold, or all rows, are few enough that one task can grow a tree on them."""
    sizes = [r["count"] for r in data.groupBy(*folds).count().collect()]
    return not sizes or sum(sizes) - (min(sizes) if folds else 0) <= tree_models.BLOCK


def cross_validate_folds(frame: DataFrame, estimators: dict[str, Estimator | fits.Logistic | tree_models.Boosting], k: int = 5) -> DataFrame:
    """Users, positives, AUC, average precision and accuracy per model and fold.

    ``frame`` carries key, label, weight and features. A class with fewer than k rows leaves folds without it,
    and those have no AUC. Logistic models of all names and folds are fitted together, boosted trees those of all folds,
    and forests of all names and folds unless a fit has more than ``trees.BLOCK`` rows.
    """
    data = materialize(with_folds(frame, k), "folds")
    forests = {n: e for n, e in estimators.items() if isinstance(e, tree_models.Forest)}
    if forests and not _in_blocks(data, ["fold"]):
        forests = {}

    def one(name: str, estimator: Estimator, fold: int) -> DataFrame:
        model = estimator.fit(in_order(data.where(F.col("fold") != fold)))
        held = score(model, data.where(F.col("fold") == fold))
        return held.select(F.lit(name).alias("model"), "fold", "label", "score", "prediction")

    joint = {n: e for n, e in estimators.items() if isinstance(e, fits.Logistic)}
    boosted = {n: e for n, e in estimators.items() if isinstance(e, tree_models.Boosting)}
    parts = [fits.logistic_folds(in_order(data), joint, k).select("model", "fold", "label", "score", "prediction")] if joint else []
    tasks = [lambda n=n, e=e: tree_models.boosted_folds(in_order(data), {n: e}, k) for n, e in boosted.items()]
    alone = [n for n in estimators if n not in joint and n not in boosted and n not in forests]
    tasks += [lambda n=n, f=f: one(n, estimators[n], f) for n in alone for f in range(k)]
    if forests:
        grown = tree_models.joint_forests(in_order(data.withColumn("place", F.lit(0))), forests, range(k), k)
        parts.append(tree_models.joint_scores(grown).drop("place"))
    parts += _parallel(frame.sparkSession, tasks)
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    scored = materialize(scored, "cv")
    quality = curve_quality(score_curve(scored, by=["model", "fold"]), ["model", "fold"])
    counts = scored.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("users"), F.sum("label").cast("long").alias("positives"),
        F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    return quality.join(counts, ["model", "fold"])


def cross_validate(frame: DataFrame, estimators: dict[str, Estimator | fits.Logistic], k: int = 5) -> DataFrame:
    """Mean and population deviation of AUC, average precision and accuracy over k stratified folds, per model."""
    return cross_validate_folds(frame, estimators, k).groupBy("model").agg(
        F.count("auc").alias("folds"),
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
        F.avg("average_precision").alias("ap_mean"), F.stddev_pop("average_precision").alias("ap_std"),
        F.avg("accuracy").alias("accuracy_mean"),
    )


def feature_importance(model: tree_models.ForestModel, frame: DataFrame, columns: Sequence[str], k: int = 15) -> DataFrame:
    """Largest importances of a forest; one row per feature, however many users."""
    values = [float(v) for v in model.importances()]
    rows = frame.sparkSession.createDataFrame(list(zip(columns, values, strict=True)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(k)


def with_joint_fits(estimators: dict[str, Pipeline], columns: Sequence[str]) -> dict[str, Estimator | fits.Logistic | tree_models.Boosting]:
    """The same models for cross-validation: logistic models and boosted trees are fitted for all folds at once."""
    def joint(name: str, estimator: Pipeline) -> Estimator | fits.Logistic | tree_models.Boosting:
        if name == "Logistic Regression":
            return fits.Logistic(columns)
        if name == "Gradient Boosting":
            plain = estimator.getStages()[-1]
            return tree_models.Boosting(columns, plain.getMaxIter(), plain.getStepSize(), plain.getMaxDepth(), plain.getSubsamplingRate(), plain.getSeed())
        return estimator

    return {name: joint(name, e) for name, e in estimators.items()}


def success_estimators(columns: Sequence[str], rows: int, trees: int = 300, rounds: int = 200, min_leaf: int = 3) -> dict[str, Pipeline]:
    return {
        "Random Forest": random_forest(columns, trees, min_leaf),
        "Gradient Boosting": gradient_boosting(columns, rounds),
        "Logistic Regression": logistic(columns, rows),
    }


def success_frame(users: DataFrame, agent_users_only: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows and columns of the success model: all users, or agent users without the constant flag."""
    rows = users.where(F.col("ever_used_agent") == 1) if agent_users_only else users
    columns = model_columns(users, EARLY_SIGNALS, drop=("ever_used_agent",) if agent_users_only else ())
    return model_frame(rows, columns, F.col("segment") == BUILDER), columns


def label_correlation(frame: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """Pearson correlation of each feature with the label, from one aggregation; NULL for constants."""
    def r(name: str) -> Column:
        return F.covar_pop(name, "label") / F.nullif(F.stddev_pop(name) * F.stddev_pop("label"), F.lit(0.0))

    wide = frame.agg(*[F.struct(F.lit(c).alias("feature"), r(c).alias("r")).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))
    return rows if k is None else rows.orderBy(F.desc_nulls_last(F.abs("r")), "feature").limit(k)


def churn_frame(table: DataFrame, population: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows and columns of the churn model: the population, labelled by ``is_churn``, with balanced weights."""
    columns = model_columns(table, CHURN_SIGNALS)
    return with_balanced_weights(model_frame(population, columns, F.col("is_churn") == 1)), columns


def churn_estimators(columns: Sequence[str], rows: int, trees: int = 350, min_leaf: int = 4) -> dict[str, Pipeline]:
    return {"Random Forest": random_forest(columns, trees, min_leaf), "Logistic Regression": logistic(columns, rows)}


def ces_frame(labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows and columns of the success-criteria model: all numeric columns but those that leak the target."""
    columns = numeric_columns(labelled)
    return with_balanced_weights(model_frame(labelled, columns, F.col("is_success") == 1)), columns


def ces_estimators(columns: Sequence[str], rows: int, trees: int = 300, rounds: int = 200) -> dict[str, Pipeline]:
    return {
        "Random Forest": random_forest(columns, trees, 5),
        "Gradient Boosting": gradient_boosting(columns, rounds, subsample=0.8),
        "Logistic Regression": logistic(columns, rows),
    }


def held_out_scores(frame: DataFrame, estimators: dict[str, Pipeline], parts: int = 5) -> DataFrame:
    """KEY, label, model, score, prediction of the held-out rows, each model fitted on the others."""
    train, test = hold_out(frame, parts)

    def one(name: str, estimator: Pipeline) -> DataFrame:
        return score(estimator.fit(in_order(train)), test).select(KEY, "label", F.lit(name).alias("model"), "score", "prediction")

    done = _parallel(frame.sparkSession, [lambda n=n, e=e: one(n, e) for n, e in estimators.items()])
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out, "held-out")


FLEET_SCHEMA = T.StructType([
    T.StructField("signup_cohort", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_builders", T.LongType()),
    T.StructField("pct_ab", T.DoubleType()),
    T.StructField("auc_rf", T.DoubleType()), T.StructField("auc_lr", T.DoubleType()),
    T.StructField("top_features", T.ArrayType(T.StringType())), T.StructField("top_importances", T.ArrayType(T.DoubleType())),
])


def _by_cohort(frame: DataFrame, by: str, cohorts: Sequence) -> DataFrame:
    """The rows of the cohorts (name, rows, positives) with their place in the list and weights balanced inside each."""
    named = frame.sparkSession.createDataFrame([(i, c, float(n), float(pos)) for i, (c, n, pos) in enumerate(cohorts)], "place int, __by string, __n double, __pos double")
    rows = frame.join(F.broadcast(named), F.col(by).eqNullSafe(F.col("__by")))
    size = F.when(F.col("label") == 1, F.col("__pos")).otherwise(F.col("__n") - F.col("__pos"))
    return rows.withColumn("weight", F.col("__n") / F.nullif(2.0 * size, F.lit(0.0))).drop(by, "__by", "__n", "__pos")


def fleet_models(users: DataFrame, by: str = "signup_cohort", min_pos: int = 10, k: int = 5, trees: int = 200, min_leaf: int = 2) -> DataFrame:
    """One success model per cohort: cross-validated AUCs and the three strongest features.

    Cohorts are months; only their sizes reach the driver. A cohort with few builders gets no model. The models of all
    cohorts and folds are fitted together, those of cohorts with more than ``trees.BLOCK`` users one by one.
    """
    frame, columns = success_frame(users)
    frame = materialize(frame.join(users.select(KEY, by), KEY), "fleet")
    sizes = frame.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos")).orderBy(by).collect()
    forest = random_forest(columns, trees, min_leaf)
    fitted = [(r[by], r["n"], r["pos"]) for r in sizes if min_pos <= r["pos"] < r["n"]]

    def alone(cohort: str | None) -> tuple:
        rows = with_balanced_weights(frame.where(F.col(by).eqNullSafe(F.lit(cohort))).drop(by))
        quality = cross_validate(rows, {"rf": forest, "lr": fits.Logistic(columns)}, k)
        return {r["model"]: r["auc_mean"] for r in quality.collect()}, forest.fit(in_order(rows)).importances()

    found = _together(frame, by, [c for c in fitted if c[1] <= tree_models.BLOCK], forest, columns, k)
    found |= {c[0]: alone(c[0]) for c in fitted if c[1] > tree_models.BLOCK}
    rows = []
    for r in sizes:
        auc, values = found.get(r[by], ({}, []))
        top = sorted(zip(columns, values), key=lambda p: (-p[1], p[0]))[:3]
        rows.append((r[by], r["n"], r["pos"], 100.0 * r["pos"] / r["n"], auc.get("rf"), auc.get("lr"), [c for c, _ in top], [float(v) for _, v in top]))
    return users.sparkSession.createDataFrame(rows, FLEET_SCHEMA)


def _together(frame: DataFrame, by: str, cohorts: Sequence, forest: tree_models.Forest, columns: Sequence[str], k: int) -> dict:
    """Mean areas by model and the importances of each cohort, from fits in the same passes."""
    if not cohorts:
        return {}
    data = materialize(with_folds(_by_cohort(frame, by, cohorts), k, by=["place"]), "folds")
    grown = tree_models.joint_forests(in_order(data), {"rf": forest}, [-1, *range(k)], k)
    logistics = {str(i): fits.Logistic(columns, place=i) for i in range(len(cohorts))}
    scored = fits.logistic_folds(in_order(data), logistics, k).select(F.col("model").cast("int").alias("place"), F.lit("lr").alias("model"), "fold", "label", "score")
    scored = materialize(scored.unionByName(tree_models.joint_scores(grown).drop("prediction")), "cv")
    keys = ["place", "model", "fold"]
    quality = curve_quality(score_curve(scored, by=keys), keys).groupBy("place", "model").agg(F.avg("auc").alias("auc")).collect()
    strengths = tree_models.joint_importances(grown)
    zero = [0.0] * len(columns)
    return {c[0]: ({r["model"]: r["auc"] for r in quality if r["place"] == i}, strengths.get((i, "rf"), zero)) for i, c in enumerate(cohorts)}


def fleet_drift(users: DataFrame, by: str = "signup_cohort", min_pos: int = 10, k: int = 8, trees: int = 200, min_leaf: int = 2) -> DataFrame:
    """Importance, per cohort, of the features most correlated with success over all users."""
    frame, columns = success_frame(users)
    frame = materialize(frame.join(users.select(KEY, by), KEY), "drift")
    top = [r["feature"] for r in label_correlation(frame, columns, k).collect()]
    sizes = frame.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos")).orderBy(by).collect()
    forest = random_forest(top, trees, min_leaf)
    fitted = [(r[by], r["n"], r["pos"]) for r in sizes if min_pos <= r["pos"] < r["n"]]
    small = [c for c in fitted if c[1] <= tree_models.BLOCK]
    rows: list[tuple] = []
    if small:
        data = materialize(_by_cohort(frame, by, small).withColumn("fold", F.lit(0)), "drift-rows")
        found = tree_models.joint_importances(tree_models.joint_forests(in_order(data), {"rf": forest}, [-1], 0))
        rows += [(f, float(v), small[place][0]) for (place, _), values in found.items() for f, v in zip(top, values, strict=True)]
    for cohort, n, _ in fitted:
        if n > tree_models.BLOCK:
            values = forest.fit(in_order(with_balanced_weights(frame.where(F.col(by).eqNullSafe(F.lit(cohort)))))).importances()
            rows += [(f, float(v), cohort) for f, v in zip(top, values, strict=True)]
    return users.sparkSession.createDataFrame(rows, f"feature string, importance double, {by} string")


def ablation(users: DataFrame, k: int = 5, trees: int = 300, min_leaf: int = 3) -> DataFrame:
    """Quality of the early-signal model of agent users, and its change with each added feature family."""
    base = model_columns(users, EARLY_SIGNALS, drop=("ever_used_agent", "ever_ran_manually"))
    families = {f: model_columns(users, names, referrers=False) for f, names in ABLATION_FAMILIES.items()}
    everything = sorted({c for cols in families.values() for c in cols})
    sets = {"baseline": base, **{f"baseline + {f}": base + cols for f, cols in families.items()}, "baseline + all_new_signals": base + everything}
    rows = users.where(F.col("ever_used_agent") == 1)
    frame = materialize(with_balanced_weights(model_frame(rows, base + everything, F.col("segment") == BUILDER)), "ablation")
    forests = {f"{name}\tRandom Forest": random_forest(columns, trees, min_leaf) for name, columns in sets.items()}
    logistics = {f"{name}\tLogistic Regression": fits.Logistic(columns) for name, columns in sets.items()}
    out = cross_validate(frame, {**forests, **logistics}, k)
    out = out.withColumn("feature_set", F.substring_index("model", "\t", 1)).withColumn("model", F.substring_index("model", "\t", -1))
    out = materialize(out, "ablation-result")
    reference = out.where(F.col("feature_set") == "baseline").select("model", F.col("auc_mean").alias("baseline_auc"), F.col("ap_mean").alias("baseline_ap"))
    return out.join(reference, "model", "left").withColumns(
        {"auc_delta": F.col("auc_mean") - F.col("baseline_auc"), "ap_delta": F.col("ap_mean") - F.col("baseline_ap")}
    )


def churn_score(table: DataFrame, population: DataFrame, trees: int = 350, min_leaf: int = 4, horizon_days: int = 14) -> DataFrame:
    """Churn probability and risk bucket of the modelling population."""
    frame, columns = churn_frame(table, population)
    frame = materialize(frame, "churn")
    model = random_forest(columns, trees, min_leaf).fit(in_order(frame))
    out = score(model, frame).select(KEY, F.col("label").cast("int").alias("is_churn"), F.col("score").alias("churn_probability"))
    return out.withColumns({
        "churn_risk_bucket": risk_bucket("churn_probability"),
        "target_name": F.lit(f"is_{horizon_days}d_survival_churn_proxy"),
        "target_description": F.lit(f"{horizon_days}-day survival-style churn proxy from first-to-last observed activity"),
    })


def propensity_scores(users: DataFrame, treated: str = "ever_used_agent") -> DataFrame:
    """Probability of treatment from sign-up and first-session confounders, cohort dummies included.

    The cohorts read on the driver are the months of the log.
    """
    cohorts = [r[0] for r in users.select("signup_cohort").distinct().orderBy("signup_cohort").collect()]
    dummies = {f"cohort_{c}": flag(F.col("signup_cohort") == c) for c in cohorts}
    rows = users.withColumns(dummies)
    columns = model_columns(rows, (*CONFOUNDERS, *dummies))
    frame = materialize(model_frame(rows, columns, F.col(treated) == 1), "propensity")
    model = logistic(columns, frame.count(), max_iter=500, weighted=False).fit(in_order(frame))
    scored = score(model, frame).select(KEY, F.col("score").alias("propensity_score"))
    return users.join(scored, KEY)


STARTS = 10


def kmeans_archetypes(labelled: DataFrame, k: int = 3, seed: int = SEED, starts: int = STARTS) -> DataFrame:
    """Users with their cluster and its name; clusters are named by falling success rate."""
    rows, best = fits.kmeans(*_archetype_frame(labelled), [k], starts, seed)
    centres = best[k][0] if k in best else []
    clustered = materialize(fits.nearest(rows, centres).withColumnRenamed("label", "success"), "clusters")
    rates = clustered.groupBy("cluster").agg(F.avg("success").alias("rate"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rate"), "cluster"))
    names = F.element_at(F.array(*[F.lit(n) for n in ARCHETYPES[:k]], *[F.lit(f"Cluster {i}") for i in range(len(ARCHETYPES) + 1, k + 1)]), F.col("place"))
    named = rates.withColumn("place", place).select("cluster", names.alias("archetype"))
    return clustered.join(F.broadcast(named), "cluster").select(KEY, "cluster", "archetype", "success")


def archetype_summary(assigned: DataFrame, labelled: DataFrame) -> DataFrame:
    joined = assigned.join(labelled.select(KEY, "days_active", "total_code_runs", "agent_total_events"), KEY)
    return joined.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("users"), F.avg("success").alias("success_rate"), F.avg(F.col("days_active").cast("double")).alias("avg_days"),
        F.avg(F.col("total_code_runs").cast("double")).alias("avg_runs"), F.avg(F.col("agent_total_events").cast("double")).alias("avg_agent"),
    )


def _archetype_frame(labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    columns = model_columns(labelled, ARCHETYPE_FEATURES, referrers=False)
    return materialize(model_frame(labelled, columns, F.col("is_success") == 1), "archetypes"), columns


def kmeans_elbow(labelled: DataFrame, ks: Sequence[int] = tuple(range(2, 8)), seed: int = SEED, starts: int = STARTS) -> DataFrame:
    """Inertia for each number of clusters: the least of all starts, which run together with those of the other numbers."""
    _, best = fits.kmeans(*_archetype_frame(labelled), list(ks), starts, seed)
    return labelled.sparkSession.createDataFrame([(k, inertia) for k, (_, inertia) in best.items()], "k int, inertia double")


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("users"))


def confusion_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the four cell counts."""
    cells = confusion_matrix(scored, label, prediction)
    wide = cells.select("users", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "actual", "predicted").groupBy("class").agg(
        F.coalesce(F.sum(F.when((F.col("actual") == F.col("class")) & (F.col("predicted") == F.col("class")), F.col("users"))), F.lit(0)).alias("hit"),
        F.coalesce(F.sum(F.when(F.col("predicted") == F.col("class"), F.col("users"))), F.lit(0)).alias("called"),
        F.coalesce(F.sum(F.when(F.col("actual") == F.col("class"), F.col("users"))), F.lit(0)).alias("support"),
    )
    zero = F.lit(0)
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("called"), zero), F.lit(0.0))
    recall = F.coalesce(F.col("hit") / F.nullif(F.col("support"), zero), F.lit(0.0))
    out = wide.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    both = F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.withColumn("f1", F.coalesce(2.0 * F.col("precision") * F.col("recall") / both, F.lit(0.0)))


def save_model(model: tree_models.ForestModel, columns: Sequence[str], frame: DataFrame, path: str) -> None:
    """Model and the names of its features, side by side."""
    model.save(f"{path}/model")
    names = frame.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, feature string")
    names.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark, path: str) -> tuple[tree_models.ForestModel, list[str]]:
    names = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return tree_models.ForestModel.load(spark, f"{path}/model"), [r["feature"] for r in names]


def score_stored(table: DataFrame, path: str) -> DataFrame:
    """KEY, score, prediction of any table by a stored model. A feature the table lacks counts as 0, as a missing value does."""
    model, names = load_model(table.sparkSession, path)
    zero = F.lit(0.0)
    rows = table.select(KEY, *[F.coalesce(F.col(c).cast("double"), zero).alias(c) if c in table.columns else zero.alias(c) for c in names])
    return score(model, rows).select(KEY, "score", "prediction")
