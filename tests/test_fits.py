"""Joint fits against MLlib and plain loops; curves wherever the scores lie; stored models; bootstrap intervals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagekit.operators import fits, matching, models

COLUMNS = ["a", "b", "c", "same"]


def people(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 3), float(rng.randrange(3))
        rows.append((f"u{i:04d}", float(a + 0.3 * b - c + rng.gauss(0, 1) > 0.8), a, b, c, 7.0))
    return spark.createDataFrame(rows, "person_id string, label double, a double, b double, c double, same double")


def test_newton_steps_equal_mllib_in_every_fold(spark):
    data = models.with_folds(models.with_balanced_weights(people(spark)), 3).cache()
    wanted = {"all": fits.Logistic(COLUMNS), "few": fits.Logistic(["a", "c"], 0.05)}
    for name, fold, columns, mean, scale, beta, intercept in fits.fit_logistic(data, wanted, 3):
        train = data.where(F.col("fold") != fold)
        c = wanted[name].c
        stages = models.logistic(columns, train.count(), c, 2000).copy({})
        stages.getStages()[-1].setTol(1e-12)
        model = stages.fit(train).stages
        assert np.allclose(beta, model[-1].coefficients.toArray(), atol=1e-5), (name, fold)
        assert abs(intercept - model[-1].intercept) < 1e-5
        keep = scale > 0
        assert np.allclose(mean, model[1].mean.toArray()) and np.allclose(1 / scale[keep], model[1].std.toArray()[keep])
    scored = fits.logistic_folds(data, wanted, 3).toPandas()
    assert len(scored) == 2 * 400 and set(scored.groupby("model").size()) == {400}


def test_separable_and_one_class_folds(spark):
    rows = spark.createDataFrame([(f"u{i}", float(i >= 10), float(i)) for i in range(20)], "person_id string, label double, a double")
    rows = rows.withColumn("weight", F.lit(1.0))
    quality = models.cross_validate(rows, {"lr": fits.Logistic(["a"], 10.0)}, 4).first()
    assert quality["auc_mean"] == 1.0
    assert models.cross_validate_folds(rows.where("label = 0"), {"lr": fits.Logistic(["a"])}, 2).where("auc IS NULL").count() == 2


def plain_lloyd(x, centres):
    for _ in range(100):
        best = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[best == i].mean(0) if (best == i).any() else c for i, c in enumerate(centres)])
        done = ((new - centres) ** 2).sum(1).max() <= 1e-8
        centres = new
        if done:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_all_starts_equal_plain_loops(spark):
    rows = fits.standardised(people(spark, 300), COLUMNS).cache()
    x = np.array([r["x"] for r in rows.collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x[:, :3].std(0, ddof=1), 1) and (x[:, 3] == 0).all()
    first = fits.first_centres(rows, [2, 3, 5], 4, 42)
    assert len(first) == 12
    for model, (centres, inertia) in fits.lloyd(rows, first).items():
        want, least = plain_lloyd(x, first[model])
        assert np.allclose(centres, want, atol=1e-6) and abs(inertia - least) < 1e-6 * least
    centres, _ = fits.kmeans(people(spark, 300), COLUMNS, [3], 4, 42)[1][3]
    got = {r.person_id: r.cluster for r in fits.nearest(rows, centres).collect()}
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert [got[r["person_id"]] for r in rows.collect()] == near.tolist()


def test_fewer_rows_than_clusters_and_none(spark):
    few = people(spark, 2)
    _, best = fits.kmeans(few, COLUMNS, [2, 4], 2, 1)
    assert best[2][1] == 0 and best[4][1] == 0
    assert fits.kmeans(few.limit(0), COLUMNS, [2], 2, 1)[1] == {}


def test_passes_do_not_grow_with_models(spark):
    """One job per step for all folds and sets: more folds take no more jobs than steps."""
    data = models.with_folds(models.with_balanced_weights(people(spark, 200)), 8).cache()
    data.count()
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for name, sets in (("one", {"x": fits.Logistic(COLUMNS)}), ("many", {f"s{i}": fits.Logistic(COLUMNS, 0.5 + i) for i in range(6)})):
        spark.sparkContext.setJobGroup(name, name)
        fits.fit_logistic(data, sets, 8)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["many"] <= 2 * jobs["one"]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_curve_of_crowded_scores_has_even_cells(spark, by):
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, 0.999 + F.col("id") / (1000.0 * n)).otherwise(F.col("id") / float(n)).alias("score"),
        (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 2).alias("g"),
    )
    curve = models.score_curve(rows, by=by)
    assert curve.count() == n
    seen = rows.toPandas()
    for _, part in seen.groupby("g") if by else [(None, seen)]:
        order = part.score.rank()
        pos = part.label == 1
        want = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
        got = models.curve_quality(curve, by).toPandas()
        assert min(abs(got.auc - want)) < 1e-9
    cells = spark.createDataFrame(seen[["score"]]).repartitionByRange(models.CURVE_CELLS, "score").withColumn("cell", F.spark_partition_id())
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 0.02 * n


def test_stored_model_scores_tables_that_lack_columns(spark, tmp_path):
    frame = models.with_balanced_weights(people(spark, 120))
    model = models.random_forest(COLUMNS, 5, 2, 5).fit(models.in_order(frame))
    models.save_model(model, COLUMNS, frame, str(tmp_path))
    want = {r.person_id: r.score for r in models.score(model, frame.withColumn("b", F.lit(0.0)).withColumn("c", F.lit(0.0))).collect()}
    table = frame.select("person_id", "a", "same", F.lit(None).cast("double").alias("c"), F.lit("x").alias("other"))
    assert {r.person_id: r.score for r in models.score_stored(table, str(tmp_path)).collect()} == want


def test_effect_and_its_interval(spark):
    rng = random.Random(1)
    users = [(f"u{i:04d}", "Agent Builder" if rng.random() < (0.6 if i < 300 else 0.3) else "x", i % 9, i % 2, 0.5) for i in range(600)]
    table = spark.createDataFrame(users, "person_id string, segment string, days_active int, had_second_session int, propensity_score double")
    pairs = spark.createDataFrame([(f"u{i:04d}", f"u{i + 300:04d}") for i in range(300)], "treated_id string, control_id string")
    rows = {r.outcome: r for r in matching.effect_with_intervals(pairs, table).collect()}
    gaps = np.array([100.0 * ((users[i][1] != "x") - (users[i + 300][1] != "x")) for i in range(300)])
    r = rows["Agent Builder %"]
    assert abs(r.difference - gaps.mean()) < 1e-9 and r.pairs == 300 and r.low < r.difference < r.high
    assert 0.6 < (r.high - r.low) / (2 * 1.96 * gaps.std() / np.sqrt(300)) < 1.5
    assert rows["Propensity score"].low == rows["Propensity score"].high == 0
    assert matching.effect_with_intervals(pairs.limit(3), table).count() == 0
