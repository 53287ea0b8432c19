"""Forests in tables and boosted trees of all folds: against MLlib, single trees and each other."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from usagekit.operators import models, trees

COLUMNS = ["a", "b", "c"]


def people(spark, n=600, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 3), float(rng.randrange(4))
        rows.append((f"u{i:04d}", float(a * a + 0.3 * b - c + rng.gauss(0, 0.7) > 0.8), a, b, c))
    return spark.createDataFrame(rows, "person_id string, label double, a double, b double, c double")


def scores(df):
    return {r.person_id: r.score for r in df.collect()}


def test_no_forest_on_the_driver(spark, monkeypatch):
    """Blocks of 40 rows: the nodes above are split by added histograms, and the forest learns the same."""
    frame = models.with_balanced_weights(people(spark))
    whole = models.random_forest(COLUMNS, 12, 3).fit(models.in_order(frame))
    monkeypatch.setattr(trees, "BLOCK", 40)
    cut = models.random_forest(COLUMNS, 12, 3).fit(models.in_order(frame))
    assert not hasattr(whole, "stages") and max(len(t["feature"]) for t in cut.tops) > 10 and max(len(t["feature"]) for t in whole.tops) == 1
    a, b = scores(whole.score(frame)), scores(cut.score(frame))
    label = {r.person_id: r.label for r in frame.collect()}
    for got in (a, b):
        assert len(got) == 600 and np.mean([(got[u] > 0.5) == (v == 1) for u, v in label.items()]) > 0.9
    assert np.corrcoef([a[u] for u in label], [b[u] for u in label])[0, 1] > 0.93
    for model in (whole, cut):
        assert model.importances().sum() == pytest.approx(1) and (model.importances() > 0.05).all()


def test_one_tree_takes_the_best_split_and_depth_and_leaf_bounds(spark, monkeypatch):
    rows = [(f"u{i}", float(i >= 30), float(i), 0.0, 0.0) for i in range(100)]
    frame = spark.createDataFrame(rows, "person_id string, label double, a double, b double, c double")
    monkeypatch.setattr(trees, "draws", lambda seed, tree, row: np.ones(len(row), int))
    model = models.random_forest(["a"], 1, 1, 30, weighted=False).fit(frame)
    nodes = trees.unpacked(bytes(model.parts.first()["nodes"]))
    assert len(nodes["feature"]) in (3, 5, 7) and model.importances().tolist() == [1.0]
    assert {r.person_id: r.prediction for r in model.score(frame).collect() if abs(int(r.person_id[1:]) - 30) > 4} == {u: y for u, y, *_ in rows if abs(int(u[1:]) - 30) > 4}
    for min_leaf, depth, size in ((60, 30, 1), (1, 0, 1), (30, 1, 3)):
        small = models.random_forest(["a"], 1, min_leaf, depth, weighted=False).fit(frame)
        assert len(trees.unpacked(bytes(small.parts.first()["nodes"]))["feature"]) == size


def test_keys_may_repeat_and_scores_keep_every_row(spark):
    frame = models.with_balanced_weights(people(spark, 80))
    twice = frame.unionByName(frame).unionByName(frame.limit(3).withColumn("person_id", F.lit(None).cast("string")))
    model = models.random_forest(COLUMNS, 5, 2).fit(twice)
    assert model.score(twice).count() == 163


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_boosted_folds_follow_mllib(spark, share):
    """Few values per feature, so the bins are the same: scores after some rounds agree with a fit per fold."""
    rows = people(spark, 300).select("person_id", "label", *[F.round(c).alias(c) for c in COLUMNS])
    data = models.with_folds(rows, 3).cache()
    got = trees.boosted_folds(models.in_order(data), {"gb": trees.Boosting(COLUMNS, 12, 0.1, 3, share)}, 3)
    assert got.count() == 300
    want = []
    for f in range(3):
        plain = Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), GBTClassifier(maxIter=12, stepSize=0.1, maxDepth=3, subsamplingRate=share, seed=1)])
        out = plain.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
        want += [(f, r.label, round(r.s, 6)) for r in out.select("label", vector_to_array("probability")[1].alias("s")).collect()]
    mine = sorted((r.fold, r.label, round(r.score, 6)) for r in got.collect())
    if share == 1:
        assert [m[:2] for m in mine] == [w[:2] for w in sorted(want)]
        assert np.abs(np.array([m[2] for m in mine]) - np.array([w[2] for w in sorted(want)])).max() < 1e-4
    else:
        assert np.abs(np.array([m[2] for m in mine]) - np.array([w[2] for w in sorted(want)])).mean() < 0.05


def test_joint_forests_are_those_fitted_alone(spark, monkeypatch):
    """All folds and column sets in one job give the scores of one fit each; unweighted, so sums do not depend on the order of rows."""
    data = models.with_folds(people(spark, 300).withColumn("weight", F.lit(1.0)), 2).cache()
    forests = {"all": models.random_forest(COLUMNS, 30, 3, weighted=False), "few": models.random_forest(["a", "c"], 8, 2, weighted=False)}
    grown = trees.joint_forests(models.in_order(data.withColumn("place", F.lit(0))), forests, [-1, 0, 1], 2)
    got = trees.joint_scores(grown)
    assert got.count() == 600
    for name, forest in forests.items():
        for f in range(2):
            alone = forest.fit(models.in_order(data.where(F.col("fold") != f))).score(data.where(F.col("fold") == f))
            mine = got.where((F.col("model") == name) & (F.col("fold") == f))
            assert sorted(tuple(r) for r in mine.select("label", "score", "prediction").collect()) == sorted(tuple(r) for r in alone.select("label", "score", "prediction").collect())
        assert np.allclose(trees.joint_importances(grown)[0, name], forest.fit(models.in_order(data)).importances())
    monkeypatch.setattr(trees.Forest, "fit", None)
    assert models.cross_validate_folds(data.drop("fold"), forests, 2).count() == 4


def test_cohorts_are_fitted_together_and_as_if_alone(spark, monkeypatch):
    """Cohorts of which one is null, one has few builders: the report is that of a fit per cohort."""
    users = people(spark, 400).withColumns({"segment": F.when(F.col("label") == 1, models.BUILDER).otherwise("Viewer"), "signup_hour": F.col("a"), "signup_is_weekend": F.col("c")})
    month = F.when(F.col("person_id") < "u0150", "2024-01").when(F.col("person_id") < "u0385", "2024-02").when(F.col("person_id") < "u0390", "2024-03")
    users = users.withColumn("signup_cohort", month).drop("label")
    plain = models.random_forest
    monkeypatch.setattr(models, "random_forest", lambda columns, trees, min_leaf: plain(columns, trees, min_leaf, weighted=False))
    monkeypatch.setattr(trees.Forest, "fit", None)
    fleet = [tuple(r) for r in models.fleet_models(users, trees=6).collect()]
    assert [(r[0], r[1], r[4] is None, len(r[6])) for r in fleet] == [(None, 10, True, 0), ("2024-01", 150, False, 2), ("2024-02", 235, False, 2), ("2024-03", 5, True, 0)]
    rows, columns = models.success_frame(users.where("signup_cohort = '2024-02'"))
    alone = models.cross_validate(models.with_balanced_weights(rows), {"rf": plain(columns, 6, 2, weighted=False), "lr": models.fits.Logistic(columns)}, 5)
    assert {r["model"]: pytest.approx(r["auc_mean"]) for r in alone.collect()} == {"rf": fleet[2][4], "lr": fleet[2][5]}
    drift = models.fleet_drift(users, trees=6).groupBy("signup_cohort").agg(F.round(F.sum("importance"), 6).alias("s")).collect()
    assert {tuple(r) for r in drift} == {("2024-01", 1.0), ("2024-02", 1.0)}


def test_scores_do_not_depend_on_blocks_and_chunks(spark, monkeypatch):
    """Rows meet the forest in blocks and chunks, and the scores are those of each tree on each row, to the bit."""
    frame = models.with_balanced_weights(people(spark))
    monkeypatch.setattr(trees, "BLOCK", 100)
    model = models.random_forest(COLUMNS, 9, 3).fit(models.in_order(frame))
    whole = scores(model.score(frame))
    monkeypatch.setattr(trees, "SCORE_ROWS", 150)
    monkeypatch.setattr(trees, "CHUNK_BYTES", 500)
    assert scores(model.score(frame)) == whole and len(whole) == 600
    data = frame.toPandas()
    xb, sums = trees.binned(data[COLUMNS].to_numpy(), model.cuts), np.zeros(600, np.int64)
    grown = {(r.tree, r.node): trees.unpacked(bytes(r.nodes)) for r in model.parts.collect()}
    for tree, top in enumerate(model.tops):
        for node, own in trees.by_place(trees.route(top, xb)):
            nodes = grown[tree, node]
            sums[own] += np.rint(nodes["value"][trees.route(nodes, xb[own])] * trees.ONE).astype(np.int64)
    assert [whole[u] for u in data.person_id] == (sums / 9 / trees.ONE).tolist()


def test_batch_scores_build_their_labels_once(spark, monkeypatch):
    """The result reads the written labels; their lineage, a pass over the log, is not in it again."""
    from usagekit.plans import catalog

    plain = models.random_forest
    monkeypatch.setattr(models, "random_forest", lambda columns, trees, min_leaf: plain(columns, 5, min_leaf))
    out = catalog.queries()["ces_batch_score"](spark, "/root/testdata/sf0.001")
    tables = {name.rsplit("/", 2)[1].rpartition("-")[0] for name in out.inputFiles()}
    assert tables == {"ces-labelled", "ces-scores"} and out.count() > 0
