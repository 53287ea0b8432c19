"""Distributed operators against plain Python on random data that crosses slices, cells and queues."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagekit.functions.stats import exact_quantiles
from usagekit.operators import matching, models, ordered

T0 = dt.datetime(2025, 1, 1)


def random_log(spark, seed, users=6, n=300, hot=0.5):
    """Half of the rows belong to one user; gaps run from seconds to days."""
    rnd = random.Random(seed)
    clock = {u: T0 for u in range(users)}
    rows = []
    for i in range(n):
        u = 0 if rnd.random() < hot else rnd.randrange(1, users)
        clock[u] += dt.timedelta(seconds=rnd.choice([0, 5, 600, 1799, 1800, 1801, 4000, 90000]))
        rows.append((f"u{u}", i, clock[u], rnd.choice("ABC")))
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "person_id string, event_id long, ts timestamp, token string")


def by_user(rows):
    out = {}
    for p, i, ts, token in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(p, []).append((i, ts, token))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sessionize(spark, seed):
    rows, df = random_log(spark, seed)
    want = {}
    for events in by_user(rows).values():
        number, last = 0, None
        for i, ts, _ in events:
            number += last is None or (ts - last).total_seconds() > 1800
            want[i], last = number, ts
    assert {r.event_id: r.session_num for r in ordered.sessionize(df).collect()} == want


@pytest.mark.parametrize("n", [2, 3, 4])
def test_ngrams(spark, n):
    rows, df = random_log(spark, n)
    want = Counter()
    for events in by_user(rows).values():
        tokens = [t for *_, t in events]
        want.update(" -> ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    got = ordered.ngrams(df, n, ["person_id"]).groupBy("gram").count().collect()
    assert {r.gram: r["count"] for r in got} == dict(want)


def test_dedup_steps(spark):
    rows, df = random_log(spark, 5)
    want = {}
    for p, events in by_user(rows).items():
        path = []
        for *_, t in events:
            if not path or path[-1] != t:
                path.append(t)
        want[p] = (path + [None] * 6)[:6]
    got = ordered.dedup_steps(df, F.col("token"), 6).collect()
    assert {r.person_id: [r[f"step_{i}"] for i in range(1, 7)] for r in got} == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(0, 5, 500)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 4.0), ("c", None)], "g string, v double")
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got["b"][name] == pytest.approx(1 + 3 * p)
    assert "c" not in got
    assert exact_quantiles(df, "v", {"m": 0.5}).collect()[0].m == pytest.approx(np.quantile(np.append(values, [1.0, 4.0]), 0.5))


def greedy(rows, caliper):
    controls = sorted((p, i) for i, p, t in rows if t == 0)
    used, out = set(), {}
    for i, p, t in sorted(r for r in rows if r[2] == 1):
        near = [(abs(q - p), q, j) for q, j in controls if j not in used and abs(q - p) <= caliper]
        if near:
            used.add(min(near)[2])
            out[i] = min(near)[2]
    return out


@pytest.mark.parametrize("seed,share,digits", [(1, 0.5, 10), (2, 0.8, 3), (3, 0.6, 4)])
def test_matching_equals_sequential_greedy(spark, seed, share, digits):
    rnd = random.Random(seed)
    scale = 2**digits  # scores on a binary grid: exact distances, many ties with few digits
    rows = [(f"u{i:03d}", int(rnd.random() * scale) / scale, int(rnd.random() < share)) for i in range(50)]
    df = spark.createDataFrame(rows, "person_id string, propensity_score double, ever_used_agent int")
    for block in (None, 3):  # all controls in one block, and users that move through several
        pairs = matching.propensity_match(df, caliper=0.125, block=block).collect()
        assert {r.treated_id: r.control_id for r in pairs} == greedy(rows, 0.125)
        assert len({r.control_id for r in pairs}) == len(pairs)
        assert all(r.score_gap <= 0.125 for r in pairs)


def test_matching_of_many_users_on_five_scores(spark):
    """20,000 users within one caliper: queues of neighbouring scores push each other on; the pairs of the plain loop."""
    rnd = random.Random(11)
    scores = [0.50, 0.51, 0.52, 0.53, 0.54]
    rows = [(f"u{i:05d}", rnd.choice(scores), int(rnd.random() < 0.5)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "person_id string, propensity_score double, ever_used_agent int")
    for block in (None, 1500):
        pairs = matching.propensity_match(df, block=block).collect()
        free = {s: sorted(i for i, p, t in rows if p == s and t == 0)[::-1] for s in scores}
        want = {}
        for i, p, t in sorted(rows):
            near = [(abs(q - p), q) for q in scores if free[q] and abs(q - p) <= 0.05]
            if t and near:
                want[i] = free[min(near)[1]].pop()
        assert {r.treated_id: r.control_id for r in pairs} == want


def test_places_find_the_nearest_that_accepts():
    rnd = random.Random(5)
    places, held = matching.Places(np.linspace(0, 1, 37)), [matching.FREE] * 37
    for _ in range(600):
        at, turn, left = rnd.randrange(37), rnd.randrange(100), rnd.random() < 0.5
        way = range(at, -1, -1) if left else range(at, 37)
        assert places.nearest(at, turn, left) == next((i for i in way if held[i] > turn), None)
        i = rnd.randrange(37)
        held[i] = rnd.choice([rnd.randrange(100), matching.FREE])
        places.give(i, held[i])


def test_matching_of_few_scores_splits_ties(spark, monkeypatch):
    """Most users on one score, more cells than it would fill alone: the sequential result all the same."""
    rnd = random.Random(7)
    scores = [0.1, 0.4, 0.9]
    rows = [(f"u{i:05d}", rnd.choice(scores[:1] * 8 + scores), int(rnd.random() < 0.55)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "person_id string, propensity_score double, ever_used_agent int")
    monkeypatch.setattr(matching, "CELLS", 16)
    pairs = matching.propensity_match(df, caliper=0.05).collect()
    free = {s: [i for i, p, t in sorted(rows) if p == s and t == 0] for s in scores}
    want = {}
    for i, p, t in sorted(rows):
        near = [(abs(q - p), q) for q in scores if free[q] and abs(q - p) <= 0.05]
        if t and near:
            want[i] = free[min(near)[1]].pop(0)
    assert {r.treated_id: r.control_id for r in pairs} == want


def test_curve_quality(spark):
    rnd = random.Random(4)
    rows = [(f"u{i}", rnd.randrange(2), round(rnd.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "person_id string, label int, score double")
    got = models.curve_quality(models.score_curve(df)).collect()[0]
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    tp = fp = 0
    ap = 0.0
    for s in sorted({s for *_, s in rows}, reverse=True):
        hit = sum(p == s for p in pos)
        tp, fp = tp + hit, fp + sum(n == s for n in neg)
        ap += hit / len(pos) * tp / (tp + fp)
    assert got.auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)


def test_models_learn_and_persist(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for i in range(300):
        x, z = rnd.random(), rnd.random()
        rows.append((f"u{i}", x, z, "Agent Builder" if x + 0.1 * rnd.random() > 0.6 else "Viewer"))
    users = spark.createDataFrame(rows, "person_id string, x double, z double, segment string")
    frame = models.with_balanced_weights(models.model_frame(users, ["x", "z"], F.col("segment") == "Agent Builder"))
    total = frame.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert total[0].w == pytest.approx(total[1].w)
    quality = models.cross_validate(frame, {"rf": models.random_forest(["x", "z"], 10), "lr": models.logistic(["x", "z"], 300)}, 3).collect()
    assert all(r.auc_mean > 0.95 and r.folds == 3 for r in quality)
    model = models.random_forest(["x", "z"], 10).fit(frame)
    assert models.feature_importance(model, frame, ["x", "z"]).first().feature == "x"
    models.save_model(model, ["x", "z"], frame, str(tmp_path / "m"))
    loaded, names = models.load_model(spark, str(tmp_path / "m"))
    assert names == ["x", "z"]
    a = {r.person_id: r.score for r in models.score(model, frame).collect()}
    assert {r.person_id: r.score for r in models.score(loaded, frame).collect()} == a
