"""Many fits of one kind in the same passes over the rows: logistic models of all folds and feature sets, all starts of k-means.

A pass reads the rows once. Each task adds up what every model needs of its rows (numpy over Arrow batches), Spark sums
that by model, and the driver receives sums whose number depends on the models and features alone. It takes the next
step of each model and starts the next pass; models that stand still are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.session import materialize

KEY = "person_id"
SUMS = "model int, at int, value double"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, size: int, add: Callable[[dict[int, np.ndarray], pa.RecordBatch], None]) -> dict[int, np.ndarray]:
    """What ``add`` puts into one array of ``size`` per model, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(sums, batch)
        for model, values in sums.items():
            at = np.flatnonzero(values)
            columns = [pa.array(np.full(len(at), model), pa.int32()), pa.array(at, pa.int32()), pa.array(values[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "at", "value"])

    found = rows.mapInArrow(run, SUMS).groupBy("model", "at").agg(F.sum("value").alias("value")).toArrow()
    out: dict[int, np.ndarray] = {}
    for model, at, value in zip(*(found[c].to_numpy() for c in ("model", "at", "value")), strict=True):
        out.setdefault(int(model), np.zeros(size))[at] = value
    return out


class Logistic:
    """A ridge-penalised logistic model of ``columns`` on centred and scaled features; strength 1 / (C n) of the mean loss.

    With a ``place`` it is fitted on the rows of that place only.
    """

    def __init__(self, columns: Sequence[str], c: float = 1.0, place: int = 0):
        self.columns, self.c, self.place = list(columns), c, place


def _gradient(beta: np.ndarray, mean: np.ndarray, scale: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the rows, one after the other; the intercept is the last place."""
    z = np.hstack([(x - mean) * scale, np.ones((len(x), 1))])
    margin = z @ beta
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    loss = w @ (np.logaddexp(0, margin) - y * margin)
    hessian = (z * (w * p * (1 - p))[:, None]).T @ z
    return np.concatenate([[loss], z.T @ (w * (p - y)), hessian.ravel()])


def _place(data: DataFrame) -> Column:
    return (F.col("place") if "place" in data.columns else F.lit(0)).cast("int").alias("place")


def fit_logistic(data: DataFrame, models: dict[str, Logistic], folds: int, max_iter: int = 50, tol: float = 1e-9) -> list[tuple]:
    """(name, fold, columns, mean, scale, coefficients, intercept) of every model, fitted on the rows outside each fold.

    ``data``: fold, label, weight and the features, and place if models have one. Newton steps, halved where the loss would rise; all models take
    their step in one pass over the rows.
    """
    every = sorted({c for m in models.values() for c in m.columns})
    place = {c: i for i, c in enumerate(every)}
    x = F.array(*[F.col(c).cast("double") for c in every]).alias("x")
    rows = data.select("fold", F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), x, _place(data))
    d = len(every)

    def moments(sums: dict[int, np.ndarray], batch: pa.RecordBatch) -> None:
        fold, x, w = batch.column(4).to_numpy() * folds + batch.column(0).to_numpy(), matrix(batch.column(3)), batch.column(2).to_numpy()
        for f in np.unique(fold).tolist():
            at = fold == f
            sums.setdefault(f, np.zeros(2 + 2 * d))[:] += np.concatenate([[at.sum(), w[at].sum()], x[at].sum(0), (x[at] ** 2).sum(0)])

    by_fold = summed(rows, 2 + 2 * d, moments)
    nothing = np.zeros(2 + 2 * d)
    fits: dict[int, dict] = {}
    for i, (name, model) in enumerate(models.items()):
        at, first = [place[c] for c in model.columns], model.place * folds
        total = sum((v for f, v in by_fold.items() if first <= f < first + folds), nothing)
        for f in range(folds):
            s = total - by_fold.get(first + f, nothing)
            n, mean = s[0], s[2 : 2 + d] / max(s[0], 1)
            std = np.sqrt(np.maximum(s[2 + d :] - n * mean**2, 0) / max(n - 1, 1))
            std[std < 1e-12 * np.maximum(1, np.abs(mean))] = 0
            scale = np.divide(1, std, out=np.zeros(d), where=std > 0)
            fits[i * folds + f] = {
                "name": name, "place": model.place, "fold": f, "at": at, "mean": mean[at], "scale": scale[at], "weight": s[1], "ridge": 1 / (model.c * max(n, 1)),
                "beta": np.zeros(len(at) + 1), "tried": np.zeros(len(at) + 1), "loss": np.inf, "step": None,
            }
    active = {i for i, m in fits.items() if m["weight"] > 0}
    for _ in range(max_iter):
        if not active:
            break
        now = {i: (fits[i]["place"], fits[i]["fold"], fits[i]["at"], fits[i]["mean"], fits[i]["scale"], fits[i]["tried"]) for i in active}

        def add(sums: dict[int, np.ndarray], batch: pa.RecordBatch, now: dict = now) -> None:
            fold, y, w, x, here = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3)), batch.column(4).to_numpy()
            for i, (p, f, at, mean, scale, beta) in now.items():
                use = (here == p) & (fold != f)
                if not use.any():
                    continue
                part = _gradient(beta, mean, scale, x[use][:, at], y[use], w[use])
                sums[i] = sums[i] + part if i in sums else part

        found = summed(rows, (d + 2) ** 2 + 2, add)
        for i in list(active):
            m, n = fits[i], len(fits[i]["beta"])
            values, ridge = found[i], np.append(np.full(n - 1, m["ridge"]), 0.0)
            loss = values[0] / m["weight"] + 0.5 * (ridge * m["tried"] ** 2).sum()
            if loss > m["loss"] + 1e-15:
                m["step"] = m["step"] / 2
            else:
                m["beta"], m["loss"] = m["tried"], loss
                gradient = values[1 : n + 1] / m["weight"] + ridge * m["beta"]
                hessian = values[n + 1 : n + 1 + n * n].reshape(n, n) / m["weight"] + np.diag(ridge + 1e-14)
                m["step"] = -np.linalg.solve(hessian, gradient)
            m["tried"] = m["beta"] + m["step"]
            if np.abs(m["step"]).max() < tol:
                m["beta"] = m["tried"]
                active.discard(i)
    return [(m["name"], m["fold"], [every[a] for a in m["at"]], m["mean"], m["scale"], m["beta"][:-1], float(m["beta"][-1])) for m in fits.values()]


def logistic_folds(data: DataFrame, models: dict[str, Logistic], folds: int) -> DataFrame:
    """KEY, model, fold, label, score, prediction of every row by each model that was fitted without its fold."""
    fits = fit_logistic(data, models, folds)
    every = sorted({c for m in models.values() for c in m.columns})
    place = {c: i for i, c in enumerate(every)}
    ready = [(name, models[name].place, f, [place[c] for c in columns], mean, scale, beta, b) for name, f, columns, mean, scale, beta, b in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x, here = batch.column(1).to_numpy(), matrix(batch.column(3)), batch.column(4).to_numpy()
            for name, p, f, at, mean, scale, beta, b in ready:
                own = np.flatnonzero((here == p) & (fold == f))
                if not len(own):
                    continue
                margin = ((x[own][:, at] - mean) * scale) @ beta + b
                score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                part = batch.take(pa.array(own))
                columns = [part.column(0), pa.array([name] * len(own)), part.column(1), part.column(2), pa.array(score), pa.array((score > 0.5).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "model", "fold", "label", "score", "prediction"])

    x = F.array(*[F.col(c).cast("double") for c in every]).alias("x")
    rows = data.select(F.col(KEY).cast("string").alias("key"), "fold", F.col("label").cast("double").alias("label"), x, _place(data))
    return rows.mapInArrow(run, "key string, model string, fold int, label double, score double, prediction double").drop("key")


# ---- k-means -------------------------------------------------------------------------------------

CANDIDATES = 32  # rows a start chooses its first centres from, per cluster


def standardised(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """KEY, label and x: the columns centred and scaled to deviation 1 (constant ones: 0)."""
    stats = frame.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = [(F.col(c) - F.lit(float(s["m"] or 0))) / F.lit(float(s["s"])) if s["s"] else F.lit(0.0) for c, s in zip(columns, stats, strict=True)]
    return frame.select(KEY, "label", F.array(*scaled).alias("x"))


def first_centres(rows: DataFrame, ks: Sequence[int], starts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """Centres of every (k, start): drawn far from each other among rows drawn by a hash of seed, start and key.

    Each start has CANDIDATES rows per cluster at most, chosen in one job; the driver draws from those.
    """
    most = CANDIDATES * max(ks)
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"), KEY, "x")
    order = F.xxhash64(F.lit(seed), "start", F.col(KEY).cast("string"))
    nth = F.expr(f"row_number() OVER (PARTITION BY start ORDER BY _order, {KEY})")
    drawn = dealt.withColumn("_order", order).withColumn("nth", nth).where(F.col("nth") <= most).select("start", "nth", "x").collect()
    out = {}
    for start in range(starts):
        points = np.array([r["x"] for r in sorted((r for r in drawn if r["start"] == start), key=lambda r: r["nth"])])
        for k in ks:
            rng, centres = np.random.default_rng([seed, start, k]), []
            near = np.ones(len(points))
            for _ in range(min(k, len(points))):
                centres.append(points[rng.choice(len(points), p=near / near.sum())] if near.sum() > 0 else points[len(centres)])
                far = ((points - centres[-1]) ** 2).sum(1)
                near = far if len(centres) == 1 else np.minimum(near, far)
            if centres:
                out[k, start] = np.array(centres)
    return out


def lloyd(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], max_iter: int = 100, tol: float = 1e-4) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Centres and inertia (of the rows to the centres returned) of every start after Lloyd's iterations, one pass for all."""
    names = list(centres)
    now, inertia = dict(centres), {}
    moving = set(names)
    size = max((c.size + len(c) + 1 for c in centres.values()), default=0)
    # A last pass, in which nothing moves, measures the centres that are returned.
    for turn in range(max_iter + 1):
        if len(inertia) == len(names):
            break
        ask = {i: now[m] for i, m in enumerate(names) if m not in inertia}

        def add(sums: dict[int, np.ndarray], batch: pa.RecordBatch, ask: dict = ask) -> None:
            x = matrix(batch.column(0))
            own = (x**2).sum(1)
            for i, c in ask.items():
                apart = own[:, None] - 2 * x @ c.T + (c**2).sum(1)
                best = apart.argmin(1)
                into = sums.setdefault(i, np.zeros(size))
                into[0] += np.maximum(apart[np.arange(len(x)), best], 0).sum()
                into[1 : 1 + len(c)] += np.bincount(best, minlength=len(c))
                moved = (best == np.arange(len(c))[:, None]).astype(float) @ x
                into[1 + len(c) : 1 + len(c) + c.size] += moved.ravel()

        found = summed(rows.select("x"), size, add)
        for i, c in ask.items():
            name, values = names[i], found.get(i, np.zeros(size))
            if name not in moving or turn == max_iter:
                inertia[name] = float(values[0])
                continue
            n = values[1 : 1 + len(c)]
            new = np.where(n[:, None] > 0, values[1 + len(c) : 1 + len(c) + c.size].reshape(c.shape) / np.maximum(n, 1)[:, None], c)
            if ((new - c) ** 2).sum(1).max() <= tol**2:
                moving.discard(name)
            now[name] = new
    return {m: (now[m], inertia[m]) for m in names}


def kmeans(frame: DataFrame, columns: Sequence[str], ks: Sequence[int], starts: int, seed: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, float]]]:
    """The standardised rows, and for each k the centres and inertia of the best start."""
    rows = materialize(standardised(frame, columns), "kmeans")
    done = lloyd(rows, first_centres(rows, ks, starts, seed))
    best = {}
    for (k, start), (centres, inertia) in sorted(done.items()):
        if k not in best or inertia < best[k][1]:
            best[k] = (centres, inertia)
    return rows, best


def nearest(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """KEY, label, cluster of the nearest centre (the first of equals)."""
    away = [
        F.struct(F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), F.lit(i).alias("i"))
        for i, c in enumerate(centres)
    ]
    return rows.select(KEY, "label", (F.array_min(F.array(*away)) if len(away) else F.lit(None).cast("struct<d:double,i:int>"))["i"].alias("cluster"))
