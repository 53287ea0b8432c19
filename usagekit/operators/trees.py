"""Forests and boosted trees whose size and fit stay in tables and tasks, not on the driver.

A fit reads features as bins (32 at most, cut as MLlib cuts them). Nodes of a forest with more rows than ``BLOCK`` are split
by histograms that tasks add up; once a node is smaller, its rows go to one task, which grows the rest of that tree. The
grown parts are rows of a table, so no process holds a forest. Boosted trees of all folds take each level in one pass.
Forests of all folds, feature sets and groups whose fits have ``BLOCK`` rows at most are grown in one job: a task gets the
rows of a fit once for some of its trees and scores the rows held out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagekit.operators.fits import matrix
from usagekit.session import drop_table, materialize

BINS = 32
BLOCK = 65_536  # rows of a node that one task grows to its leaves
NODES_AT_ONCE = 4_096  # nodes whose histograms a task holds at a time
GROUPS = 96  # tasks of a fit and of its scores
SCORE_BLOCKS, SCORE_CHUNKS = 4, 32  # blocks of the rows to score and chunks of the forest that meet in a task, or
SCORE_ROWS, CHUNK_BYTES = 1 << 19, 64 << 20  # more, so that a block and a chunk have no more than this
CHUNK = 25  # trees of one fit that a task grows on the rows it got, where fits are joint
ONE = 1 << 40  # probabilities are summed as whole numbers, so the order of rows does not matter
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


# ---- bins and draws ------------------------------------------------------------------------------


def numbered(frame: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """The written rows with a number each, the named columns and the features as one list."""
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    return materialize(frame.select(F.monotonically_increasing_id().alias("row"), *more, x), "tree-rows")


def cut_points(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but the last: between all values if there are few, else quantiles."""
    long = rows.select(F.posexplode("x").alias("f", "v"))
    values = long.distinct()
    many = {r["f"] for r in values.groupBy("f").count().where(F.col("count") > BINS).collect()}
    cuts = [np.zeros(0) for _ in range(width)]
    few: dict[int, list[float]] = {}
    for r in values.where(~F.col("f").isin(*many)).collect() if many else values.collect():
        few.setdefault(r["f"], []).append(r["v"])
    for f, found in few.items():
        found = np.sort(found)
        cuts[f] = (found[1:] + found[:-1]) / 2
    if many:
        at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
        for r in long.where(F.col("f").isin(*many)).groupBy("f").agg(F.percentile_approx("v", at, 10_000).alias("q")).collect():
            cuts[r["f"]] = np.unique(r["q"])
    return cuts


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty((len(x), len(cuts)), np.uint8)
    for f, ends in enumerate(cuts):
        out[:, f] = np.searchsorted(ends, x[:, f], side="left")
    return out


def uniform(seed: int, draw: int, rows: np.ndarray) -> np.ndarray:
    """A number in [0, 1) per row that depends on seed, draw and row only."""
    with np.errstate(over="ignore"):
        h = rows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64((seed << 20) + draw + 1)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def draws(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often the bootstrap of a tree takes each row."""
    return np.searchsorted(POISSON, uniform(seed, tree, rows), side="right")


# ---- one part of a tree --------------------------------------------------------------------------


def route(nodes: dict[str, np.ndarray], xb: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at, feature, every = np.zeros(len(xb), np.int64), nodes["feature"], np.arange(len(xb))
    moving = every[feature[at] >= 0]
    while len(moving):
        here = at[moving]
        at[moving] = nodes["left"][here] + (xb[moving, feature[here]] > nodes["cut"][here])
        moving = moving[feature[at[moving]] >= 0]
    return at


def histograms(xb: np.ndarray, node: np.ndarray, features: np.ndarray, values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Sums of each of ``values`` by node, one of the features of the node, and bin."""
    nodes, few = features.shape
    place = ((node[:, None] * few + np.arange(few)) * BINS + xb[np.arange(len(xb))[:, None], features[node]]).ravel()
    return [np.bincount(place, np.repeat(v, few), nodes * few * BINS).reshape(nodes, few, BINS) for v in values]


def best_splits(weight: np.ndarray, positive: np.ndarray, count: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Per node: place of the feature, last bin of the left side and weighted Gini gain (0: no split)."""
    def impurity(p: np.ndarray, w: np.ndarray) -> np.ndarray:
        return 2 * (p - np.divide(p * p, w, out=np.zeros_like(w), where=w > 0))

    w, p, n = (h.cumsum(2) for h in (weight, positive, count))
    whole_w, whole_p, whole_n = (h[:, :, -1:] for h in (w, p, n))
    gain = impurity(whole_p, whole_w) - impurity(p, w) - impurity(whole_p - p, whole_w - w)
    gain[(n < min_leaf) | (whole_n - n < min_leaf) | (gain <= 1e-12 * whole_w)] = 0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    return best // BINS, best % BINS, flat[np.arange(len(flat)), best]


def grow(xb: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, rng: np.random.Generator, few: int, depth: int, min_leaf: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Nodes of a part of a tree, level by level, and the gain of each feature."""
    width, gains = xb.shape[1], np.zeros(xb.shape[1])
    levels, size = [], 1
    w, rows, pos, nodes = w * c, np.arange(len(xb)), np.zeros(len(xb), np.int64), 1
    while nodes:
        tw, tp, tn = (np.bincount(pos, v[rows], nodes) for v in (w, w * y, c))
        level = {
            "feature": np.full(nodes, -1, np.int32), "cut": np.zeros(nodes, np.int32), "left": np.zeros(nodes, np.int32),
            "value": np.divide(tp, tw, out=np.zeros(nodes), where=tw > 0),
        }
        levels.append(level)
        ask = np.flatnonzero((tn >= 2 * min_leaf) & (tp > 0) & (tp < tw)) if depth > 0 else []
        for first in range(0, len(ask), NODES_AT_ONCE):
            part = ask[first : first + NODES_AT_ONCE]
            place = np.full(nodes, -1)
            place[part] = np.arange(len(part))
            own = np.flatnonzero(place[pos] >= 0)
            features = np.sort(np.argsort(rng.random((len(part), width)), axis=1)[:, :few], axis=1)
            take = rows[own]
            f, cut, gain = best_splits(*histograms(xb[take], place[pos[own]], features, [w[take], (w * y)[take], c[take]]), min_leaf)
            good = gain > 0
            chosen = features[np.arange(len(part)), f]
            level["feature"][part[good]], level["cut"][part[good]] = chosen[good], cut[good]
            np.add.at(gains, chosen[good], gain[good])
        split = np.flatnonzero(level["feature"] >= 0)
        level["left"][split] = size + 2 * np.arange(len(split))
        going = level["feature"][pos] >= 0
        rows, old = rows[going], pos[going]
        pos = level["left"][old] - size + (xb[rows, level["feature"][old]] > level["cut"][old])
        size, nodes, depth = size + 2 * len(split), 2 * len(split), depth - 1
    return {k: np.concatenate([v[k] for v in levels]) for k in levels[0]}, gains


def packed(nodes: dict[str, np.ndarray]) -> bytes:
    return b"".join(nodes[k].astype(t).tobytes() for k, t in (("value", np.float64), ("feature", np.int32), ("cut", np.int32), ("left", np.int32)))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    n = len(blob) // 20
    whole = np.frombuffer(blob, np.int32, 3 * n, 8 * n).reshape(3, n)
    return {"value": np.frombuffer(blob, np.float64, n), "feature": whole[0], "cut": whole[1], "left": whole[2]}


def leaf(value: float = 0.0) -> dict[str, np.ndarray]:
    return {"feature": np.array([-1]), "cut": np.array([0]), "left": np.array([0]), "value": np.array([value])}


def by_place(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with its places."""
    order = np.argsort(at, kind="stable")
    ends = np.flatnonzero(np.diff(at[order])) + 1
    for places in np.split(order, ends) if len(order) else []:
        yield int(at[places[0]]), places


# ---- forests -------------------------------------------------------------------------------------

ROWS = "tree int, node int, part int, n int, at long, rows binary"
PARTS = "tree int, node int, nodes binary, gains array<double>"


class Forest:
    """Bootstrapped classification trees by Gini gain, with a root's share of the features drawn at every node."""

    def __init__(self, columns: Sequence[str], trees: int, min_leaf: int, max_depth: int, weighted: bool, seed: int):
        self.columns, self.trees, self.min_leaf, self.max_depth, self.weighted, self.seed = list(columns), trees, min_leaf, max_depth, weighted, seed

    @property
    def few(self) -> int:
        return len(self.columns) if self.trees == 1 else int(np.ceil(np.sqrt(len(self.columns))))

    def fit(self, frame: DataFrame) -> ForestModel:
        weight = F.col("weight").cast("double") if self.weighted else F.lit(1.0)
        rows = numbered(frame.withColumns({"y": F.col("label").cast("double"), "w": weight}), self.columns, "y", "w")
        cuts = cut_points(rows, len(self.columns))
        tops, depths, gains = self._tops(rows, cuts)
        few, trees, seed, most, min_leaf, width = self.few, self.trees, self.seed, self.max_depth, self.min_leaf, len(self.columns)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, turn = TaskContext.get().partitionId(), 0
            for batch in batches:
                row, y, w = (batch.column(i).to_numpy() for i in range(3))
                xb = binned(matrix(batch.column(3)), cuts) if len(row) else np.zeros((0, width), np.uint8)
                for tree in range(trees):
                    c = draws(seed, tree, row)
                    use = np.flatnonzero(c)
                    for node, at in by_place(route(tops[tree], xb[use])):
                        if depths[tree][node] < 0:
                            continue
                        own = use[at]
                        blob = w[own].tobytes() + y[own].astype(np.uint8).tobytes() + c[own].astype(np.uint8).tobytes() + xb[own].tobytes()
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "part": pa.array([part], pa.int32()),
                            "n": pa.array([len(own)], pa.int32()), "at": pa.array([turn], pa.int64()), "rows": pa.array([blob], pa.binary()),
                        })
                turn += 1

        def rest(key: tuple, table: pa.Table) -> pa.Table:
            tree, node = key[0].as_py(), key[1].as_py()
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for r in table.select(["n", "rows"]).take(pc.sort_indices(table, [("part", "ascending"), ("at", "ascending")])).to_pylist():
                n, blob = r["n"], r["rows"]
                columns[0].append(np.frombuffer(blob, np.float64, n))
                columns[1].append(np.frombuffer(blob, np.uint8, n, 8 * n))
                columns[2].append(np.frombuffer(blob, np.uint8, n, 9 * n))
                columns[3].append(np.frombuffer(blob, np.uint8, n * width, 10 * n).reshape(n, width))
            w, y, c, xb = (np.concatenate(v) for v in columns)
            nodes, found = grow(xb, y.astype(float), w, c.astype(float), np.random.default_rng([seed, tree, node, 1]), few, most - depths[tree][node], min_leaf)
            return pa.table({
                "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                "nodes": pa.array([packed(nodes)], pa.binary()), "gains": pa.array([found.tolist()], pa.list_(pa.float64())),
            })

        dealt = rows.select("row", "y", "w", "x").mapInArrow(deal, ROWS).repartition(GROUPS, "tree", "node")
        grown = dealt.groupBy("tree", "node").applyInArrow(rest, PARTS)
        ends = [(t, n, packed(leaf(float(tops[t]["value"][n]))), [0.0] * width) for t in range(trees) for n in np.flatnonzero((tops[t]["feature"] < 0) & (depths[t] < 0)).tolist()]
        if ends:
            grown = grown.unionByName(frame.sparkSession.createDataFrame(ends, PARTS))
        parts = materialize(grown, "forest")
        drop_table(rows)
        return ForestModel(self.columns, trees, cuts, tops, gains, parts)

    def _tops(self, rows: DataFrame, cuts: list[np.ndarray]) -> tuple[list[dict], list[np.ndarray], np.ndarray]:
        """Per tree the nodes above those of at most ``BLOCK`` rows, their depths (-1: no rows go on), and the gains so far."""
        few, seed, min_leaf, width = self.few, self.seed, self.min_leaf, len(self.columns)
        tops, depths, gains = [leaf() for _ in range(self.trees)], [np.zeros(1, int) for _ in range(self.trees)], np.zeros((self.trees, width))
        open_nodes = {(t, 0) for t in range(self.trees)} if rows.count() > BLOCK else set()
        while open_nodes:
            asked = {t: np.array(sorted(n for u, n in open_nodes if u == t)) for t in {t for t, _ in open_nodes}}
            features = {(t, n): np.sort(np.random.default_rng([seed, t, n, 0]).permutation(width)[:few]) for t, n in open_nodes}

            def add(batches: Iterator[pa.RecordBatch], asked: dict = asked, features: dict = features) -> Iterator[pa.RecordBatch]:
                sums: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    row, y, w = (batch.column(i).to_numpy() for i in range(3))
                    if not len(row):
                        continue
                    xb = binned(matrix(batch.column(3)), cuts)
                    for tree, nodes in asked.items():
                        c = draws(seed, tree, row)
                        use = np.flatnonzero(c)
                        for node, at in by_place(route(tops[tree], xb[use])):
                            if node in nodes:
                                own = use[at]
                                v = w[own] * c[own]
                                into = sums.setdefault((tree, node), np.zeros((3, few, BINS)))
                                into += np.concatenate(histograms(xb[own], np.zeros(len(own), int), features[tree, node][None], [v, v * y[own], c[own]]))
                part = TaskContext.get().partitionId()
                for (tree, node), v in sums.items():
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([v.tobytes()], pa.binary()),
                    })

            def choose(key: tuple, table: pa.Table) -> pa.Table:
                total = np.zeros((3, few, BINS))
                for blob in table.sort_by("part")["sums"].to_pylist():
                    total += np.frombuffer(blob).reshape(total.shape)
                weight, positive, count = total
                f, cut, gain = best_splits(weight[None], positive[None], count[None], min_leaf)
                left = total[:, f[0], : cut[0] + 1].sum(1)
                whole = total[:, 0].sum(1)
                out = [float(f[0]), float(cut[0]), float(gain[0]), *left.tolist(), *whole.tolist()]
                return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "split": pa.array([out], pa.list_(pa.float64()))})

            sums = rows.select("row", "y", "w", "x").mapInArrow(add, "tree int, node int, part int, sums binary")
            found = sums.groupBy("tree", "node").applyInArrow(choose, "tree int, node int, split array<double>").collect()
            open_nodes = set()
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                tree, node = r["tree"], r["node"]
                f, cut, gain, _, _, left_n, whole_w, whole_p, whole_n = r["split"]
                top, depth = tops[tree], depths[tree][node]
                top["value"][node] = whole_p / whole_w if whole_w else 0.0
                if whole_n <= BLOCK and not node:
                    continue  # the bootstrap of a tree may be small enough as it is
                if gain <= 0 or depth >= self.max_depth:
                    depths[tree][node] = -1
                    continue
                feature = int(features[tree, node][int(f)])
                gains[tree, feature] += gain
                first = len(top["feature"])
                top["feature"][node], top["cut"][node], top["left"][node] = feature, int(cut), first
                tops[tree] = {k: np.append(v, leaf()[k].repeat(2)) for k, v in top.items()}
                depths[tree] = np.append(depths[tree], [depth + 1] * 2)
                open_nodes |= {(tree, n) for n, size in ((first, left_n), (first + 1, whole_n - left_n)) if size > BLOCK}
        return tops, depths, gains


class ForestModel:
    """A fitted forest: the grown parts as a table, the nodes above them and the ends of the bins."""

    def __init__(self, columns: list[str], trees: int, cuts: list[np.ndarray], tops: list[dict], gains: np.ndarray, parts: DataFrame):
        self.columns, self.trees, self.cuts, self.tops, self.gains, self.parts = columns, trees, cuts, tops, gains, parts

    def importances(self) -> np.ndarray:
        """Gain per feature, normalised per tree and over all trees."""
        each = self.parts.select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.array_sort(F.collect_list("g")).alias("g")).collect()
        gains = self.gains.copy()
        for r in each:
            gains[r["tree"], r["f"]] += sum(r["g"])
        return normalised(gains)

    def score(self, frame: DataFrame) -> DataFrame:
        """The rows with ``score``, the mean share of label 1 in the leaves of a row, and ``prediction``."""
        names = frame.columns
        rows = materialize(frame.withColumn("__row", F.monotonically_increasing_id()), "to-score")
        n, held = rows.count(), self.parts.agg(F.coalesce(F.sum(F.length("nodes")), F.lit(0))).first()[0]
        blocks, chunks = max(1, min(SCORE_BLOCKS, n >> 13), -(-n // SCORE_ROWS)), max(SCORE_CHUNKS, -(-held // CHUNK_BYTES))
        cuts, tops, width = self.cuts, self.tops, len(self.columns)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1 << 14):
                    part = batch.slice(at, 1 << 14)
                    blob = part.column(0).to_numpy().tobytes() + binned(matrix(part.column(1)), cuts).tobytes()
                    yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int32()), "rows": pa.array([blob], pa.binary())})

        def add(key: tuple, table: pa.Table, parts: pa.Table) -> pa.Table:
            row, xb = [np.zeros(0, np.int64)], [np.zeros((0, width), np.uint8)]
            for m, blob in zip(table["n"].to_pylist(), table["rows"], strict=True):
                row.append(np.frombuffer(blob.as_buffer(), np.int64, m))
                xb.append(np.frombuffer(blob.as_buffer(), np.uint8, m * width, 8 * m).reshape(m, width))
            row, xb = np.concatenate(row), np.concatenate(xb)
            total, times = np.zeros(len(row), np.int64), np.zeros(len(row), np.int32)
            trees, nodes = parts["tree"].to_numpy(), parts["node"].to_numpy()
            for tree, places in by_place(trees) if len(row) else []:
                top = route(tops[tree], xb)
                for i in places.tolist():
                    own = np.flatnonzero(top == nodes[i])
                    grown = unpacked(parts["nodes"][i].as_buffer())
                    value = np.rint(grown["value"] * ONE).astype(np.int64)
                    total[own] += value[route(grown, xb if len(own) == len(xb) else xb[own])]
                    times[own] += 1
            return pa.table({"__row": pa.array(row), "value": pa.array(total), "times": pa.array(times)})

        # Blocks of rows meet chunks of the forest: a row moves once per chunk and not once per tree.
        to = max(GROUPS, blocks * chunks)
        x = F.array(*[F.col(c).cast("double") for c in self.columns])
        dealt = rows.select("__row", x.alias("x")).mapInArrow(pack, "n int, rows binary")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rows"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        parts = self.parts.select("tree", "node", "nodes", F.pmod(F.xxhash64("tree", "node"), F.lit(chunks)).cast("int").alias("chunk"))
        parts = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        dealt, parts = (t.repartition(to, "block", "chunk").groupBy("block", "chunk") for t in (dealt, parts))
        found = dealt.cogroup(parts).applyInArrow(add, "__row long, value long, times int")
        sums = found.groupBy("__row").agg((F.sum("value") / F.sum("times") / F.lit(float(ONE))).alias("score"))
        out = rows.join(sums, "__row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return out.withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)).select(*names, "score", "prediction")

    def save(self, path: str) -> None:
        self.parts.write.mode("overwrite").parquet(f"{path}/parts")
        tops = [{k: v.tolist() for k, v in top.items()} for top in self.tops]
        head = json.dumps({"columns": self.columns, "trees": self.trees, "cuts": [c.tolist() for c in self.cuts], "tops": tops, "gains": self.gains.tolist()})
        self.parts.sparkSession.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
        tops = [{k: np.array(v) for k, v in top.items()} for top in head["tops"]]
        return ForestModel(head["columns"], head["trees"], [np.array(c) for c in head["cuts"]], tops, np.array(head["gains"]), spark.read.parquet(f"{path}/parts"))


# ---- forests of folds, feature sets and groups ---------------------------------------------------

JOINT = "place int, fold int, model string, row long, label double, value long, trees int, gains array<double>"


def _numbered_by_fit(data: DataFrame, columns: Sequence[str], folds: int) -> DataFrame:
    """The written rows with their numbers in the fit of all rows of their place and in those without each fold, as ``numbered`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            place, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = np.zeros((len(place), folds + 1), np.int64)
            for p, at in by_place(place):
                taken = np.hstack([np.ones((len(at), 1), bool), fold[at][:, None] != np.arange(folds)]).cumsum(0) + seen.get(p, 0)
                rows[at], seen[p] = first + taken - 1, taken[-1]
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, folds + 1, dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["place", "fold", "y", "w", "x", "rows"])

    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    rows = data.select("place", "fold", F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), x)
    return materialize(rows.mapInArrow(run, "place int, fold int, y double, w double, x array<double>, rows array<long>"), "tree-rows")


def _cuts_by_fit(rows: DataFrame, width: int, without: Sequence[int]) -> dict[tuple[int, int], list[np.ndarray]]:
    """``cut_points`` of every place and held-out fold (-1: none), from the rows outside the fold."""
    long = rows.select("place", "fold", F.posexplode("x").alias("f", "v"))
    values = materialize(long.groupBy("place", "f", "v").agg(F.collect_set("fold").alias("folds")), "tree-values")
    each = values.withColumn("out", F.explode(F.array(*[F.lit(f) for f in without])))
    each = each.where((F.size("folds") > 1) | (F.element_at("folds", 1) != F.col("out"))).select("place", "out", "f", "v")
    sizes = each.groupBy("place", "out", "f").agg(F.count(F.lit(1)).alias("n"))
    few = each.join(F.broadcast(sizes.where(F.col("n") <= BINS)), ["place", "out", "f"], "left_semi")
    many = F.broadcast(sizes.where(F.col("n") > BINS).drop("n"))
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    rows_of = long.join(many, ["place", "f"]).where(F.col("fold") != F.col("out"))
    cuts: dict[tuple[int, int], list[np.ndarray]] = {}
    ends: dict[tuple[int, int, int], list[float]] = {}
    for r in few.collect():
        ends.setdefault((r["place"], r["out"], r["f"]), []).append(r["v"])
    quantiles = rows_of.groupBy("place", "out", "f").agg(F.percentile_approx("v", at, 10_000).alias("q")).collect()
    for (place, out, f), found in ends.items():
        found = np.sort(found)
        cuts.setdefault((place, out), [np.zeros(0) for _ in range(width)])[f] = (found[1:] + found[:-1]) / 2
    for r in quantiles:
        cuts.setdefault((r["place"], r["out"]), [np.zeros(0) for _ in range(width)])[r["f"]] = np.unique(r["q"])
    drop_table(values)
    return cuts


def joint_forests(data: DataFrame, models: dict[str, Forest], without: Sequence[int], folds: int) -> DataFrame:
    """Every forest on the rows of each place outside each fold of ``without`` (-1: on all rows), grown in one job.

    ``data``: place and fold (int), label, weight and the features, in a repeating order; a fit has ``BLOCK`` rows at most.
    Gives, per chunk of trees, the summed leaf values of the rows held out, and the gains of each tree grown on all rows.
    """
    columns = sorted({c for m in models.values() for c in m.columns})
    width, at_of = len(columns), {c: i for i, c in enumerate(columns)}
    rows = _numbered_by_fit(data, columns, folds)
    cuts = _cuts_by_fit(rows, width, without)
    chunks = [(name, first) for name, m in models.items() for first in range(0, m.trees, CHUNK)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, fold, y, w = (batch.column(i).to_numpy() for i in range(4))
            x, number = matrix(batch.column(4)), matrix(batch.column(5))
            for p, at in by_place(place):
                for out in without:
                    held = fold[at] == out
                    own = np.where(held, number[at, 0], number[at, out + 1]).astype(np.int64)
                    xb = binned(x[at], cuts.get((p, out), [np.zeros(0)] * width))
                    blob = own.tobytes() + w[at].tobytes() + y[at].astype(np.uint8).tobytes() + held.astype(np.uint8).tobytes() + xb.tobytes()
                    yield pa.RecordBatch.from_pydict({
                        "place": pa.array([p], pa.int32()), "fold": pa.array([out], pa.int32()), "n": pa.array([len(at)], pa.int32()),
                        "at": pa.array([int(number[at[0], 0])], pa.int64()), "rows": pa.array([blob], pa.binary()),
                    })

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        place, out, chunk = (k.as_py() for k in key)
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for r in table.select(["n", "rows"]).take(pc.sort_indices(table, [("at", "ascending")])).to_pylist():
            n, blob = r["n"], r["rows"]
            parts[0].append(np.frombuffer(blob, np.int64, n))
            parts[1].append(np.frombuffer(blob, np.float64, n, 8 * n))
            parts[2].append(np.frombuffer(blob, np.uint8, n, 16 * n))
            parts[3].append(np.frombuffer(blob, np.uint8, n, 17 * n))
            parts[4].append(np.frombuffer(blob, np.uint8, n * width, 18 * n).reshape(n, width))
        number, w, y, held, xb = (np.concatenate(v) for v in parts)
        name, first = chunks[chunk]
        model = models[name]
        xb = xb[:, [at_of[c] for c in model.columns]]
        train, test = np.flatnonzero(held == 0), np.flatnonzero(held)
        w = w if model.weighted else np.ones(len(w))
        value, trees, gains = np.zeros(len(test), np.int64), 0, []
        for tree in range(first, min(first + CHUNK, model.trees)):
            c = draws(model.seed, tree, number[train])
            own, c = train[c > 0], c[c > 0].astype(np.uint8).astype(float)
            if len(own):
                rng = np.random.default_rng([model.seed, tree, 0, 1])
                nodes, found = grow(xb[own], y[own].astype(float), w[own], c, rng, model.few, model.max_depth, model.min_leaf)
                value += np.rint(nodes["value"][route(nodes, xb[test])] * ONE).astype(np.int64)
                trees += 1
                gains.append((tree, found.tolist()))
        if out >= 0:
            row, label, value, count, lists = number[test], y[test].astype(float), value, np.full(len(test), trees), [None] * len(test)
        else:
            row, lists = [t for t, _ in gains], [g for _, g in gains]
            label, value, count = np.zeros(len(row)), np.zeros(len(row), np.int64), np.ones(len(row))
        return pa.table({
            "place": pa.array([place] * len(row), pa.int32()), "fold": pa.array([out] * len(row), pa.int32()), "model": pa.array([name] * len(row), pa.string()),
            "row": pa.array(row, pa.int64()), "label": pa.array(label), "value": pa.array(value), "trees": pa.array(count, pa.int32()),
            "gains": pa.array(lists, pa.list_(pa.float64())),
        })

    dealt = rows.select("place", "fold", "y", "w", "x", "rows").mapInArrow(deal, "place int, fold int, n int, at long, rows binary")
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))))
    parts = min(4 * GROUPS, len(chunks) * max(len(cuts), 1))
    grown = materialize(dealt.repartition(parts, "place", "fold", "chunk").groupBy("place", "fold", "chunk").applyInArrow(fit, JOINT), "forests")
    drop_table(rows)
    return grown


def joint_scores(grown: DataFrame) -> DataFrame:
    """place, model, fold, label, score, prediction of every held-out row."""
    sums = grown.where(F.col("fold") >= 0).groupBy("place", "model", "fold", "row", "label").agg(
        F.coalesce(F.sum("value") / F.nullif(F.sum("trees"), F.lit(0)) / F.lit(float(ONE)), F.lit(0.0)).alias("score")
    )
    return sums.select("place", "model", "fold", "label", "score", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0).alias("prediction"))


def joint_importances(grown: DataFrame) -> dict[tuple[int, str], np.ndarray]:
    """Importances of the forests on all rows, by place and model; a row per tree reaches the driver."""
    found: dict[tuple[int, str], list] = {}
    for r in grown.where(F.col("fold") < 0).select("place", "model", "row", "gains").collect():
        found.setdefault((r["place"], r["model"]), []).append((r["row"], r["gains"]))
    return {key: normalised(np.array([g for _, g in sorted(each)])) for key, each in found.items()}


def normalised(gains: np.ndarray) -> np.ndarray:
    """Gain per feature, normalised per tree and over all trees."""
    per_tree = gains.sum(1, keepdims=True)
    total = np.divide(gains, per_tree, out=np.zeros_like(gains), where=per_tree > 0).sum(0)
    return total / total.sum() if total.sum() else total


# ---- boosted trees -------------------------------------------------------------------------------

ROUNDS_KEPT = 10  # rounds whose trees a pass applies before margins are written


class Boosting:
    """Boosted regression trees on the logistic loss, as MLlib's: the first tree fits the labels at full weight, the others the gradient."""

    def __init__(self, columns: Sequence[str], rounds: int = 200, rate: float = 0.05, depth: int = 4, subsample: float = 1.0, seed: int = 42):
        self.columns, self.rounds, self.rate, self.depth, self.subsample, self.seed = list(columns), rounds, rate, depth, subsample, seed


def boosted_folds(data: DataFrame, models: dict[str, Boosting], folds: int) -> DataFrame:
    """model, fold, label, score, prediction of every row by each model that was fitted without its fold.

    ``data``: fold, label and the features, in a repeating order. A pass over the rows gives the sums of one level of the
    trees of all folds; the driver chooses the splits from sums whose number depends on models and features only.
    """
    parts = [_boosted(data, name, model, folds) for name, model in models.items()]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored


def _regression_split(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node (sums by feature and bin): feature, last bin of the left side, gain, and the means of both sides."""
    n, s = count.cumsum(2), total.cumsum(2)
    whole_n, whole_s = n[:, :, -1:], s[:, :, -1:]

    def part(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.divide(s * s, n, out=np.zeros_like(s), where=n > 0)

    gain = part(s, n) + part(whole_s - s, whole_n - n) - part(whole_s, whole_n)
    gain[(n < 1) | (whole_n - n < 1) | (gain <= 1e-12 * np.maximum(whole_n, 1))] = 0
    flat, every = gain.reshape(len(gain), -1), np.arange(len(gain))
    best = flat.argmax(1)
    f, cut = best // BINS, best % BINS
    ln, ls, wn, ws = n[every, f, cut], s[every, f, cut], whole_n[every, f, 0], whole_s[every, f, 0]
    return f, cut, flat[every, best], ls / np.maximum(ln, 1), (ws - ls) / np.maximum(wn - ln, 1), ws / np.maximum(wn, 1)


def _boosted(data: DataFrame, name: str, model: Boosting, folds: int) -> DataFrame:
    width, rate, depth, share, seed = len(model.columns), model.rate, model.depth, model.subsample, model.seed
    rows = numbered(data.withColumn("y", 2 * F.col("label").cast("double") - 1), model.columns, "fold", "y")
    cuts = [cut_points(rows.where(F.col("fold") != f), width) for f in range(folds)]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3))
            xb = np.hstack([binned(x, c) for c in cuts]) if len(x) else np.zeros((0, folds * width), np.uint8)
            margins = pa.ListArray.from_arrays(np.arange(0, len(x) * folds + 1, folds, dtype=np.int32), pa.array(np.zeros(len(x) * folds)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in xb], pa.binary()), margins], names=["row", "fold", "y", "xb", "margins"])

    schema = "row long, fold int, y double, xb binary, margins array<double>"
    state = materialize(rows.select("row", "fold", "y", "x").mapInArrow(start, schema), "boosting")
    drop_table(rows)

    def bins_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, folds, width)

    def raised(batch: pa.RecordBatch, xb: np.ndarray, kept: list[tuple[float, list[dict]]]) -> np.ndarray:
        margins = matrix(batch.column(4)).copy()
        for by, trees in kept:
            for f, tree in enumerate(trees):
                margins[:, f] += by * tree["value"][route(tree, xb[:, f])]
        return margins

    kept: list[tuple[float, list[dict]]] = []
    for turn in range(model.rounds):
        trees, asked = [leaf() for _ in range(folds)], {f: np.zeros(1, np.int64) for f in range(folds)}
        for level in range(depth):
            if not asked:
                break

            def add(batches: Iterator[pa.RecordBatch], kept: list = kept, trees: list = trees, asked: dict = asked, turn: int = turn) -> Iterator[pa.RecordBatch]:
                sums = {f: np.zeros((2, len(nodes), width, BINS)) for f, nodes in asked.items()}
                places = {f: np.full(len(trees[f]["feature"]), -1) for f in asked}
                for f, nodes in asked.items():
                    places[f][nodes] = np.arange(len(nodes))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    row, fold, y, xb = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), bins_of(batch)
                    margins = raised(batch, xb, kept)
                    drawn = uniform(seed, turn, row) < share if share < 1 else np.ones(len(row), bool)
                    for f, nodes in asked.items():
                        node = places[f][route(trees[f], xb[:, f])]
                        own = np.flatnonzero((fold != f) & drawn & (node >= 0))
                        residual = 4 * y[own] / (1 + np.exp(np.clip(2 * y[own] * margins[own, f], -500, 500))) if turn else y[own]
                        features = np.tile(np.arange(width), (len(nodes), 1))
                        sums[f] += np.stack(histograms(xb[own, f], node[own], features, [np.ones(len(own)), residual]))
                for f, v in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "f", "sums"])

            found = state.mapInArrow(add, "part int, f int, sums binary").toArrow().sort_by([("f", "ascending"), ("part", "ascending")])
            total = {f: np.zeros((2, len(nodes), width, BINS)) for f, nodes in asked.items()}
            for f, blob in zip(found["f"].to_pylist(), found["sums"], strict=True):
                total[f] += np.frombuffer(blob.as_buffer()).reshape(total[f].shape)
            for f, nodes in list(asked.items()):
                feature, cut, gain, below, above, whole = _regression_split(*total[f])
                tree, good = trees[f], np.flatnonzero(gain > 0)
                if not level:
                    tree["value"][0] = whole[0]
                first, more = len(tree["feature"]), 2 * len(good)
                tree["feature"][nodes[good]], tree["cut"][nodes[good]], tree["left"][nodes[good]] = feature[good], cut[good], first + 2 * np.arange(len(good))
                tree = trees[f] = {k: np.append(v, leaf()[k].repeat(more)) for k, v in tree.items()}
                tree["value"][first::2], tree["value"][first + 1 :: 2] = below[good], above[good]
                asked[f] = np.arange(first, first + more)
                if not more:
                    del asked[f]
        kept.append((1.0 if not turn else rate, trees))
        if len(kept) == ROUNDS_KEPT or turn == model.rounds - 1:

            def write(batches: Iterator[pa.RecordBatch], kept: list = kept) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margins = raised(batch, bins_of(batch), kept) if batch.num_rows else np.zeros((0, folds))
                    lists = pa.ListArray.from_arrays(np.arange(0, margins.size + 1, folds, dtype=np.int32), pa.array(margins.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["row", "fold", "y", "xb", "margins"])

            before, state, kept = state, materialize(state.mapInArrow(write, schema), "boosting"), []
            drop_table(before)
    margin = F.col("margins")[F.col("fold")]
    return state.select(
        F.lit(name).alias("model"), "fold", ((F.col("y") + 1) / 2).alias("label"), (1 / (1 + F.exp(-2 * margin))).alias("score"),
        F.when(margin > 0, 1.0).otherwise(0.0).alias("prediction"),
    )
