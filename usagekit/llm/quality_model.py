"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken of every whole text in one pass and written; the trees are fitted on a bounded
sample of labelled rows and flattened into arrays (feature, threshold, leaf value of complete trees), so
that a batch of rows walks all trees level by level with numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import materialize

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "log_words", "log_bytes", "mean_length", "deviation", "log_longest", "short_words", "distinct_words", "top_word", "second_word", "same_as_before",
    "distinct_pairs", "upper", "digits", "symbols", "stops", "exclaims", "other_marks", "beyond_ascii", "white", "breaks", "distinct_lines", "entropy",
    "words_per_stop", "capital_words", "shouted_words",
)
SAMPLE = 40_000  # labelled rows the trees are fitted on, about; more are thinned by a hash of doc_id
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 120, 4, 64, 0.12, 1.0, 8.0
THRESHOLD, FOLDS = 0.3, 5


def statistics(text: str) -> list[float]:
    """FEATURES of one text; all 0 for an empty one."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    times = Counter(words)
    top = [c for _, c in times.most_common(2)] + [0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = count[count > 0] / size
    upper, symbols = count[65:91].sum(), sum(int(count[c]) for c in SYMBOLS)
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(), len(times) / n, top[0] / n, top[1] / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / n, upper / size, count[48:58].sum() / size, symbols / size,
        count[46] / size, count[33] / size, (count[34] + count[39:42].sum() + count[44:46].sum() + count[58:60].sum()) / size, count[128:].sum() / size,
        (count[9:14].sum() + count[32]) / size, count[10] / size, len(set(lines)) / len(lines), float(-(share * np.log(share)).sum()), n / (1 + count[46]),
        sum(65 <= w[0] <= 90 for w in words) / n, sum(map(bytes.isupper, words)) / n,
    ]


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node i has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # to the right where the value is above it
    value: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosts logistic loss; splits maximise the gain over histograms of at most BINS quantile bins.

    Without rows the score is 0.5; with one class it is that class's share with one row of either added.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(np.unique(labels)) < 2:
        trees = 0
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])] if trees else []
    bins = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], 1) if trees else rows
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(len(rows), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                cell = local * (len(cuts) + 1) + bins[:, f]
                g, h = (np.bincount(cell, w, width * (len(cuts) + 1)).reshape(width, -1) for w in (slope, curve))
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST / 4) | (ha - hl < LEAST / 4)] = 0
                cut = gain.argmax(1)
                gain = gain[np.arange(width), cut]
                for k in np.flatnonzero(gain > best):
                    best[k], feature[t, first + k], threshold[t, first + k] = gain[k], f, cuts[cut[k]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + RIDGE)
        total += value[t][leaf]
    return Trees(base, feature, threshold, value)


def held_out() -> Column:
    """Whether CRC32 of doc_id as text is divisible by 5; a null doc_id counts as the empty text and is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of FEATURES) for every row of ``docs`` (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t.as_py() or "") for t in batch.column(1)], np.float32).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, len(FEATURES), dtype=np.int32), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, stats array<float>")


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on labelled rows that are not held out: about ``sample`` at most, chosen by a hash of doc_id.

    ``labels``: doc_id, quality (0 or 1). A null quality is no label; a document labelled twice counts twice.
    What comes to the driver is bounded by ``sample`` rows of statistics.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    marks = marks.where(~held_out())
    n, grain = max(marks.count(), 1), 1 << 20
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < max(1, grain * sample // n))
    rows = stats.join(marks, "doc_id").select("doc_id", "stats", "label").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return fit_trees(np.array(rows["stats"].combine_chunks().flatten(), np.float64).reshape(-1, len(FEATURES)), rows["label"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    score (0 to 1) rises with the likelihood of label 1 and depends on the text alone; null and empty texts share one
    score, and so do repeated texts. predicted is 1 from ``threshold`` on. Without labels every score is 0.5.
    """
    stats = materialize(document_statistics(docs), "statistics")
    trees = fit_quality(stats, labels, sample)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).flatten(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(rows))], names=["doc_id", "score"])

    scored = stats.mapInArrow(walk, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
