"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into four segments of 16 bits on a ring. If two fingerprints differ in at most
three bits, then from some segment on every chain of consecutive segments keeps to its proportional
share of the budget: 0 bits in the first, at most 1 in the first two, 2 in the first three, 3 in all.
The first two conditions are the join key (one segment as it is, the next with one of its bits masked:
64 keys per fingerprint); within a key the chain prunes pairs before the whole distance is taken.

Fingerprints that share a key are searched breadth first and leave one edge per member, never their
pairs; a task joins what its keys linked into one forest, and the forests are merged as components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import materialize
from usagekit.llm.components import connected

SHINGLE, SEED = 3, 42
# The key and chain conditions hold for these values only.
BITS, SEGMENTS, DISTANCE = 64, 4, 3
NO_ID = 1 << 62  # stand-in ids of fingerprints that only rows without doc_id have


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (signed) of a text: lower-cased ASCII, words between ASCII white space, word shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    parts = [b" ".join(w) for w in zip(*[words[i:] for i in range(shingle)], strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    counts, size = np.zeros(BITS, np.int64), 65_536
    for i in range(0, len(parts), size):  # a long text is counted in blocks
        hashes = np.array([digest(p, SEED) for p in parts[i : i + size]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every row of ``docs`` (doc_id, text); null and empty texts: 0."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, fp long")


def _keys(prints: DataFrame) -> DataFrame:
    """key, turned, id: 64 rows per fingerprint; turned is the fingerprint with the key's first segment lowest."""
    rows = prints.select("fp", "id", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("j"))
    rows = rows.withColumn("turned", F.expr("shiftrightunsigned(fp, (j div 16) * 16) | shiftleft(fp, 64 - (j div 16) * 16)").cast("long"))
    return rows.select(F.expr("(turned & 4294967295L & ~shiftleft(1L, 16 + j % 16)) | shiftleft(cast(j AS long), 32)").alias("key"), "turned", "id")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints that share a key keep to the chain's third and fourth budget."""
    diff = a ^ b
    short = np.bitwise_count(diff & np.uint64(0xFFFFFFFFFFFF)) <= 2
    short[short] = np.bitwise_count(diff[short]) <= DISTANCE
    return short


class Forest:
    """Union-find over ids; the root is the smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> pa.RecordBatch:
        """a, b: every id that is no root, and its root."""
        a = np.fromiter(self.up, np.int64, len(self.up))
        b = np.fromiter((self.root(x) for x in list(self.up)), np.int64, len(self.up))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _link_group(prints: np.ndarray, ids: np.ndarray, forest: Forest) -> None:
    """Breadth-first search among the fingerprints of one key; blocks of the front against what is not reached."""
    rest = np.arange(len(prints))
    while len(rest) > 1:
        start, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                left = np.flatnonzero(~reached)
                if not len(left):
                    break
                a, b = np.broadcast_arrays(prints[front[i : i + 64], None], prints[rest[left]][None, :])
                reached[left[linked(a, b).any(0)]] = True
            for x in ids[rest[reached]].tolist():
                forest.join(int(ids[start]), x)
            front, rest = rest[reached], rest[~reached]


def _link_runs(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, forest: Forest) -> None:
    """All groups of equal keys of a sorted stretch: pairs at once, larger groups one by one."""
    if not len(keys):
        return
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    hit = two[linked(prints[two], prints[two + 1])]
    pairs = np.unique(np.stack([ids[hit], ids[hit + 1]], 1), axis=0)
    for x, y in pairs.tolist():
        forest.join(x, y)
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        _link_group(prints[at : at + n], ids[at : at + n], forest)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, held = Forest(), [np.zeros(0, np.int64)] * 3
    for batch in batches:
        columns = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        last = np.searchsorted(columns[0], columns[0][-1]) if len(columns[0]) else 0  # the last key may go on
        _link_runs(columns[0][:last], columns[1][:last].view(np.uint64), columns[2][:last], forest)
        held = [c[last:] for c in columns]
    _link_runs(held[0], held[1].view(np.uint64), held[2], forest)
    edges = [(x, forest.root(x)) for x in list(forest.up)]
    for i in range(0, len(edges), 65_536):
        a, b = zip(*edges[i : i + 65_536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def simhash_links(prints: DataFrame) -> DataFrame:
    """a, b: edges that join the ids of ``prints`` (fp, id: one row per fingerprint) wherever fingerprints differ in at most 3 bits."""
    return _keys(prints).repartition("key").sortWithinPartitions("key", "turned").mapInArrow(_forest, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row of ``docs`` (doc_id, text).

    Fingerprints link where they differ in at most 3 bits; component_id is the smallest doc_id reachable,
    the row's own included. Null and empty texts have fingerprint 0 and link like any other. Rows without
    doc_id take part; a component of such rows alone has component_id null. doc_id lies below 2^62.
    Copies meet as one fingerprint before any search.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    # Without doc_id the upper 62 bits stand in: prints that share them differ in two bits at most, so they link anyway.
    stand_in = F.expr(f"{NO_ID}L + shiftrightunsigned(fp, 2)")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("id", F.coalesce("id", stand_in)), "prints")
    labels = connected(simhash_links(prints))
    named = prints.join(labels, prints["id"] == labels["vertex"], "left").select("fp", F.coalesce("label", "id").alias("_root"))
    named = named.select("fp", F.when(F.col("_root") < NO_ID, F.col("_root")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest doc_id of each group, all its columns; documents without doc_id stay."""
    kept = simhash_groups(docs, shingle).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_keep"], "left_semi").unionByName(docs.where("doc_id IS NULL"))
