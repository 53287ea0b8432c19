"""Exact dedup as a tree merge of sorted digest runs.

Texts are equal when they are identical after each run of white space became one space. Every leaf of
the tree (a hash class of doc_id) makes one run: a row per digest, sorted by digest, with the smallest
identifier and the number of rows. In round r each group of ``fan`` nodes (pairs by default: binomial
rounds) whose numbers differ in digit r exchanges runs: a node keeps the digests whose own digit r is its
own, and merges the sorted runs that meet there. Every level is written as sorted runs and its group sizes
must add up to the number of documents before the next one begins, so a lost executor costs a level at
most. After the last round a node owns 1/leaves of the digests, fully merged: no round gathers all runs in
one place. The answer returns the way the runs came: one row per (leaf, digest), then to the documents of
that leaf, so a text with a third of all rows is spread over all leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import SPACE, drop_table, materialize, text_or_empty, whole_row, written

# What has to agree before two rows count as one text: SHA-256, byte length and an independent XXH64.
LAST_ID = (1 << 63) - 1  # stands for a missing doc_id where rows are joined
DIGEST = ["text_sha256", "_bytes", "_check"]
RUN = "_node int, text_sha256 string, _bytes long, _check long, keep_id long, group_size long"
RUN_ROWS = 1 << 16  # documents a leaf stands for; at most 2 ** ROUNDS leaves, which bounds the number of runs
ROUNDS = 12


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digest_rows(texts: DataFrame) -> DataFrame:
    """doc_id and the digest of its whole normalised text ``_text``."""
    return texts.select(
        "doc_id",
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_text").cast("long").alias("_bytes"),
        F.xxhash64("_text").alias("_check"),
    )


def _merge_equal(rows: pa.Table) -> pa.Table:
    """One row per (node, digest) of sorted rows: smallest identifier, sum of the sizes. All parts of a digest must agree."""
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = False
    for name in ("_node", *DIGEST):
        values = rows[name].combine_chunks()
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    there = rows["keep_id"].is_valid().to_numpy()
    smallest = np.minimum.reduceat(rows["keep_id"].fill_null(LAST_ID).to_numpy(), starts)
    keep = pa.array(smallest, mask=~np.logical_or.reduceat(there, starts))
    sizes = pa.array(np.add.reduceat(rows["group_size"].to_numpy(), starts))
    first = rows.take(pa.array(starts))
    return pa.table([*[first[name] for name in ("_node", *DIGEST)], keep, sizes], names=rows.column_names)


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a sorted stream; only the last row of a batch waits for the next one."""
    waiting = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.table(batch.columns, names=batch.schema.names)  # plain fields: whether one may be null differs by level
        merged = _merge_equal(rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks())
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
        waiting = merged.slice(merged.num_rows - 1)
    if waiting is not None:
        yield from waiting.to_batches()


def _level(runs: DataFrame, nodes: int, documents: int, name: str) -> DataFrame:
    """Writes merged runs, sorted by digest within each node, and verifies that no document is lost or doubled."""
    met = runs.repartition(nodes, "_node").sortWithinPartitions("_node", *DIGEST)
    level = written(met.mapInArrow(merge_sorted, RUN), name)
    counted = level.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    if counted != documents:
        raise RuntimeError(f"{name} holds {counted} documents instead of {documents}")
    return level


def merge_tree(runs: DataFrame, leaves: int, fan: int, documents: int) -> DataFrame:
    """The merged runs of the last round: one row per digest with keep_id and group_size.

    ``runs``: a written level of leaves (see RUN). Each round moves a row at most once and writes a level;
    the level before it is deleted, but for the first, which the answer reads again.
    """
    home = F.pmod("_check", F.lit(leaves)).cast("int")
    span, level = 1, runs
    while span < leaves:
        # digit r of the node number becomes digit r of the digest's home
        own, goal = (F.floor(x / span) % fan for x in (F.col("_node"), home))
        moved = level.withColumn("_node", (F.col("_node") + (goal - own) * span).cast("int"))
        merged = _level(moved, leaves, documents, f"runs-{span}")
        if level is not runs:
            drop_table(level)
        level, span = merged, span * fan
    return level


def _rounds(documents: int, fan: int) -> int:
    """Rounds that give every leaf about RUN_ROWS documents, within bounds; the result does not depend on them."""
    leaves = min(max(documents // RUN_ROWS, 8), 2**ROUNDS)
    return max(1, round(np.log(leaves) / np.log(fan)))


def exact_groups(docs: DataFrame, rounds: int | None = None, fan: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text).

    Null text counts as empty. Of equal texts the smallest doc_id stays; a null doc_id stays only where
    its group has no other. Rows that share both doc_id and text are one document given several times:
    they stay or go together, and group_size counts each. An empty table gives no rows.
    """
    text = docs.select("doc_id", normalised(text_or_empty()).alias("_text"))
    rows = materialize(digest_rows(text), "digests")
    documents = rows.count()
    rounds = _rounds(documents, fan) if rounds is None else rounds
    leaves = fan**rounds
    rows = rows.withColumn("_leaf", F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).cast("int"))
    # Equal texts of a leaf meet in the partitions first, so a text with a third of all rows moves as few rows.
    combined = rows.groupBy(F.col("_leaf").alias("_node"), *DIGEST).agg(
        F.min(F.col("doc_id").cast("long")).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    runs = _level(combined, leaves, documents, "runs-0")
    merged = merge_tree(runs, leaves, fan, documents).drop("_node")
    back = runs.select(F.col("_node").alias("_leaf"), *DIGEST).join(merged, DIGEST)
    keep = F.col("keep_id").cast(docs.schema["doc_id"].dataType)
    return rows.join(back, ["_leaf", *DIGEST]).select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, rounds: int | None = None, fan: int = 2) -> DataFrame:
    """The documents that stay, all their columns. Rows that share both doc_id and text leave one of them."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    kept = exact_groups(docs, rounds, fan).where("kept").select(ids.alias("_id"), F.col("text_sha256").alias("_sha"))
    whole = docs.select(whole_row(docs), ids.alias("_id"), F.sha2(normalised(text_or_empty()).cast("binary"), 256).alias("_sha"))
    return whole.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
