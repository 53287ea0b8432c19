"""Connected components of an edge table by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import drop_table, materialize


SALTS = 16  # parts of the edges of one hub


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours its smallest neighbour, or itself. ``edges`` have a > b.

    A hub is the smaller end of many edges: they are dealt out in SALTS parts, and its one row is repeated for each.
    """
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    return dealt.join(least, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours point at the smallest of them. ``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """vertex, label: the smallest vertex of its component, for vertices that are not that one themselves.

    ``edges``: a, b (long, neither null), any direction, repeats and loops allowed; no edges give no rows.
    Each round is written to the shared folder and the round before deleted; the end is seen by a count
    and a checksum of the edges. Hubs are joined in parts, never grouped into one row.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    seen = _fingerprint(now)
    while True:
        nxt = materialize(_small_star(_large_star(now)), "edges")
        drop_table(now)
        now, before, seen = nxt, seen, _fingerprint(nxt)
        if seen == before:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
