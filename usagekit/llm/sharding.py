"""Sharding by jump consistent hashing, in native expressions.

A key's shard comes from a chain of pseudo-random jumps (a 64-bit linear congruential generator seeded
with the key): the last jump below the shard count is the shard. There is no ring table, and with one
more shard a key either stays or goes to the new one. The law is ``key``: nothing but doc_id and the
shard count decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import materialize, number_rows, text_or_empty

# The generator's multiplier 2862933555777941757 as its upper and lower 32 bits.
MUL_HIGH, MUL_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF
BLOCK = 32


def _times(a: Column, b: int) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a * b (both below 2^32), without leaving signed 64 bits."""
    low = a * F.lit(b & 0xFFFF)
    high = a * F.lit(b >> 16) + F.shiftright(low, 16)
    return F.shiftright(high, 16), F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state: state * multiplier + 1 modulo 2^64."""
    up, down = _times(low, MUL_LOW)
    cross = _times(high, MUL_LOW)[1] + _times(low, MUL_HIGH)[1]
    down = down + 1
    up = (up + cross + F.shiftright(down, 32)).bitwiseAND(F.lit(MASK))
    return up, down.bitwiseAND(F.lit(MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, 0 to shards - 1) of a 64-bit key; null key: shard 0.

    A chain has at most ``shards`` jumps and log(shards) on average. It is unrolled as nested folds over
    blocks of 32 steps that a finished chain passes untouched, so a large shard count stays cheap and exact.
    """
    count = F.lit(shards).cast("long")

    def step(s: Column, _: Column) -> Column:
        up, down = _next(s["high"], s["low"])
        reach = (s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(up, 1) + 1).cast("double"))
        moved = F.struct(up.alias("high"), down.alias("low"), s["next"].alias("at"), F.floor(reach).cast("long").alias("next"))
        return F.when(s["next"] < count, moved).otherwise(s)

    def loop(body, size: int):
        steps = F.sequence(F.lit(1), F.lit(size))
        return lambda s, _: F.when(s["next"] < count, F.aggregate(steps, s, body)).otherwise(s)

    body, reached = loop(step, min(shards, BLOCK)), min(shards, BLOCK)
    while reached < shards:
        body, reached = loop(body, BLOCK), reached * BLOCK
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"),
    )
    return F.coalesce(body(start, None)["at"], F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, cells: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text plus 1 (null text: 1). The key is XXH64 of doc_id (a null doc_id: shard
    0, which may then grow). Slots are gapless from 0 in each shard: rows are numbered inside one of
    ``cells`` hash cells of their shard, by doc_id, checksum and size, after the rows of the lower cells;
    at most shards x cells counts are broadcast. Repeated rows get slots of their own. Rerun, rows go to
    the same places, as every order is by value.
    """
    text = text_or_empty().cast("binary")
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"))
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        jump_hash(F.col("_key"), shards).alias("shard"), jump_hash(F.col("_key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(cells)).cast("int").alias("_cell"),
    )
    placed = number_rows(materialize(rows, "shards"), ["shard"], "_cell", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes ``docs`` as one folder per shard (column shard), all columns kept; no row order is implied."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    docs.withColumn("shard", jump_hash(key, shards)).write.mode("overwrite").partitionBy("shard").parquet(path)
