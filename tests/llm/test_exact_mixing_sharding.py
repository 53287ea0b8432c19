import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash
from frames import docs_frame
from pyspark.sql import functions as F

from usagekit.llm import exact_dedup, mixing, sharding


def texts(n, seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(n // 3)]
    return [re.sub(" ", rng.choice([" ", "  ", "\n\t"]), rng.choice(base)) for _ in range(n)] + ["hot\ntext"] * n


@pytest.mark.parametrize("rounds, fan", [(1, 2), (2, 3), (3, 4)])
def test_exact_groups_equal_brute_force(spark, rounds, fan):
    rows = texts(120)
    groups = defaultdict(list)
    for i, t in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact_dedup.exact_groups(docs_frame(spark, rows), rounds, fan).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    kept = exact_dedup.drop_exact_copies(docs_frame(spark, rows), rounds, fan).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in groups.values())


def test_levels_are_sorted_runs(spark):
    rows = [("%064x" % (i % 40), 1, i % 40, i if i % 7 else None, 1) for i in range(400)]
    frame = spark.createDataFrame([(i % 4, *r) for i, r in enumerate(rows)], exact_dedup.RUN)
    level = exact_dedup._level(frame, 4, 400, "test-runs")
    for path in level.inputFiles():
        own = [(r._node, r.text_sha256) for r in spark.read.parquet(path).collect()]
        assert own == sorted(set(own))  # each file is a run in order, one row per node and digest
    merged = exact_dedup.merge_tree(level, 4, 2, 400).collect()
    want = {d: (min((r[3] for r in rows if r[2] == d and r[3] is not None), default=None), 10) for d in range(40)}
    assert {r._check: (r.keep_id, r.group_size) for r in merged} == want and len(merged) == 40
    with pytest.raises(RuntimeError, match="401"):
        exact_dedup._level(level, 4, 401, "test-runs")


@pytest.mark.parametrize("cut", [1, 2, 7, 50])
def test_merge_of_a_sorted_stream_does_not_depend_on_batches(cut):
    keys = sorted(random.Random(cut).choices(range(12), k=50))
    table = pa.table({"_node": pa.array([0] * 50, pa.int32()), "text_sha256": [f"{k:03d}" for k in keys], "_bytes": [1] * 50, "_check": keys,
                      "keep_id": pa.array([None if i % 3 == 0 else 100 - i for i in range(50)], pa.int64()), "group_size": [2] * 50})
    table = table.cast(table.schema.set(5, pa.field("group_size", pa.int64(), nullable=False)))
    got = pa.Table.from_batches(list(exact_dedup.merge_sorted(iter(table.to_batches(max_chunksize=cut)))))
    for k, keep, size in zip(got["_check"].to_pylist(), got["keep_id"].to_pylist(), got["group_size"].to_pylist(), strict=True):
        own = [100 - i for i in range(50) if keys[i] == k and i % 3]
        assert (keep, size) == (min(own, default=None), 2 * keys.count(k))
    assert got["_check"].to_pylist() == sorted(set(keys))


def highest_quotients(votes, seats):
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * quota[k] + 1), k), default=None)
        if best is None:
            break
        quota[best] += 1
    return quota


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_equals_highest_quotients(spark, seed):
    rng = random.Random(seed)
    cases, rows = {}, []
    for g in range(12):
        votes = {p: rng.choice([0, 1, 2, 5, rng.randint(0, 1000), rng.randint(0, 10**6)]) for p in range(rng.randint(1, 12))}
        seats = rng.choice([0, 1, 2, 7, 50, 400])
        cases[g] = (votes, seats)
        rows += [(g, p, v, seats) for p, v in votes.items()]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, p int, v long, s long"), ["g"], "p", "v", "s").collect()
    for g, (votes, seats) in cases.items():
        assert {r.p: r.quota for r in got if r.g == g} == highest_quotients(votes, seats), (votes, seats)


def refill(sizes, weights, cap):
    total, goal, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(cap * sizes[i] for i in full)
        for i in range(len(sizes)):
            goal[i] = cap * sizes[i] if i in full else left * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if goal[i] > cap * sizes[i]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 5, 0, 30], [0, 0], [7], [5, 900, 2, 2, 2, 2, 800]])
def test_targets_equal_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "_source string, source_size long")
    got = [r.target for r in mixing.targets(frame).orderBy("_source").collect()]
    assert got == pytest.approx(refill(sizes, [1 + i % 3 for i in range(len(sizes))], 3), rel=1e-9, abs=1e-9)


def test_mix_is_near_targets_and_repeatable(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 40, 500])), rng.choice(["a", "a", "a", "b", None, "c"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert first.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert (first["taken"] <= 3 * first["size"]).all() and (first["taken"] >= 0).all()
    names = {i: s for i, _, s in rows}
    for _, part in first.groupby(first.doc_id.map(names).fillna("~")):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 32
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").count().toPandas()
    assert mixed["count"].max() <= 3


def jump(key, shards):
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 33, 1000, 40_000])
def test_jump_hash_equals_the_loop(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[rng.getrandbits(64) - 2**63 for _ in range(300)]]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
    assert [r.s for r in rows] == [jump(r.k % 2**64, shards) for r in rows]


def test_shards(spark):
    rows = texts(200)
    got = sharding.shard_documents(docs_frame(spark, rows)).collect()
    for r in got:
        data = rows[r.doc_id].encode()
        key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump(key, 8), jump(key, 9)) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_write_shards(spark, tmp_path):
    sharding.write_shards(docs_frame(spark, texts(50)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 - 50 + 50 and back.where("shard > 7").count() == 0
