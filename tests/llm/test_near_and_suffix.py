import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from frames import docs_frame

from usagekit.llm import simhash, suffix_dedup
from usagekit.llm.components import connected


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_fingerprints_and_components(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 2, 5, 80, 400]))] for _ in range(25)]
    texts = []
    for _ in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = f"W{rng.randrange(9)}é"
        texts.append(rng.choice([" ", "\n"]).join(words) or rng.choice([None, "", " "]))
    prints = [brute_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = union(len(texts), links)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs_frame(spark, texts)).collect()}
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in enumerate(prints))
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = simhash.drop_near_copies(docs_frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def groups_of(spark, prints):
    """Components of given fingerprints, through keys, forests and stars."""
    rows = spark.createDataFrame([(int(p) - (1 << 64 if p >> 63 else 0), i) for i, p in enumerate(prints)], "fp long, id long")
    edges = simhash._keys(rows).repartition("key").sortWithinPartitions("key", "turned").mapInArrow(simhash._forest, "a long, b long")
    return {r.vertex: r.label for r in connected(edges).collect()}


def test_no_link_is_lost_and_none_is_added(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(60):  # chains of neighbours one to five bits apart, and a dense ball
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.append(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    ball = rng.getrandbits(64)
    prints += [ball ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a + 1, 64, 5)]
    prints = list(dict.fromkeys(prints))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    got = groups_of(spark, prints)
    assert [got.get(i, i) for i in range(len(prints))] == union(len(prints), links)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    want = union(500, edges)
    got = {r.vertex: r.label for r in connected(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert [got.get(i, i) for i in range(500)] == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def passages(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh \né") for _ in range(rng.randint(100, 700))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            text += x[a : a + rng.choice([20, 90, 99, 100, 101, 102, 130, 180, 400])] + "".join(rng.choice("xyz") for _ in range(rng.choice([0, 0, 1, 50])))
        rows.append((i, text + rng.choice(["", "", "-" * 250, "ab" * 120])))
    return rows


@pytest.mark.parametrize("seed, batches, hot", [(1, 4, 20_000), (2, 1, 20_000), (3, 7, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, batches, hot):
    rows = passages(seed, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs, batches=batches, hot=hot).collect()
    want = brute_removal(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == want


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeated_rows_are_one_document(spark, hot):
    rows = passages(6, 60)
    docs = spark.createDataFrame(rows + rows[20:50] + rows[20:30], "doc_id long, text string").repartition(4)
    want = brute_removal(rows)
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert len(got) == 100 and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id] for r in got)


def test_texts_longer_than_a_block(spark):
    rng = random.Random(12)
    word = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long_text = " ".join(rng.choice(word) for _ in range(400_000))
    rows = [(0, long_text), (1, long_text[1_048_000:1_049_500]), (2, "x" + long_text[5:400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert len(long_text) > 2 * suffix_dedup.BLOCK
    assert got == {0: (len(long_text), 0, 0), 1: (1500, 1500, 1), 2: (396, 395, 1)}


def test_levels_merge_geometrically(spark):
    family = suffix_dedup.IndexFamily(spark)
    rows, sizes = passages(4, 60), []
    for i in range(6):
        part = spark.createDataFrame(rows[10 * i : 10 * i + 10], "doc_id long, text string")
        family.add(suffix_dedup.ordered(part))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    family.close()


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"abcd") for _ in range(6000))
    whole = {tuple(x) for x in zip(*(c.tolist() for c in suffix_dedup._anchors(list(suffix_dedup._parts(1, data)))), strict=True)}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    cut = [suffix_dedup._anchors([p]) for p in suffix_dedup._parts(1, data)]
    assert {tuple(x) for part in cut for x in zip(*(c.tolist() for c in part), strict=True)} == whole


def test_every_window_has_an_anchor():
    rng = random.Random(10)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"-" * 300
    pos = np.sort(suffix_dedup._anchors(list(suffix_dedup._parts(1, data)))[3])
    for i in range(len(data) - 99):
        assert ((pos >= i) & (pos + suffix_dedup.GRAM <= i + 100)).any()
