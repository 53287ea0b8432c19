import random

import numpy as np
from frames import docs_frame, edge_frame, empty_frame
from test_near_and_suffix import union

import corpus_pipeline
from usagekit.llm import shingle_join, simhash


def brute_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    return out


def brute_groups(texts):
    sets = brute_sets(texts)
    return union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])


def corpus(rng, hub=90):
    """Edited copies on both sides of the similarity, short and empty texts, one passage in most, one large group."""
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 4, 5, 30, 120, 400]))] for _ in range(40)]
    common = [f"c{i}" for i in range(30)]
    texts = []
    for _ in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            if words:
                words[rng.randrange(len(words))] = f"X{rng.randrange(10**6)}"
        texts.append(" ".join(words + common * (rng.random() < 0.3)))
    stem = [f"s{i}" for i in range(200)]
    for _ in range(hub):
        words = list(stem)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            words[rng.randrange(200)] = f"Y{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return [*texts, None, "", " "]


def test_groups_equal_brute_force_jaccard(spark):
    texts = corpus(random.Random(3))
    want = brute_groups(texts)
    got = {r.doc_id: r.component_id for r in shingle_join.shingle_groups(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = shingle_join.drop_near_copies(docs_frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_large_keys_lose_no_pair(spark):
    texts = corpus(random.Random(9), 30)
    got = {r.doc_id: r.component_id for r in shingle_join.shingle_groups(docs_frame(spark, texts), few=1).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_tiles_of_a_large_component_lose_no_pair(spark, monkeypatch):
    """One group of near copies in many tiles, and others in the same keys that it does not reach by star or chain."""
    monkeypatch.setattr(shingle_join, "TILE", 5)
    texts = corpus(random.Random(21), 120)
    for few in (1, 4):
        got = {r.doc_id: r.component_id for r in shingle_join.shingle_groups(docs_frame(spark, texts), few=few).collect()}
        assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_pairs_are_verified_in_tiles(spark, monkeypatch):
    """Listed pairs of a long chain, of a pair apart and of sets that are not alike: the roots take part, no other joins."""
    monkeypatch.setattr(shingle_join, "TILE", 3)
    stem = [f"s{i}" for i in range(120)]
    texts = [" ".join(stem[i:] + [f"t{j}" for j in range(i)]) for i in range(0, 60, 6)] + ["a b c d e f", "a b c d e f", "q r s t u v"]
    docs = docs_frame(spark, texts)
    rows = shingle_join.signatures(docs, 5).select("doc_id", "sig")
    sig = {r.doc_id: r.sig for r in rows.collect()}
    sets = brute_sets(texts)
    listed = [(i, j) for i in range(9) for j in range(i + 1, min(i + 4, 10))] + [(0, 12)]
    pairs = spark.createDataFrame([tuple(sorted((sig[i], sig[j]))) for i, j in listed], "a long, b long")
    found = shingle_join._verified(pairs, shingle_join.needed_sets(docs, rows, rows.select("sig"), 5)).collect()
    at = {s: i for i, s in sorted(sig.items(), reverse=True)}
    alike = [(i, j) for i, j in listed if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert 0 < len(alike) < len(listed)
    assert union(len(texts), [(at[r.a], at[r.b]) for r in found]) == union(len(texts), alike)


def test_frequent_shingles_are_bounded_and_move_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "FREQUENT", 3)
    texts = corpus(random.Random(4), 60)
    docs = docs_frame(spark, texts, 1)
    assert len(shingle_join._frequent(docs, 5, 3)[0]) <= 3 and len(shingle_join._frequent(docs, 5, 10**6)[0]) > 20
    got = {r.doc_id: r.component_id for r in shingle_join.shingle_groups(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_edges_of_the_frame(spark):
    frame = edge_frame(spark)
    assert shingle_join.shingle_groups(frame).count() == frame.count()
    assert shingle_join.drop_near_copies(frame).columns == frame.columns
    assert shingle_join.drop_near_copies(empty_frame(spark)).count() == 0


def test_pipeline_stage_takes_five_word_similarity(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(300)]
    near = list(words)
    for i in (20, 90, 160, 230):  # 20 of 296 shingles differ: similarity 0.87, fingerprints further apart than 3 bits
        near[i] = "other"
    out = corpus_pipeline.without_near_copies(spark, docs_frame(spark, [" ".join(words), " ".join(near)]), "")
    assert [r.doc_id for r in out.collect()] == [0]


def alike_by_fingerprint_only(rng):
    """Two texts whose fingerprints differ in 3 bits at most and whose 5-word similarity is below 0.8."""
    while True:
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = [f"X{rng.randrange(10**6)}" if i % 30 == 9 else w for i, w in enumerate(words)]
        a, b = " ".join(words), " ".join(other)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3:
            assert brute_groups([a, b]) == [0, 1]
            return a, b


def test_near_copies_of_the_pipeline_are_linked_by_fingerprints_too(spark):
    """Also through other texts, and a doc_id that repeats joins nothing."""
    rng = random.Random(4)
    a, b = alike_by_fingerprint_only(rng)
    near_b = b + " one more"
    far = [" ".join(f"f{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3)]
    docs = spark.createDataFrame([(3, a), (5, b), (7, near_b), (7, far[0]), (8, far[1]), (9, far[0] + " end"), (None, far[2])], "doc_id long, text string")
    got = shingle_join.shingle_groups(docs, by_fingerprint=True).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(3, 3), (5, 3), (7, 3), (7, 7), (8, 8), (9, 7)]
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 7, 7, 8]


def test_parities_rule_out_long_texts_and_never_similar_ones():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 40, 1900, 2040, 2200, 6000, 8100, 8500, 70_000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.append(base[: n - n // 12], rng.integers(0, 2**64, n // 14, dtype=np.uint64)))]
    wide = np.array([shingle_join.parities(s).tobytes() for s in sets], object)
    held = shingle_join.Parities(wide)
    for i, s in enumerate(sets):
        at = np.flatnonzero(shingle_join._alike(len(s), np.array(list(map(len, sets)))))
        apart = held.apart(i, at)
        assert (apart == shingle_join._apart(wide[np.full(len(at), i)], wide[at])).all()
        for j, bits in zip(at.tolist(), apart.tolist(), strict=True):
            assert bits <= len(np.setxor1d(s, sets[j]))
            if len(s) > 100 and i // 2 != j // 2:
                assert 9 * bits > len(s) + len(sets[j])


def test_repeated_and_missing_doc_ids_lose_no_pair(spark):
    """A set that two rows bring is verified once, whichever document it is cut from."""
    texts = [t for t in corpus(random.Random(5), 40) if t and t.strip()]
    want = brute_groups(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.shingle_groups(docs.repartition(3)).collect() if r.doc_id is not None}
    assert [got[i] for i in range(len(texts))] == want
