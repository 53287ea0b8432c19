"""Lattice sums against all segmentations written out; document scores against a plain version."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from frames import docs_frame, edge_frame, edge_rows, empty_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from usagekit.llm import lattice_lm, queries, subwords

PIECES = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"b a", b"abc", b"bc", " é".encode(), b"aaaa", b" abca", "日本".encode()})
LOGS = np.log(np.random.default_rng(4).dirichlet(np.ones(len(PIECES))))


def segmentations(text):
    if not text:
        yield ()
    for i, p in enumerate(PIECES):
        if text.startswith(p):
            for rest in segmentations(text[len(p) :]):
                yield (i, *rest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé日本", max_size=7), min_size=1, max_size=6))
def test_sums_equal_all_segmentations(words):
    lattice = subwords.Lattice(PIECES)
    words = [w.encode() for w in words]
    counts = np.arange(1, len(words) + 1)
    want, expected = [], np.zeros(len(PIECES))
    for word, n in zip(words, counts, strict=True):
        ways = list(segmentations(b" " + word))
        weights = np.exp([sum(LOGS[i] for i in way) for way in ways])
        want.append(math.log(weights.sum()))
        for way, weight in zip(ways, weights, strict=True):
            for i in way:
                expected[i] += n * weight / weights.sum()
    assert np.allclose(lattice.scores(words, LOGS), want, rtol=1e-12)
    assert np.allclose(lattice.expected(words, counts, LOGS), expected, rtol=1e-9, atol=1e-12)


def forward(word, pieces, logs):
    """Plain forward recursion; ``pieces`` is a dictionary."""
    text, alpha = b" " + word, [0.0]
    for e in range(1, len(text) + 1):
        parts = [alpha[s] + logs[pieces[text[s:e]]] for s in range(max(0, e - 50), e) if text[s:e] in pieces]
        top = max(parts)
        alpha.append(top + math.log(sum(math.exp(x - top) for x in parts)))
    return alpha[-1]


def test_long_words_and_stretches(monkeypatch):
    monkeypatch.setattr(subwords, "STRETCH", 37)
    lattice, place = subwords.Lattice(PIECES), {p: i for i, p in enumerate(PIECES)}
    words = [b"a" * 500, b"abc" * 90, "日本é".encode() * 60, b"x" * 95, b"abcab" * 19, b"abcab" * 19 + b"a", b""]
    assert np.allclose(lattice.scores(words, LOGS), [forward(w, place, LOGS) for w in words], rtol=1e-11)


def brute(rows, model):
    words = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i, (_, t) in enumerate(rows)}
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter()
    for i, ws in words.items():
        if not held[i]:
            count.update([*ws, ""])
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.distinct) == (n, v)
    place = {p: i for i, p in enumerate(model.pieces)}
    memory, out = {}, []
    for i, (doc_id, _) in enumerate(rows):
        tokens = [*words[i], ""]
        score = model.end
        for w in words[i]:
            if w not in memory:
                memory[w] = forward(w.encode(), place, model.logs)
            score += memory[w]
        out.append((str(doc_id), held[i], len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), score / math.log(10)))
    return out


def compare(frame, rows, **options):
    model = lattice_lm.train(lattice_lm.count_words(frame))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lattice_lm.score_documents(frame, **options).collect())
    want = sorted(brute(rows, model))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_documents_equal_brute_force(spark, most):
    """All words known to the tasks; the frequent ones only; all by the join, ends included."""
    rows = [(r[0], (r[1] or "")[:4000] if r[1] is not None else None) for r in edge_rows()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(frame, rows, most=most)


def test_edges_and_empty(spark):
    assert lattice_lm.score_documents(edge_frame(spark)).count() == len(edge_rows())
    assert lattice_lm.score_documents(empty_frame(spark)).count() == 0
    only = docs_frame(spark, [None, ""])
    assert all(r.base_score <= 0 and r.score <= 0 for r in lattice_lm.score_documents(only).collect())


def test_training_rises_and_repeats(spark):
    """Each round raises the probability of the training words; results do not depend on partitions."""
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    sums = [lattice_lm.score_documents(docs, rounds=r).where("NOT held_out").agg({"score": "sum"}).first()[0] for r in (1, 2, 3)]
    assert sums == sorted(sums) and sums[0] < sums[2]
    again = lattice_lm.score_documents(docs.repartition(7)).where("NOT held_out").agg({"score": "sum"}).first()[0]
    assert math.isclose(again, sums[2], rel_tol=1e-9)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert queries.op13_lattice_lm(spark, sf).count() == len(rows)
    compare(docs, rows)
