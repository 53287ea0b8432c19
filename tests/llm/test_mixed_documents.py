import random

from test_exact_mixing_sharding import refill

from usagekit.llm import mixing


def test_sources_end_within_a_document_of_their_targets(spark):
    """About one document per shard of a source: each decided alone, they all round the same way."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(40, 300)), f"s{i % 9:02}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    words = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows})
    goal = refill([sum(words[i] for i, _, s in rows if s == name) for name in names], [1 + k % 3 for k in range(9)], 3)
    out = mixing.mixed_documents(docs).collect()
    got = {name: sum(words[r.doc_id] for r in out if r.source == name) for name in names}
    assert all(abs(got[name] - g) <= 300 for name, g in zip(names, goal, strict=True)), (got, goal)
    # whole rounds stay as op2 decides them: a document is taken as often as its taken words say, down or up
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix_sources(docs).collect()}
    times = {i: sum(r.doc_id == i for r in out) for i in words}
    assert all(int(taken[i]) <= times[i] <= -(-taken[i] // 1) for i in words)
