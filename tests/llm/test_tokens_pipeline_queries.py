import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, duck
from frames import docs_frame

import __spark_entry__ as entry
import corpus_pipeline
from usagekit.llm import packing, queries, token_counts

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "Hello, world's 12 ﬁne\tthings\n", "<|endoftext|> x<|startoftext|>y", "naïve café ΣΑΣ 日本語 \U0001f600", "é x y z", "word " * 9000, "0123456789" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("source", ["own", "documents"])
def test_packing_is_an_exact_round_trip(spark, tokenizer, source):
    texts = TEXTS * 3 if source == "own" else [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = packing.pack_documents(docs_frame(spark, texts)).toPandas()
    for i, part in rows.groupby("doc_id"):
        ids = ids_of(tokenizer, texts[i])
        part = part.sort_values("start")
        assert (part.start == part.length.cumsum() - part.length).all() and part.length.sum() == len(ids) and (part.doc_tokens == len(ids)).all()
        for p in part.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert rows.doc_id.nunique() == len(texts)
    used = []
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all()
        used.append(part.length.sum())
    assert max(used) <= 2048
    if source == "documents":
        assert 1 - sum(used) / (2048 * len(used)) < 0.05


@pytest.mark.parametrize("tokens", [0, 1, 63, 64, 65, 681, 682, 683, 1023, 1024, 1025, 2047, 2048, 2049, 9999])
def test_pieces_have_class_lengths(tokens):
    cut = list(packing.cut_lengths(tokens, 2048, 32))
    assert sum(n for n, _ in cut) == tokens
    assert all(n == 2048 // k for n, k in cut if k <= 32) and all(n <= 64 for n, k in cut if k == 33)


def test_first_fit_leaves_no_bin_that_would_fit_elsewhere():
    import pandas as pd

    rows = pd.DataFrame({"doc_id": range(60), "start": 0, "length": [2048 // (2 + i % 31) for i in range(60)], "ids_crc32": 0, "doc_tokens": 0, "_left": 0})
    out = packing.first_fit(2048)(rows)
    used = out.groupby("bin").length.sum()
    assert used.max() <= 2048 and (used > 1024).sum() >= len(used) - 1


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    counts = token_counts.count_tokens(docs_frame(spark, ["a b c", "d e", None, "f"]))
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    read = lambda: sorted((r.source, r.version, r.documents, r.tokens) for r in rollup.totals().collect())
    assert read() == []
    assert rollup.commit("b1", token_counts.inserts(counts)) is True
    once = read()
    assert rollup.commit("b1", token_counts.inserts(counts)) is False and read() == once
    later = token_counts.count_tokens(docs_frame(spark, ["a b c", "d e more words", None, None]))
    rollup.commit("b2", token_counts.difference(counts, later))
    fresh = token_counts.TokenRollup(spark, str(tmp_path / "fresh"))
    fresh.commit("all", token_counts.inserts(later))
    assert read() == sorted((r.source, r.version, r.documents, r.tokens) for r in fresh.totals().collect())
    rollup.commit("b3", token_counts.deletes(later))
    assert read() == []
    with pytest.raises(ValueError):
        rollup.commit("../b4", token_counts.inserts(counts))


def test_two_writers_of_one_batch_count_once(spark, tmp_path, monkeypatch):
    """Both have passed the first look; one manifest is created, and the other writer's table is never read."""
    counts = token_counts.count_tokens(docs_frame(spark, ["a b c d e"]))
    one, two = (token_counts.TokenRollup(spark, str(tmp_path / "rollup")) for _ in range(2))
    monkeypatch.setattr(token_counts.TokenRollup, "committed", lambda self, batch: False)
    assert [w.commit("b1", token_counts.inserts(counts)) for w in (one, two)] == [True, False]
    assert {(r.version, r.documents, r.tokens) for r in one.totals().collect() if r.version == token_counts.WORDS} == {(token_counts.WORDS, 1, 5)}


def test_compaction_keeps_totals_and_names(spark, tmp_path):
    counts = token_counts.count_tokens(docs_frame(spark, ["a b", "c", None]))
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    read = lambda: sorted(map(str, rollup.totals().collect()))
    for name in ("b1", "b2"):
        rollup.commit(name, token_counts.inserts(counts))
    before = read()
    assert rollup.compact() and read() == before and len(rollup._tables()[0]) == 1
    assert not rollup.commit("b1", token_counts.inserts(counts)) and read() == before
    rollup.commit("b3", token_counts.deletes(counts))
    rollup.commit("b4", token_counts.deletes(counts))
    assert read() == [] and len(rollup._tables()[0]) == 3
    assert rollup.compact() and read() == [] and rollup._tables()[2] == 2
    assert not rollup._create("compactions", "2", {}) and read() == []


def test_claim_of_a_dead_writer_is_released(spark, tmp_path):
    counts = token_counts.count_tokens(docs_frame(spark, ["a"]))
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    rollup._fs.create(rollup._manifest("commits", "b1"), False).close()
    assert not rollup.commit("b1", token_counts.inserts(counts)) and rollup.totals().count() == 0
    assert rollup.release("b1") and rollup.commit("b1", token_counts.inserts(counts)) and not rollup.release("b1")


def test_token_totals_equal_brute_force(spark, tokenizer):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for version, n in ((token_counts.WORDS, len(r.text.encode().split())), (token_counts.BPE, len(ids_of(tokenizer, r.text)) - 1)):
            d, t = want.get((r.source, r.lang, version), (0, 0))
            want[r.source, r.lang, version] = (d + 1, t + n)
    got = queries.op6_token_rollups(spark, SF).collect()
    assert {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in got} == want


def test_pipeline_stages_equal_brute_force(spark, tokenizer, tmp_path):
    from test_exact_mixing_sharding import refill
    from test_rules_model_pii import brute_rules
    from test_shingle_join import brute_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(now.toPandas())
        if i < 4:
            assert now.columns == docs.columns
    rows = docs.toPandas()
    good = {r.doc_id: r.text for r in rows.itertuples() if brute_rules(r.text)[8]}
    assert sorted(seen[0].doc_id) == sorted(good)
    first = {}
    for i in sorted(good):
        first.setdefault(" ".join(good[i].split()), i)
    assert sorted(seen[1].doc_id) == sorted(first.values())
    ids = sorted(first.values())
    near = {ids[r] for r in brute_groups([good[i] for i in ids])}  # 5-word Jaccard of at least 0.8, all pairs
    assert len(near) < len(ids)
    assert sorted(seen[2].doc_id) == sorted(near)
    words = {r.doc_id: len(r.text.encode().split()) for r in rows.itertuples()}
    source = dict(zip(rows.doc_id, rows.source, strict=True))
    names = sorted({source[i] for i in near})
    sizes = [sum(words[i] for i in near if source[i] == s) for s in names]
    goal = refill(sizes, [1 + k % 3 for k in range(len(names))], 3)
    mixed = seen[3].doc_id.map(words).groupby(seen[3].source).sum()
    longest = max(words[i] for i in near)
    assert set(seen[3].doc_id) <= near and seen[3].groupby("doc_id").size().max() <= 3
    assert all(abs(mixed.get(s, 0) - g) <= longest for s, g in zip(names, goal, strict=True))
    assert abs(mixed.sum() / sum(goal) - 1) < 0.1
    tokens = sum(len(ids_of(tokenizer, t)) for t in seen[3].text)
    assert seen[4].length.sum() == tokens and len(entry.queries()["pipeline"](spark, SF).collect()) == len(seen[4])


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ok, note, _ = compare(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert ok, note


def test_all_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_a_worker_forgets_its_words_when_a_pack_task_ends(spark):
    """Workers are used again: what one remembered of a task would stay beside the memory of all later stages."""
    path = packing.vocabulary_path()
    packing.pack_documents(docs_frame(spark, [f"word{'xyz'[i % 3]} other{i}" for i in range(300)], 8)).count()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(packing.encoder(path).index)] * batch.num_rows, pa.int64())})

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {1}


def test_words_are_encoded_in_bounded_parts(monkeypatch):
    texts = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {i} ﬁ{i}" for i in range(2000)), "<|endoftext|> a", None])
    whole = packing.WordIds(packing.vocabulary_path()).encode(texts)
    monkeypatch.setattr(packing, "NEW", 7)
    assert all((a == b).all() for a, b in zip(whole, packing.WordIds(packing.vocabulary_path()).encode(texts), strict=True))
