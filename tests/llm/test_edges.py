"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, and on empty tables."""

import pytest
from frames import edge_frame, edge_rows, empty_frame

from usagekit.llm import exact_dedup, mixing, packing, pii, quality_model, quality_rules, sharding, simhash, suffix_dedup, token_counts

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0), (4, 0, 0), (4, 1, 0)], LABELS)


PER_ROW = {
    "simhash": simhash.simhash_groups,
    "mixing": mixing.mix_sources,
    "trees": lambda d: quality_model.score_quality(d, labels(d.sparkSession)),
    "suffix": suffix_dedup.remove_repeats,
    "rules": lambda d: quality_rules.quality_rules(d, spans=True),
    "exact": exact_dedup.exact_groups,
    "sharding": sharding.shard_documents,
    "pii": pii.find_pii,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(spark, name):
    assert PER_ROW[name](edge_frame(spark)).count() == len(edge_rows())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](empty_frame(spark)).count() == 0


def test_packing_has_every_token(spark):
    rows = packing.pack_documents(edge_frame(spark)).toPandas()
    assert rows.doc_id.isna().sum() >= 3 and rows.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack_documents(empty_frame(spark)).count() == 0


def test_token_totals(spark):
    rows = token_counts.token_totals(edge_frame(spark)).toPandas()
    assert rows[rows.version == token_counts.WORDS].documents.sum() == len(edge_rows())
    assert rows.source.isna().any() and (rows.source == "").any()
    assert token_counts.token_totals(empty_frame(spark)).count() == 0


def test_filters_keep_all_columns(spark):
    frame = edge_frame(spark)
    for keep in (quality_rules.keep_good, exact_dedup.drop_exact_copies, simhash.drop_near_copies, mixing.mixed_documents):
        out = keep(frame)
        assert out.columns == frame.columns, keep
        out.collect()
        assert keep(empty_frame(spark)).count() == 0


def test_null_doc_id_and_repeats_have_defined_results(spark):
    exact = exact_dedup.exact_groups(edge_frame(spark)).toPandas()
    sizes = exact.groupby("text_sha256").group_size.agg(["nunique", "first", "size"])
    assert (sizes["nunique"] == 1).all() and (sizes["first"] == sizes["size"]).all()
    assert (exact[exact.doc_id == -5].kept).all()  # the smallest of "one two" and its spellings
    prints = simhash.simhash_groups(edge_frame(spark)).toPandas()
    assert set(prints[prints.fingerprint == "0" * 16].component_id) == {0}
    shards = sharding.shard_documents(edge_frame(spark)).toPandas()
    assert (shards[shards.doc_id.isna()].shard == 0).all()
    assert shards.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s)))).all()
