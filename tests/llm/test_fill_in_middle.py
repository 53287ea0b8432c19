"""Fill-in-middle against a plain regular-expression version, its round trip, and the block tree against running counts."""

import hashlib
import re

import pytest
from frames import docs_frame, edge_frame, edge_rows, empty_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from usagekit.llm import fill_in_middle as fim
from usagekit.llm import queries


def brute(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ é日\U0001f600.\n<PSM>\x00", max_size=60), st.integers(1, 9))
def test_cuts_equal_running_counts(text, block):
    counts = fim.BlockCounts(text.encode(), block)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    assert counts.n == len(units) and counts.n_chars == len(text)
    for k in range(len(units) + 2):
        head = "".join(units[:k])
        assert counts.cut(k) == (len(head.encode()), len(head))


TEXTS = [
    "plain words here, and more of them.", "", "with <P> a marker", "x", "Ünïcode — 日本語 and\nlines\n", "ends in <S", "<", "<<S", "M> starts", "a" * 9000,
    "word " * 5000, " \x00 ", "P><S", "\U0001f600" * 3000, None,
]


def check(frame, rows):
    out = fim.fill_in_middle(frame).withColumn("back", fim.restore(queries.F.col("output"), queries.F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=str)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=str)
    return out


def test_rows_equal_brute_force_and_restore(spark):
    texts = TEXTS * 8  # every text under several draws
    out = check(docs_frame(spark, texts), list(enumerate(texts)))
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_edges(spark):
    check(edge_frame(spark), [(r[0], r[1]) for r in edge_rows()])
    assert fim.fill_in_middle(empty_frame(spark)).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_equals_brute_force(spark, sf):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = queries.documents(spark, f"/root/testdata/sf{sf}").collect()
    want = {r.doc_id: brute(r.doc_id, r.text) for r in docs}
    rows = queries.op12_fill_in_middle(spark, f"/root/testdata/sf{sf}").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, output = want[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, sha(output))
    assert {(r.doc_id, r.restored_sha256) for r in rows} == {(r.doc_id, sha(r.text or "")) for r in docs}
