"""Fill-in-middle transformation: texts cut at token boundaries and laid out with the middle last.

A text is cut into fixed blocks of its UTF-8 bytes. Per block there are two counts, of units (tokens that
begin in it) and of code points, and a Fenwick tree over the blocks holds both. A cut after so many units is
found by descending the tree in powers of two to the block in which the next unit begins; only that block is
then searched for the byte. What the tree passes on the way gives the code points before the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import text_or_empty
from usagekit.llm.packing import stretches

BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class BlockCounts:
    """Units `[A-Za-z]+|[^A-Za-z]` and code points of a text (UTF-8 bytes) in a Fenwick tree over its blocks."""

    def __init__(self, text: bytes, block: int = BLOCK):
        data = np.frombuffer(text, np.uint8)
        self.size, self.block = len(data), block
        self.points = (data & 0xC0) != 0x80  # first bytes of code points
        letter = ((data | 0x20) - np.uint8(97)) < 26
        self.begins = self.points.copy()  # first bytes of units: a letter after a letter begins none
        self.begins[1:] &= ~(letter[1:] & letter[:-1])
        starts = np.arange(0, self.size, block)
        self.blocks = len(starts)
        self.units, self.chars = (self._tree(np.add.reduceat(x, starts, dtype=np.int64) if self.size else starts) for x in (self.begins, self.points))
        self.n, self.n_chars = int(self.begins.sum()), int(self.points.sum())

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        """Place i holds the sum of the last lowbit(i) of the first i counts."""
        sums, at = np.concatenate([[0], np.cumsum(counts)]), np.arange(len(counts) + 1)
        return (sums - sums[at - (at & -at)]).tolist()

    def descend(self, units: int) -> tuple[int, int, int]:
        """The last block before which at most ``units`` units begin; the units and code points before it."""
        at, passed, chars = 0, 0, 0
        step = 1 << self.blocks.bit_length()
        while step := step >> 1:
            if at + step <= self.blocks and passed + self.units[at + step] <= units:
                at += step
                passed += self.units[at]
                chars += self.chars[at]
        return at, passed, chars

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code point at which the unit after the first ``units`` begins; the end of the text if there is none."""
        if units >= self.n:
            return self.size, self.n_chars
        block, passed, chars = self.descend(units)
        begin = block * self.block
        byte = begin + int(np.flatnonzero(self.begins[begin : begin + self.block])[units - passed])
        return byte, chars + int(np.count_nonzero(self.points[begin:byte]))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2^32 from SHA-256 of seed, colon and doc_id (nothing for a missing one)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def transform(doc_id: int | None, text: bytes, seed: str, fim_percent: int, spm_percent: int, block: int) -> tuple:
    counts = BlockCounts(text, block)
    one, two, three, four = draws(doc_id, seed)
    if not text or three % 100 >= fim_percent or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return doc_id, counts.n, PLAIN, None, None, text
    low, high = sorted((one % (counts.n + 1), two % (counts.n + 1)))
    (a, a_chars), (b, b_chars) = counts.cut(low), counts.cut(high)
    prefix, middle, suffix = (mark.encode() + part for mark, part in ((PREFIX, text[:a]), (MIDDLE, text[a:b]), (SUFFIX, text[b:])))
    form, output = (SPM, suffix + prefix + middle) if four % 100 < spm_percent else (PSM, prefix + suffix + middle)
    return doc_id, counts.n, form, a_chars, b_chars - a_chars, output


def fill_in_middle(docs: DataFrame, seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (string): one row for every row of ``docs`` (doc_id, text).

    n counts the tokens `[A-Za-z]+|[^A-Za-z]` of the whole text (null: empty). Two draws of doc_id give the cuts,
    a third whether the text stays plain, a fourth the order of the parts. Texts without a character and texts that
    hold a marker stay plain, whatever the draw. Rows without doc_id draw from an empty name; repeated rows give
    equal rows. An empty table gives none. No row depends on another: a batch holds one text or some megabytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for begin, end in stretches(texts):
                rows = zip(ids.slice(begin, end - begin).to_pylist(), texts.slice(begin, end - begin).to_pylist(), strict=True)
                columns = zip(*(transform(i, t, seed, fim_percent, spm_percent, block) for i, t in rows), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text")).mapInArrow(run, ROWS)
    return rows.withColumn("output", F.col("output").cast("string"))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``. No part holds a marker and none overlaps itself, so the first is the one that was set."""
    return F.when(F.locate(mark, text) > 0, F.substring(text, F.locate(mark, text) + len(mark), F.length(text))).otherwise(F.lit(""))


def restore(output: Column, form: Column) -> Column:
    """The original text from an output and its form."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))  # without the first marker
    first, rest = F.substring_index(body, SUFFIX, 1), _after(body, SUFFIX)
    psm = F.concat(first, _after(rest, MIDDLE), F.substring_index(rest, MIDDLE, 1))
    last, rest = F.substring_index(body, PREFIX, 1), _after(body, PREFIX)
    spm = F.concat(F.substring_index(rest, MIDDLE, 1), _after(rest, MIDDLE), last)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
         ('0x' || h[25:32])::BIGINT AS h4 FROM cut
), parts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), laid AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM laid
"""
