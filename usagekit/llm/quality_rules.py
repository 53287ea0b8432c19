"""Quality rules: base counts of a text and repetition measured by a suffix array of its words.

The suffix array covers a batch of texts at once: words of different texts never compare equal, so a
match stays inside its text. It is built by prefix doubling that only ever re-sorts suffixes which are
still tied; the ranks of each doubling give the longest common prefix of neighbours. The longest match
of a position is the larger prefix it shares with its two neighbours, and the positions whose match is
at least ``least`` words long are the occurrences of the maximal repeated substrings (the intervals of
the array with that common prefix). The union of their spans, as a share of the words, and the longest
of them decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from usagekit.llm.common import column

# Rules: a repeat counts from LEAST words; a text fails where repeats cover more than COVERED percent of
# its words, or where the longest is over LONGEST words.
LEAST, COVERED, LONGEST = 10, 30, 100
MIN_WORDS, MAX_REPEAT = 50, 50
# Characters that count as symbols, and ASCII white space.
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\x0b\x0c\r"
CHUNK = 100_000  # words that are sorted together; a longer text is sorted alone
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def longest_matches(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position the length of the longest other occurrence, in the same text, of what starts there.

    words: word numbers of all texts one after the other; text: the number of the text of each, ascending.
    """
    n = len(words)
    key = text * (int(words.max(initial=0)) + 1) + words
    array = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = np.diff(key[array]) != 0
    slots, rank = np.arange(n), np.full(n + 1, -1, np.int32)
    rank[array] = np.maximum.accumulate(np.where(new, slots, 0))
    ranks, step = [rank], 1
    tied = slots[~(new & np.append(new[1:], True))]
    while len(tied):
        at = array[tied]
        then = np.minimum(at + step, n)
        after = np.where((then < n) & (text[np.minimum(then, n - 1)] == text[at]), rank[then].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        array[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = np.diff(key) != 0
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        ranks.append(rank)
        step *= 2
        tied = tied[~(new & np.append(new[1:], True))]
    best = np.zeros(n, np.int64)
    pair = np.flatnonzero(ranks[0][array[1:]] == ranks[0][array[:-1]]) if n else slots
    p, q = array[pair], array[pair + 1] if n else pair
    shared = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = ranks[level][np.minimum(p + shared, n)], ranks[level][np.minimum(q + shared, n)]
        shared += np.where((a == b) & (a >= 0), 1 << level, 0)
    np.maximum.at(best, p, shared)
    np.maximum.at(best, q, shared)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Positions that lie in a repeated stretch of at least ``least`` words."""
    start = np.flatnonzero(best >= least)
    change = np.zeros(len(best) + 1, np.int64)
    change[start] += 1
    np.subtract.at(change, start + best[start], 1)
    return np.cumsum(change)[:-1] > 0


def measure(texts: list[str], least: int = LEAST) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """RESULT per text, and per text the spans (first and end word) of its repeats."""
    split = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    index: dict[bytes, int] = {}
    words = np.fromiter((index.setdefault(w, len(index)) for s in split for w in s), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    best = longest_matches(words, text)
    total = lambda flags: np.bincount(text, flags, len(texts)).astype(np.int64)
    repeats = covered(best, least)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, best)
    lines = [[line for line in t.split("\n") if line.strip(WHITE)] for t in texts]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeats, [False]]).astype(np.int8)) | np.append(np.diff(text, prepend=-1) != 0, True))
    runs = [(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if repeats[a]]
    first = np.cumsum(sizes) - sizes
    spans: list[list] = [[] for _ in texts]
    for a, b in runs:
        spans[text[a]].append((a - first[text[a]], b - first[text[a]]))
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, WHITE)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": total(covered(np.where(best >= 3, 3, 0), 3)),
        "covered_words": total(repeats),
        "longest_repeat": longest,
    }, spans


def verdicts(found: dict[str, np.ndarray], percent: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT * found["n_words"])
    return failed, ~failed & (100 * found["covered_words"] <= percent * found["n_words"]) & (found["longest_repeat"] <= longest)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK words (six characters a word) each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 6 * CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _judged(docs: DataFrame, keep: list[str], least: int, percent: int, longest: int, spans: bool = False, only_kept: bool = False) -> DataFrame:
    added = [*RESULT, "base_failed", "kept"]
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*[column(c) for c in keep]).alias("_row"))
    fields = rows.schema["_row"].dataType.fields
    if only_kept:
        schema = StructType(fields)
    else:
        schema = StructType([*fields, *[StructField(c, LongType() if c in RESULT else BooleanType()) for c in added]])
        if spans:
            span = StructType([StructField("start", LongType()), StructField("end", LongType())])
            schema = schema.add("repeats", ArrayType(span))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts):
                found, where = measure(texts[a:b], least)
                failed, kept = verdicts(found, percent, longest)
                part = batch.slice(a, b - a)
                columns = part.column(1).flatten()
                if only_kept:
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields]).filter(pa.array(kept))
                    continue
                columns += [pa.array(found[c]) for c in RESULT] + [pa.array(failed), pa.array(kept)]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    columns.append(pa.array([[{"start": int(x), "end": int(y)} for x, y in w] for w in where], kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(judge, schema)


def quality_rules(docs: DataFrame, least: int = LEAST, percent: int = COVERED, longest: int = LONGEST, spans: bool = False) -> DataFrame:
    """doc_id, the counts of RESULT, base_failed and kept for every row of ``docs`` (doc_id, text).

    With ``spans`` also repeats: the united spans of repeated stretches, as word numbers (end exclusive).
    A null or empty text has no words and fails the base rule (fewer than 50 words). Repeated rows are judged alike. Work
    and memory follow the longest single text, not the table: rows never leave their partition.
    """
    return _judged(docs, ["doc_id"], least, percent, longest, spans)


def keep_good(docs: DataFrame, least: int = LEAST, percent: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns, in one pass without a shuffle."""
    return _judged(docs, docs.columns, least, percent, longest, only_kept=True)


# A position is covered where a stretch of LEAST words that starts at most LEAST - 1 words earlier occurs twice; the longest
# repeat is over LONGEST words where some stretch of LONGEST + 1 words occurs twice.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER () AS r
  FROM documents
), starts AS (
  SELECT r, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM d
), grams AS (
  SELECT r, i, m, md5(array_to_string(w[i:i + m - 1], ' ')) AS gram FROM starts, (VALUES (3), ({LEAST}), ({LONGEST + 1})) AS sizes(m) WHERE i + m - 1 <= n
), twice AS (
  SELECT r, i, m FROM (SELECT *, count(*) OVER (PARTITION BY r, m, gram) AS times FROM grams) WHERE times > 1
), cover AS (
  SELECT r, m, count(DISTINCT i + k) AS n FROM twice, range({LEAST}) AS u(k) WHERE m <= {LEAST} AND k < m GROUP BY r, m
), counts AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0) AS covered_words,
         d.r IN (SELECT r FROM twice WHERE m = {LONGEST + 1}) AS long_repeat
  FROM d LEFT JOIN cover a ON a.r = d.r AND a.m = 3 LEFT JOIN cover b ON b.r = d.r AND b.m = {LEAST}
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * covered_words <= {COVERED} * n_words AND NOT long_repeat AS kept
FROM judged
"""
