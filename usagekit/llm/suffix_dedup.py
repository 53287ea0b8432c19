"""Suffix-array dedup by a logarithmic family of indexes.

A string of LEAST bytes is removed where it also starts earlier. Suffixes are sampled at anchors: of the
hashes of all GRAM-byte strings inside a window of LEAST bytes the smallest is an anchor, so equal windows
have equal anchors at equal places. A batch's suffix array lists its anchors sorted by the hash of the
first GRAM bytes, then by the hash of all bytes that windows through the anchor can reach (its context),
then by place; suffixes that agree so far stand together, which is all that a search for matches needs.

Batches come in the order of doc_id. A new batch's array is merge-scanned with the levels of the family:

* an anchor whose whole context stands earlier is covered as far as that context reaches;
* anchors that agree in the first GRAM bytes but not in the context mark where matches end. Their bytes
  are fetched, and each window through such an anchor is looked up among the equal ones, so the ends
  are exact to the byte.

A batch joins the family as a level of size one; levels of equal size are merged into one of twice the
size by the very scan that compares them. n batches leave log n levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagekit.llm.common import delete_folder, read_folder, text_or_empty, write_folder

LEAST, GRAM = 100, 32
REACH = LEAST - GRAM  # bytes of context on either side of an anchor's first GRAM bytes
WIDTH = LEAST + REACH
BLOCK = 1 << 20  # bytes hashed together; longer texts are cut into blocks that overlap
CHUNK = 40_000  # anchors whose windows are compared together
HOT = 20_000  # from so many contexts on, the anchors of one gram are spread by the hashes of their windows
BATCHES = 4
LAST_ID = (1 << 63) - 1  # order of rows without doc_id: after all others
RUN = "h long, c long, doc long, pos int"
MARKED = RUN + ", seen boolean"
CONTEXTS = "h long, doc long, pos int, c long, l int, bytes binary"
SPANS = "doc long, pos int, c long, lo int, hi int"


# ---- hashing -------------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
VALUES = np.random.default_rng(100).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _context_hash(poly: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the polynomial over the context and of how far it reaches to either side."""
    return _mix(poly + (left * 256 + right).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each stretch of ``width`` values."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _anchors(parts: list[tuple[int, int, int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """h, c, doc, pos of the anchors of parts: (doc, size of the text, place of the part's first byte, first and
    end window start that count, bytes)."""
    data = np.frombuffer(b"".join(p[5] for p in parts), np.uint8)
    n = len(data)
    up, down = _powers(2 * BLOCK)
    if n > len(up):
        up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[data] * up[:n], out=sums[1:])
    grams = np.maximum(_mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]), 1)
    least = _slide(grams, REACH + 1, np.minimum)
    sizes = np.array([len(p[5]) for p in parts])
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(len(least) + 1, np.int8)
    for s, (_, _, place, first, end, _) in zip(starts, parts, strict=True):
        inside[s + first - place] += 1
        inside[s + end - place] -= 1
    least[np.cumsum(inside)[:-1] == 0] = 0
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero(_slide(padded, REACH + 1, np.maximum)[: len(grams)] == grams)
    part = np.searchsorted(starts, at, "right") - 1
    doc, size, place = (np.array([p[i] for p in parts], np.int64)[part] for i in range(3))
    pos = at - starts[part] + place
    left, right = np.minimum(pos, REACH), np.minimum(size - pos - GRAM, REACH)
    context = (sums[at + GRAM + right] - sums[at - left]) * down[at - left]
    return grams[at].view(np.int64), _context_hash(context, left, right), doc, pos.astype(np.int32)


def _parts(doc: int, data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    n = len(data)
    for s in range(0, n - LEAST + 1, BLOCK):
        end = min(s + BLOCK, n - LEAST + 1)
        a, b = max(0, s - REACH), min(n, end + LEAST - 1 + REACH)
        yield doc, n, a, s, end, data[a:b]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (MARKED); seen: the same stretch of a megabyte has its context at an earlier place."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        h, c, doc, pos = _anchors(held)
        order = np.lexsort((pos, doc, c, h))
        new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0))[: len(order)]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        seen = np.zeros(len(h), bool)
        seen[order] = (doc[order] != doc[head]) | (pos[order] != pos[head])
        return pa.RecordBatch.from_arrays(list(map(pa.array, (h, c, doc, pos, seen))), names=["h", "c", "doc", "pos", "seen"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _parts(doc, text.as_py().encode("utf-8", "replace")):
                if size + len(part[5]) > BLOCK + 2 * WIDTH and held:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += len(part[5])
    if held:
        yield out()


def ordered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), text_or_empty().alias("text"))


# ---- the family ------------------------------------------------------------------------------------


class IndexFamily:
    """Levels of sampled suffix arrays in the shared folder, and what their scans have found.

    Batches have to come in the order of doc_id. Rows without doc_id come last.
    """

    def __init__(self, spark):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []  # (size, folder), the largest first
        self.found: list[str] = []

    def _level(self, path: str) -> DataFrame:
        return read_folder(self.spark, path, RUN + ", kind string").where("kind <> 'found'").select("h", "c", "doc", "pos")

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """Scans a batch (doc, text) against itself and all levels; unless it is the ``last``, it joins the family."""
        size, merged = 1, []
        for level in reversed(self.levels):
            if level[0] == size and not last:
                merged.append(level)
                size *= 2
        rows = batch.where(F.octet_length("text") >= LEAST).mapInArrow(_runs, MARKED)
        rows = rows.withColumns({"new": F.lit(True), "mine": F.lit(not last)})
        for level in self.levels:
            rows = rows.unionByName(self._level(level[1]).withColumns({"seen": F.lit(False), "new": F.lit(False), "mine": F.lit(level in merged)}))
        # What a task has seen before is settled; it is dealt out by place, so a frequent passage meets as a row per stretch.
        rows = rows.withColumn("key", F.when(F.col("seen"), F.xxhash64("doc", "pos")).otherwise(F.col("h")))
        same, gram = Window.partitionBy("key", "c").orderBy("doc", "pos"), Window.partitionBy("key")
        # rank, not row number: the same place given twice is no earlier place
        rows = rows.repartition("key").withColumn("first", (F.rank().over(same) == 1) & ~F.col("seen"))
        contexts = F.sum(F.col("first").cast("int")).over(gram)
        fresh = F.max(F.col("first") & F.col("new")).over(gram)
        rows = rows.withColumn("edge", F.col("first") & (contexts > 1) & fresh)
        # found: covered rows of the batch; edge: to be compared byte by byte; level: joins the family
        stays = F.col("first") & F.col("mine")
        kind = F.when(F.col("edge") & stays, "both").when(F.col("edge"), "edge").when(F.col("new") & ~F.col("first"), "found").when(stays, "level")
        rows = rows.withColumn("kind", kind).where("kind IS NOT NULL").select("h", "c", "doc", "pos", "kind")
        path = write_folder(rows, "suffixes", ["kind"])
        self.found.append(path)
        if not last:
            self.levels = [x for x in self.levels if x not in merged] + [(size, path)]
        for _, old in merged:
            delete_folder(self.spark, f"{old}/kind=level")

    def scanned(self) -> DataFrame:
        """h, c, doc, pos, kind of all that the scans have found."""
        tables = [read_folder(self.spark, p, RUN + ", kind string").where("kind <> 'level'") for p in self.found]
        rows = tables[0]
        for more in tables[1:]:
            rows = rows.unionByName(more)
        return rows

    def close(self) -> None:
        for path in self.found:
            delete_folder(self.spark, path)


# ---- where matches end -----------------------------------------------------------------------------


def _cut_contexts(data: bytes, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of WIDTH bytes around each position (0 where the text has none), reach to the left and right, and hashes."""
    padded = np.frombuffer(bytes(REACH) + data + bytes(WIDTH), np.uint8)
    rows = padded[pos[:, None] + np.arange(WIDTH)]
    left, right = np.minimum(pos, REACH), np.minimum(len(data) - pos - GRAM, REACH)
    there = (np.arange(WIDTH) >= REACH - left[:, None]) & (np.arange(WIDTH) < REACH + GRAM + right[:, None])
    up, down = _powers(2 * BLOCK)
    poly = np.where(there, VALUES[rows] * up[:WIDTH], np.uint64(0)).sum(1, dtype=np.uint64) * down[REACH - left]
    return rows, left, right, _context_hash(poly, left, right)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, edges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data, n = text.as_py().encode("utf-8", "replace"), len(edges.values)
            for i in range(0, n, CHUNK):
                h, c, pos = (edges.values.field(k).to_numpy()[i : i + CHUNK] for k in range(3))
                fits = pos + GRAM <= len(data)
                h, c, pos = h[fits], c[fits], pos[fits].astype(np.int64)
                rows, left, right, hashes = _cut_contexts(data, pos)
                good = hashes == c  # a row that shares its doc_id with another may not be the one meant
                cut = [r[REACH - a : REACH + GRAM + b].tobytes() for r, a, b in zip(rows[good], left[good], right[good], strict=True)]
                columns = [h[good], np.full(good.sum(), doc), pos[good].astype(np.int32), c[good], left[good].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cut, pa.binary())], names=["h", "doc", "pos", "c", "l", "bytes"])


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shift of the window (bytes before the anchor): shift, hash per row, whether the row has that window."""
    left = batch.column(4).to_numpy().astype(np.int64)
    texts = batch.column(5).to_pylist()
    right = np.fromiter(map(len, texts), np.int64, len(texts)) - left - GRAM
    data = b"".join(bytes(REACH - a) + t + bytes(REACH - b) for a, b, t in zip(left.tolist(), right.tolist(), texts, strict=True))
    values = VALUES[np.frombuffer(data, np.uint8).reshape(-1, WIDTH)].T
    top = _powers(2 * BLOCK)[0][LEAST - 1]
    rolling = np.zeros(len(texts), np.uint64)
    for column in values[REACH : REACH + LEAST][::-1]:
        rolling = rolling * BASE + column
    for shift in range(REACH + 1):
        if shift:
            rolling = (rolling - values[REACH + LEAST - shift] * top) * BASE + values[REACH - shift]
        yield shift, _mix(rolling), (left >= shift) & (right >= REACH - shift)


def _span_batch(doc, pos, c, low, high) -> pa.RecordBatch:
    hit = high >= 0
    columns = [doc[hit], pos[hit], c[hit], (pos[hit] - high[hit]).astype(np.int32), (pos[hit] + LEAST - low[hit]).astype(np.int32)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["doc", "pos", "c", "lo", "hi"])


def _match(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of a stretch of whole gram groups, sorted by place inside each."""
    n = batch.num_rows
    doc, pos = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    low, high = np.full(n, WIDTH), np.full(n, -1)
    for shift, hashes, there in _windows(batch):
        rows = np.flatnonzero(there)
        order = rows[np.argsort(hashes[rows], kind="stable")]
        new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = order[(doc[order] != doc[head]) | (pos[order] != pos[head])]
        low[later] = np.minimum(low[later], shift)
        high[later] = shift
    return _span_batch(*(batch.column(i).to_numpy() for i in (1, 2, 3)), low, high)


def _match_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
        if held.num_rows < CHUNK:
            continue
        h = held.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))  # the last group may go on
        if last:
            yield _match(held.slice(0, last).combine_chunks().to_batches()[0])
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield _match(held.combine_chunks().to_batches()[0])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of anchors, one row each."""
    for whole in batches:
        for i in range(0, whole.num_rows, 2_000):
            batch = whole.slice(i, 2_000)
            for shift, hashes, there in _windows(batch):
                keep = np.flatnonzero(there)
                columns = [batch.column(k).take(pa.array(keep)) for k in (0, 1, 2, 3)]
                columns += [pa.array(hashes[keep].view(np.int64)), pa.array(np.full(len(keep), shift, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "doc", "pos", "c", "w", "shift"])


def edge_spans(contexts: DataFrame, hot: int = HOT) -> DataFrame:
    """SPANS of the anchors whose windows stand earlier in part. ``contexts``: a written table of CONTEXTS.

    Anchors of one gram are compared in one task, except where a gram has over ``hot`` contexts: there every
    window is a row of its own, the first place of each window is a minimum (combined before the shuffle),
    and the result is the same.
    """
    many = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h")
    few = contexts.join(many, "h", "left_anti").repartition("h").sortWithinPartitions("h", "doc", "pos").mapInArrow(_match_groups, SPANS)
    shown = contexts.join(many, "h", "left_semi").mapInArrow(_spread, "h long, doc long, pos int, c long, w long, shift int")
    first = shown.groupBy("h", "w", "shift").agg(F.min(F.struct("doc", "pos")).alias("first"))
    later = shown.join(first, ["h", "w", "shift"]).where(F.struct("doc", "pos") != F.col("first"))
    spread = later.groupBy("doc", "pos", "c").agg((F.col("pos") - F.max("shift")).alias("lo"), (F.col("pos") + LEAST - F.min("shift")).alias("hi"))
    return few.unionByName(spread)


# ---- removal -----------------------------------------------------------------------------------------


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8", "replace")
            n = len(data)
            change = np.zeros(n + 1, np.int32)
            if spans.is_valid:
                pos, c, lo, hi = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                for i in range(0, len(pos), CHUNK):
                    p = pos[i : i + CHUNK].astype(np.int64)
                    fits = p + GRAM <= n
                    _, left, right, hashes = _cut_contexts(data, p[fits])
                    good = hashes == c[i : i + CHUNK][fits]
                    whole = hi[i : i + CHUNK][fits][good] < 0
                    a = np.where(whole, p[fits][good] - left[good], lo[i : i + CHUNK][fits][good])
                    b = np.where(whole, p[fits][good] + GRAM + right[good], hi[i : i + CHUNK][fits][good])
                    np.add.at(change, a, 1)
                    np.add.at(change, b, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
            runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            rows.append((n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes; texts below LEAST bytes lose none. Matches never cross documents.
    Rows that share a doc_id are one document for the order: what starts earlier is what has a smaller
    (doc_id, start); each of them is cut by its own text. Rows without doc_id come after all others.
    What is left may end inside a character. An empty table gives no rows.
    """
    rows = ordered(docs)
    shares = [i / batches for i in range(1, batches)]
    cuts = rows.approxQuantile("doc", shares, 0.001) if shares else []
    bounds = [None, *sorted({int(x) for x in cuts}), None]
    family = IndexFamily(docs.sparkSession)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        batch = rows if a is None else rows.where(F.col("doc") > a)
        family.add(batch if b is None else batch.where(F.col("doc") <= b), last=i == len(bounds) - 2)
    scanned = family.scanned()
    edges = scanned.where("kind IN ('edge', 'both')").select("h", "c", "doc", "pos").distinct()
    wanted = edges.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "pos")).alias("edges"))
    fetched = rows.join(wanted, "doc").select("doc", "text", "edges").mapInArrow(_fetch, CONTEXTS)
    path = write_folder(fetched, "contexts")
    spans = edge_spans(read_folder(docs.sparkSession, path, CONTEXTS), hot)
    whole = scanned.where("kind = 'found'").select("doc", "pos", "c", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    spans = whole.unionByName(spans).groupBy("doc").agg(F.collect_list(F.struct("pos", "c", "lo", "hi")).alias("spans"))
    folder = write_folder(spans, "spans")
    delete_folder(docs.sparkSession, path)
    family.close()
    spans = read_folder(docs.sparkSession, folder, "doc long, spans array<struct<pos:int,c:long,lo:int,hi:int>>")
    cut = rows.join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(
        _remove, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return cut.select(F.when(F.col("doc") < LAST_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


SQL = rf"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, i, md5(substring(x, 2 * i + 1, {2 * LEAST})) AS s
  FROM (SELECT doc_id, x, unnest(range(0, n - {LEAST - 1})) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LEAST}, true) AS new FROM later
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {LEAST} AS b
  FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS stop,
         string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
