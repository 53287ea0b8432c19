"""Near-dedup by exact Jaccard similarity of word shingles, as a prefix join.

Two sets of n and m shingles with a similarity of at least 0.8 share one of their first n - ceil(0.8 n) + 1
(m - ceil(0.8 m) + 1) members in any order that is the same for all sets. The order here is rare before
common, so passages that many documents have are seldom keys. Sets that share a key are candidates. Sets differ
in at least as many members as the parities of their members, counted in 512 slots, differ in bits: that rules
out most candidates, as many slots as the sets have members (2048 at least) most of the rest, and what is left is
linked only after the whole sets are compared. No pair is lost, and none is added. Only sets that such a pair needs
are ever written or moved: the texts of these are cut again instead.

A key of many sets first gives a star and a chain. What these have not joined is compared where the sets of the
key meet: the largest component is dealt out in tiles, the others come to every tile, and a tile tells only which
components it joined. A large group of near copies never gives its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagekit.llm.common import small_batches, written
from usagekit.llm.components import connected
from usagekit.llm.simhash import Forest, fingerprint, simhash_links

SHINGLE, SEED = 5, 42
# Similarity as a ratio: 4 / 5. Pairs of a key with up to FEW sets are listed at once.
PART, WHOLE, FEW = 4, 5, 32
COMMON, FREQUENT, STRETCH = 32, 1 << 20, 2_000_000  # a shingle is frequent beyond; how many every task may know; how many it counts at once
NEEDED = 1 << 20  # signatures, or documents that have them or are dropped, that are broadcast at most
SENT = 1 << 17  # rows of tiles that are broadcast at most to the sets they need
TILE = 2048  # sets of one component of a key that meet the others of the key in one task
BITS = [f"b{i}" for i in range(8)]  # the parities, 64 to a column
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the word shingles: lower-cased ASCII, words between ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = out * FACTOR + hashes[i : i + len(out)]
        out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SEED) - (1 << 63)


def parities(members: np.ndarray) -> np.ndarray:
    """Per slot whether an odd number of members falls into it, 64 slots to a number.

    There are as many slots as members, rounded up to a power of two, 2048 at least and 2 ** 24 at most: fewer would
    be as odd for two long texts that share nothing as for similar ones.
    """
    slots = min(max(2048, 1 << (len(members) - 1).bit_length()), 1 << 24) if len(members) else 2048
    odd = np.bincount((members >> np.uint64(40)).astype(np.int64) % slots, minlength=slots) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def folded(wide: np.ndarray, width: int = len(BITS)) -> np.ndarray:
    """The parities of 64 ``width`` slots, in the last axis, from those of a multiple."""
    return np.bitwise_xor.reduce(wide.reshape(*wide.shape[:-1], -1, width), axis=-2)


def _rows_of(wide: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(wide), np.uint64).reshape(len(wide), width)


class Parities:
    """The parities of sets of any size. Two sets are compared in the slots of the smaller one."""

    def __init__(self, wide: np.ndarray):
        self.widths = np.fromiter((len(w) // 8 for w in wide), np.int64, len(wide))
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {w: _rows_of(wide[self.widths == w].tolist(), w) for w in np.unique(self.widths).tolist()}
        for width in own:
            larger = [w for w in own if width <= w <= 2 * width]  # sets of similar size have half or twice the slots at most
            place = np.full(len(wide), -1)
            at = np.concatenate([np.flatnonzero(self.widths == w) for w in larger])
            place[at] = np.arange(len(at))
            self.levels[width] = np.concatenate([folded(own[w], width) for w in larger]), place

    def apart(self, i: int, at: np.ndarray) -> np.ndarray:
        """In how many slots the i-th set differs from those at these places, all of a size that can be similar."""
        out, widths = np.zeros(len(at), np.int64), np.minimum(self.widths[at], self.widths[i])
        for width in np.unique(widths).tolist():
            rows, place = self.levels[width]
            here = widths == width
            out[here] = np.bitwise_count(rows[place[at[here]]] ^ rows[place[i]]).sum(1, dtype=np.int64)
        return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many slots the sets of each pair differ."""
    out = np.zeros(len(x), np.int64)
    sizes = np.stack([np.fromiter((len(w) // 8 for w in side), np.int64, len(side)) for side in (x, y)], 1)
    for m, n in np.unique(sizes, axis=0).tolist():
        here, width = (sizes == (m, n)).all(1), min(m, n)
        out[here] = np.bitwise_count(folded(_rows_of(x[here].tolist(), m), width) ^ folded(_rows_of(y[here].tolist(), n), width)).sum(1, dtype=np.int64)
    return out


def _over_texts(docs: DataFrame, read: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch], schema: str, shingle: int, once: bool = False) -> DataFrame:
    """What ``read`` makes of the texts and their sets; ``once``: a task gives a value of the first column once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = read(part, [shingles(t.as_py() or "", shingle) for t in part.column(1)])
                yield out.filter(pa.array([v not in seen and not seen.add(v) for v in out.column(0).to_pylist()], pa.bool_())) if once else out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def signatures(docs: DataFrame, shingle: int, by_fingerprint: bool = False) -> DataFrame:
    """doc_id, sig, fp (the SimHash if asked for), n, the parities of 512 slots (BITS) and of as many as members (wide) of every text."""

    def read(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        wide = [parities(s) for s in sets]
        prints = np.fromiter((fingerprint(t.as_py() or "") if by_fingerprint else 0 for t in batch.column(1)), np.int64, batch.num_rows)
        columns = [batch.column(0), pa.array([signature(s) for s in sets], pa.int64()), pa.array(prints), pa.array([len(s) for s in sets], pa.int32())]
        columns += [*map(pa.array, np.stack([folded(w) for w in wide], 1)), pa.array([w.tobytes() for w in wide], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "sig", "fp", "n", *BITS, "wide"])

    return _over_texts(docs, read, "doc_id long, sig long, fp long, n int, " + ", ".join(f"{c} long" for c in BITS) + ", wide binary", shingle)


def needed_sets(docs: DataFrame, rows: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """sig, members (sorted, 8 bytes each) for each ``needed`` signature (sig). ``rows``: doc_id, sig of all texts.

    Up to NEEDED signatures are broadcast, and so is one document of each: only their texts are cut, and no set
    leaves its task. Then a set may come more than once where a doc_id repeats or is null. Beyond, all texts are cut.
    """

    def read(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["sig", "members"])

    needed = written(needed.select("sig").distinct(), "needed")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = needed.count() <= NEEDED
    if few:
        needed = F.broadcast(needed)
        have = rows.join(needed, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
        one = F.broadcast(have.select("doc_id").distinct())
        docs = docs.where("doc_id IS NOT NULL").join(one, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    sets = _over_texts(docs, read, "sig long, members binary", shingle, once=True)
    sets = sets.join(needed, "sig", "left_semi")
    return written(sets if few else sets.dropDuplicates(["sig"]), "shingle-sets")


def _with_members(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of tiles with the members of their set, dealt by tile: members move once, with up to SENT rows."""
    if tiles.count() <= SENT:
        tiles = F.broadcast(tiles)
    return tiles.join(sets, "sig").select(*tiles.columns, "members").repartition("tile").sortWithinPartitions("tile", "sig")


def _frequent(docs: DataFrame, shingle: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, ascending, and their counts: ``most`` at most, the most frequent ones.

    A stretch of texts names the shingles that occur in two of its texts or more; their counts are summed. What a
    table of bounded size leaves out, and what no stretch saw twice, counts as rare: that moves keys, never links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            seen, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            many = times > 1
            return pa.RecordBatch.from_arrays([pa.array(seen[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py() or "", shingle))
                size += len(held[-1])
                if size > STRETCH:
                    yield flush()
                    size = 0
        yield flush()

    seen = docs.select(F.col("text").cast("string")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    seen = written(seen, "frequent")
    # counts by class: some dozens of rows
    class_, taken, least = F.floor(F.log2("n") * 4).cast("int"), 0, None
    for r in seen.groupBy(class_.alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect():
        if (taken := taken + r["n"]) > most:
            break
        least = r["class"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = seen.where(class_ >= least).toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy()[order]


def _keys(docs: DataFrame, shingle: int) -> DataFrame:
    """key, sig, n: the first members of each set."""
    known, counts = _frequent(docs, shingle)

    def read(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, firsts = [np.zeros(0, np.uint64)], []
        for s in sets:
            first = len(s) - -(-PART * len(s) // WHOLE) + 1 if len(s) else 0
            rank = np.zeros(len(s), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                rank = np.where(known[place] == s, counts[place], 0)
            keys.append(s[np.argsort(rank, kind="stable")[:first]])
            firsts.append(first)
        columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array([signature(s) for s in sets], np.int64), firsts), np.repeat(np.array([len(s) for s in sets], np.int32), firsts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sig", "n"])

    return _over_texts(docs, read, "key long, sig long, n int", shingle)


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return WHOLE * np.minimum(n, m) >= PART * np.maximum(n, m)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows of one key after another, from batches sorted by key; keys of one row are left out."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
        ends = np.append(starts[1:], batch.num_rows)
        if held and held[0][0][0] != columns[0][0]:
            if sum(len(h[0]) for h in held) > 1:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        for i in ([0] if len(starts) > 1 and held else []):
            held.append([c[: ends[i]] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
            starts, ends = starts[1:], ends[1:]
        for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if b - a > 1:
                yield [c[a:b] for c in columns]
        held.append([c[starts[-1] :] for c in columns])
    if held and sum(len(h[0]) for h in held) > 1:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _candidates(few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, sig, n, other: pairs (key null) of keys with few sets; star, chain and members (other null) of the rest."""
    names = ["key", "sig", "n", "other"]

    def flush(kept: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
        kept.clear()
        masks = [columns[4], None, None, ~columns[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, masks, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for key, sig, n in _runs(batches):
            _, first = np.unique(sig, return_index=True)
            first.sort()
            key, sig, n = key[first], sig[first], n[first]
            if len(sig) < 2:
                continue
            if len(sig) <= few:
                a, b = np.triu_indices(len(sig), 1)
            else:
                rest = np.arange(1, len(sig))
                a, b = np.append(np.zeros_like(rest), rest[1:] - 1), np.append(rest, rest[1:])
                kept.append((key, sig, n, sig, np.zeros(len(sig), bool)))
                rows += len(sig)
            fit = _alike(n[a], n[b])
            a, b = a[fit], b[fit]
            kept.append((key[a], np.minimum(sig[a], sig[b]), n[a], np.maximum(sig[a], sig[b]), np.ones(len(a), bool)))
            rows += len(a)
            if rows > 50_000:
                yield flush(kept)
                rows = 0
        if kept:
            yield flush(kept)

    return run


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared * (PART + WHOLE) >= PART * (len(x) + len(y))


def _partners(sig: np.ndarray, n: np.ndarray, wide: Parities, root: np.ndarray, rest: np.ndarray, part: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per set of the rest in a tile: the tile's own sets, and those of the rest that this tile pairs it with, that it may be similar to.

    ``root`` may change between two sets: sets of one component are never compared.
    """
    deal = sig % parts
    for i in np.flatnonzero(rest).tolist():
        other = root != root[i]
        other &= ~rest | ((deal + deal[i]) % parts == part)
        other &= _alike(n[i], n)
        at = np.flatnonzero(other)
        yield i, at[(PART + WHOLE) * wide.apart(i, at) <= (WHOLE - PART) * (n[at].astype(np.int64) + int(n[i]))]


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tile, sig: the sets of a tile that may be similar to one of another component, each once."""
    for tile, sig, n, root, rest, part, parts, wide in _runs(batches):
        marked = np.zeros(len(sig), bool)
        root = np.unique(root, return_inverse=True)[1]
        for i, at in _partners(sig, n, Parities(wide), root, rest.astype(bool), int(part[0]), int(parts[0])):
            marked[at] = True
            marked[i] |= len(at) > 0
        yield pa.RecordBatch.from_arrays([pa.array(tile[marked]), pa.array(sig[marked])], names=["tile", "sig"])


def _each_set_once(run: list[np.ndarray]) -> list[np.ndarray]:
    """A run of tile, sig, ... that is sorted by sig, without the rows that repeat one."""
    new = np.append(True, run[1][1:] != run[1][:-1])
    return [c[new] for c in run]


def _join_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: roots that are joined, from the tiles of the keys one after the other; each join once in a task.

    The sets of the rest are taken one after the other; a component that one of them has joined is not looked at again.
    """
    forest = Forest()
    for _, sig, n, root, rest, part, parts, wide, members in map(_each_set_once, _runs(batches)):
        roots, own = np.unique(np.array([forest.root(r) for r in root.tolist()], np.int64), return_inverse=True)
        sets = [np.frombuffer(m, np.uint64) for m in members.tolist()]
        for i, at in _partners(sig, n, Parities(wide), own, rest.astype(bool), int(part[0]), int(parts[0])):
            for j in at.tolist():
                if own[i] != own[j] and _similar(sets[i], sets[j]):
                    forest.join(int(roots[own[i]]), int(roots[own[j]]))
                    own[own == own[i]] = own[j]
        if len(forest.up) > 65_536:
            yield forest.edges()
            forest = Forest()
    yield forest.edges()


def _join_keys(many: DataFrame, prints: DataFrame, labels: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b: roots of components that sets of one key join. ``many``: key, sig of the keys of many sets."""
    rows = many.join(labels, F.col("sig") == labels["vertex"], "left").select("key", "sig", F.coalesce("label", "sig").alias("root"))
    rows = written(rows, "key-roots")
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    # Keys with the same sets, as passages have them, are one: told by their number and two hashes of the sets.
    same = rows.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("sig")).alias("one"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("two"))
    first = same.groupBy("sets", "one", "two").agg(F.min("key").alias("key")).select("key")
    keys = keys.join(first, "key", "left_semi")
    keys = keys.select("key", F.col("top.root").alias("main"), F.ceil(F.col("top.size") / TILE).cast("int").alias("parts"))
    rows = rows.join(keys, "key").withColumn("rest", F.col("root") != F.col("main"))
    mine = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))))
    rows = rows.join(prints.select("sig", "n", "wide"), "sig")
    rows = written(rows.select(F.xxhash64("key", "part").alias("tile"), "sig", "n", "root", "rest", "part", "parts", "wide"), "tiles")
    # Members go only to tiles where their parities leave a partner in another component.
    dealt = rows.repartition("tile").sortWithinPartitions("tile", "sig")
    suspects = written(dealt.mapInArrow(_suspects, "tile long, sig long"), "suspects")
    rows = written(rows.join(suspects, ["tile", "sig"], "left_semi").select("tile", "sig", "n", "root", "rest", "part", "parts", "wide"), "suspect-tiles")
    return _with_members(rows, sets_of(suspects)).mapInArrow(_join_tiles, "a long, b long")


def _likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities do not rule them out."""
    side = lambda key, mark: prints.select(F.col("sig").alias(key), F.col("n").alias(f"n{mark}"), *[F.col(c).alias(f"{c}{mark}") for c in BITS])
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    apart = sum((F.bit_count(F.col(f"{c}x").bitwiseXOR(F.col(f"{c}y"))) for c in BITS), F.lit(0))
    return both.where(apart * (PART + WHOLE) <= (WHOLE - PART) * (F.col("nx") + F.col("ny"))).select("a", "b")


def _pruned(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) that the wide parities do not rule out either."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)))
            yield batch.select([0, 1]).filter(pa.array((PART + WHOLE) * apart <= (WHOLE - PART) * batch.column(4).to_numpy().astype(np.int64)))

    side = lambda key, mark: prints.select(F.col("sig").alias(key), F.col("wide").alias(mark), F.col("n").alias(f"n{mark}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n")).mapInArrow(prune, "a long, b long")


def _verify_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: sets of a tile that are joined by pairs whose whole sets are similar enough."""
    for _, sig, partners, members in map(_each_set_once, _runs(batches)):
        forest, place = Forest(), {s: i for i, s in enumerate(sig.tolist())}
        sets = [np.frombuffer(m, np.uint64) for m in members.tolist()]
        for i, (own, others) in enumerate(zip(sig.tolist(), partners, strict=True)):
            for other in others.tolist():
                if forest.root(own) != forest.root(other) and _similar(sets[i], sets[place[other]]):
                    forest.join(own, other)
        yield forest.edges()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: edges that join the same sets as the pairs whose whole sets are similar enough.

    The sets that pairs hold together meet in one tile, so that a set moves once and not once per pair. Of over
    TILE such sets, each two blocks are a tile, to which go the sets that have a pair there.
    """
    labels = connected(pairs)  # the root of a component has no row
    labels = labels.unionByName(labels.select(F.col("label").alias("vertex"), "label").distinct())
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    blocks = labels.join(sizes, "label").select("vertex", "label", F.pmod(F.xxhash64("vertex"), F.col("parts")).alias("block"))
    dealt = pairs.join(blocks.select(F.col("vertex").alias("a"), "label", F.col("block").alias("x")), "a")
    dealt = dealt.join(blocks.select(F.col("vertex").alias("b"), F.col("block").alias("y")), "b")
    dealt = dealt.select(F.xxhash64("label", F.least("x", "y"), F.greatest("x", "y")).alias("tile"), "a", "b")
    rows = dealt.select("tile", F.col("a").alias("sig"), F.col("b").alias("other"))
    rows = rows.unionByName(dealt.select("tile", F.col("b").alias("sig"), F.lit(None).cast("long").alias("other")))
    rows = written(rows.groupBy("tile", "sig").agg(F.collect_list("other").alias("partners")), "pair-tiles")
    return _with_members(rows, sets).mapInArrow(_verify_tiles, "a long, b long")


def _links_of_prints(texts: DataFrame) -> DataFrame:
    """a, b: signatures that are joined by fingerprints at most 3 bits apart. ``texts``: sig, fp of all texts.

    A fingerprint stands for itself in the search, so documents that share a doc_id are not joined by it. It is
    known by its smallest signature, to which the others that have it are linked.
    """
    texts = written(texts.distinct(), "prints")
    named = written(texts.groupBy("fp").agg(F.min("sig").alias("own")), "named-prints")
    links = simhash_links(named.select("fp", F.col("fp").alias("id")))
    links = links.join(named.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    same = texts.join(named, "fp").where("sig <> own").select(F.col("sig").alias("a"), F.col("own").alias("b"))
    return written(links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same), "print-links")


def shingle_groups(docs: DataFrame, shingle: int = SHINGLE, few: int = FEW, by_fingerprint: bool = False) -> DataFrame:
    """doc_id, component_id for every row of ``docs`` (doc_id, text).

    Texts link where the Jaccard similarity of their sets of word shingles is at least 0.8, texts without
    words with each other; ``by_fingerprint`` also where the SimHash operator links them (fingerprints at most
    3 bits apart). component_id is the smallest doc_id reachable. Rows without doc_id take part.
    """
    small_batches(docs.sparkSession)
    rows = written(signatures(docs, shingle, by_fingerprint), "signatures")
    prints = written(rows.drop("doc_id", "fp").dropDuplicates(["sig"]), "parities")
    texts, rows = rows.select("sig", "fp"), rows.select("doc_id", "sig")
    dealt = _keys(docs, shingle).repartition("key").sortWithinPartitions("key", "n", "sig")
    found = written(dealt.mapInArrow(_candidates(few), "key long, sig long, n int, other long"), "candidates")
    pairs = found.where("other IS NOT NULL").select(F.col("sig").alias("a"), F.col("other").alias("b")).distinct()
    pairs = written(_likely(pairs, prints), "pairs")
    pairs = written(_pruned(pairs, prints), "pruned")
    sets = needed_sets(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("sig")), shingle)
    labels = connected(written(_verified(pairs, sets), "near-edges"))
    more = [_links_of_prints(texts)] if by_fingerprint else []
    many = found.where("other IS NULL").select("key", "sig")
    if not many.isEmpty():
        more.append(written(_join_keys(many, prints, labels, lambda needed: needed_sets(docs, rows, needed, shingle)), "key-edges"))
    if more:
        edges = labels.select(F.col("vertex").alias("a"), F.col("label").alias("b"))
        labels = connected(reduce(DataFrame.unionByName, more, edges))
    rows = rows.join(labels, F.col("sig") == labels["vertex"], "left").select("doc_id", F.coalesce("label", "sig").alias("_root"))
    least = rows.groupBy("_root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "_root").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, by_fingerprint: bool = False) -> DataFrame:
    """The document with the smallest doc_id of each group, all its columns; documents without doc_id stay.

    No text moves: the documents that go are broadcast, up to NEEDED; more are joined by a shuffle.
    """
    groups = shingle_groups(docs, shingle, by_fingerprint=by_fingerprint).where("doc_id IS NOT NULL")
    gone = groups.groupBy(F.col("doc_id").alias("_gone")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_kept"))
    gone = written(gone.where("NOT _kept").select("_gone"), "near-copies")
    if gone.count() <= NEEDED:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
