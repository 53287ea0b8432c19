"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes of a digest of role and text, so a conversation is a byte string, and its prefixes of
whole turns are the byte depths divisible by 16. Conversations are cut into blocks of 64 turns: a row is at most
1 KiB, however long the conversation, and blocks with the same turns before them form one group. The rows of all
groups are sorted into cells; a task reads its cells in order and builds a radix tree per stretch of rows.

Because rows are sorted, what a node counts is a sum over its members of numbers that each conversation knows
from its two neighbours in the order (the turns it shares with the one before, whether the one after goes on where
it ends). So parts of a node that come from different trees add up, and a prefix that most conversations share is
counted by as many tasks as its rows fill. Of the end of a cell the next one needs a single key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagekit.llm.common import materialize, text_or_empty
from usagekit.llm.radix_tree import RadixTree, shared_length

WIDTH, BLOCK, BATCH, CHUNK, SALTS = 16, 64, 20_000, 4096, 64
LANES = 4
SORT = ["block", "prefix", "key", "more", "conv_id"]
PARTS = (
    "kind int, depth long, node binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
    "digest string, chunk string"
)
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- turns in order, and the conversations rebuilt from them -----------------------------------


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (32 hex digits), bytes of the text; null role and text count as empty, rows without conv_id are left out."""
    role, text = text_or_empty("role"), text_or_empty("text")
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def numbered(conversations: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, i from 1, id, bytes) by turn, null first, equal turns by id; and (conv_id, n) of every conversation.

    Turns are sorted into cells over all conversations, so one that holds most turns is numbered in as many windows.
    """
    turns = materialize(turn_ids(conversations), "turns")
    turns = materialize(turns.repartitionByRange(cells, "conv_id", "turn", "id").withColumn("_cell", F.spark_partition_id()), "turn-cells")
    parts = turns.groupBy("conv_id", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    within = Window.partitionBy("conv_id", "_cell").orderBy("turn", "id")
    rows = turns.withColumn("_at", F.row_number().over(within)).join(parts, ["conv_id", "_cell"])
    rows = rows.select("conv_id", (F.col("_before") + F.col("_at")).alias("i"), "id", "bytes")
    return materialize(rows, "numbered"), parts.groupBy("conv_id").agg(F.sum("_n").alias("n"))


def with_heads(turns: DataFrame, sizes: DataFrame, fan: int = 5, most: int = 9) -> DataFrame:
    """conv_id, p from 0, id, bytes, n (turns in all): conversations whose first turns come from another one.

    The first h turns of conversation c - c % ``fan`` (all if it has fewer), then the own turns of c after its first
    h; h = CRC-32 of the decimal c, modulo ``most``. A conversation without any turn left has one row with p, id null.
    Turns of one conversation meet its one row of sizes in parts of 4096.
    """
    convs = sizes.select(
        "conv_id", F.col("n").alias("own"), (F.col("conv_id") - F.col("conv_id") % fan).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"),
    )
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = convs.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.withColumn("n", F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    size = 4096
    dealt = convs.select("conv_id", "h", "head", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / size))).alias("part"))
    own = turns.withColumn("part", F.floor(F.col("i") / size)).join(dealt, ["conv_id", "part"]).where("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("head") - 1).alias("p"), "id", "bytes", "n")
    first = turns.where((F.col("i") < most) & (F.col("conv_id") % fan == 0)).select(F.col("conv_id").alias("base"), "i", "id", "bytes")
    heads = convs.where("head > 0").join(first, "base").where("i <= head").select("conv_id", (F.col("i") - 1).alias("p"), "id", "bytes", "n")
    none = convs.where("n = 0").select("conv_id", F.lit(None).cast("long").alias("p"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("bytes"), "n")
    return own.unionByName(heads).unionByName(none)


# ---- blocks of turns as byte keys ----------------------------------------------------------------


def lanes_of(block: Column, ids: Column) -> list[Column]:
    """Four 32-bit numbers of a block's place and turns. Their sums over the blocks before name a prefix of blocks."""
    digest = F.sha2(F.concat(block.cast("string"), F.lit(":"), ids).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)]


def next_prefix(prefix: str, block: int, key: bytes) -> str:
    """The prefix of the block that follows a whole one; the same as the running sums of ``lanes_of``."""
    digest = hashlib.sha256(f"{block}:{key.hex()}".encode()).hexdigest()
    before = [int(prefix[8 * i : 8 * i + 8] or "0", 16) for i in range(LANES)]
    return "".join(f"{(before[i] + int(digest[8 * i : 8 * i + 8], 16)) % (1 << 32):08x}" for i in range(LANES))


def _before(rows: DataFrame, names: list[str], after: bool = False, part: int = 1024) -> DataFrame:
    """Per conversation the sums of ``names`` over the blocks before (after) each; windows of ``part`` blocks, then of parts."""
    order = lambda c: F.col(c).desc() if after else F.col(c)
    rows = rows.withColumn("_part", F.floor(F.col("block") / part))
    sums = rows.groupBy("conv_id", "_part").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    outer = Window.partitionBy("conv_id").orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "_part", *[F.coalesce(F.sum(f"_{c}").over(outer), F.lit(0)).alias(f"_{c}") for c in names])
    inner = Window.partitionBy("conv_id", "_part").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "_part", "block", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(c) for c in names])
    return rows.join(sums, ["conv_id", "_part"]).select("conv_id", "block", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names])


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv_id, block, prefix (hex), key, sizes, more (0: the conversation ends in this block), many (of its blocks)."""
    turn = F.when(F.col("p").isNotNull(), F.struct("p", "id", "bytes"))  # collect_list leaves nulls out
    rows = turns.groupBy("conv_id", F.coalesce(F.floor(F.col("p") / BLOCK), F.lit(0)).cast("long").alias("block"))
    rows = rows.agg(F.sort_array(F.collect_list(turn)).alias("t"), F.max("n").alias("n"))  # BLOCK turns at most
    rows = rows.select(
        "conv_id", "block", F.array_join(F.col("t.id"), "").alias("ids"), F.col("t.bytes").alias("sizes"),
        (F.col("n") > (F.col("block") + 1) * BLOCK).cast("int").alias("more"), (F.col("n") > BLOCK).alias("many"),
    )
    rows = materialize(rows, "blocks")
    names = [f"l{i}" for i in range(LANES)]
    lanes = lanes_of(F.col("block"), F.col("ids"))
    sums = _before(rows.where("many").select("conv_id", "block", *[c.alias(n) for c, n in zip(lanes, names, strict=True)]), names)
    prefix = F.concat(*[F.lpad(F.lower(F.hex(F.col(c) % (1 << 32))), 8, "0") for c in names])
    sums = sums.where("block > 0").select("conv_id", "block", prefix.alias("prefix"))
    single = rows.where("block = 0").withColumn("prefix", F.lit(""))
    rows = single.unionByName(rows.where("block > 0").join(sums, ["conv_id", "block"]))
    return rows.select("conv_id", "block", "prefix", F.unhex("ids").alias("key"), "sizes", "more", "many")


# ---- sorted cells and what neighbours share ------------------------------------------------------


def _sorted_cells(rows: DataFrame, cells: int) -> tuple[DataFrame, dict[int, tuple]]:
    """The rows with their cell, and per cell the (block, prefix, key) before its first and after its last row.

    The keys come to the driver: two rows of 1 KiB at most for each of ``cells`` cells, whatever the data.
    """
    rows = materialize(rows.repartitionByRange(cells, *SORT).withColumn("cell", F.spark_partition_id()), "trie-cells")
    place = F.struct("block", "prefix", "key")
    ends = sorted(tuple(r) for r in rows.groupBy("cell").agg(F.min(place), F.max(place)).collect())
    key = lambda r: (r[0], r[1], bytes(r[2]))
    around = {
        cell: (key(ends[i - 1][2]) if i else None, key(ends[i + 1][1]) if i + 1 < len(ends) else None) for i, (cell, _, _) in enumerate(ends)
    }
    return rows, around


class Rows:
    """A cell's rows in order, with what each shares with its neighbours: a stretch at a time."""

    def __init__(self, around: dict[int, tuple], columns: list[str]):
        self.around, self.columns = around, columns

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row, shared, ends, opens, closes): turns shared with the row before (-1: the first of its group); whether
        nothing after it goes on where it ends; whether its key stands in the cell before, or in the next one."""
        held, before, cell = None, None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in self.columns), strict=True):
                row = dict(zip(self.columns, row, strict=True))
                place = (row["block"], row["prefix"], row["key"])
                if held is not None:
                    yield self._told(held, before, place if row["cell"] == cell else self.around[cell][1])
                if row["cell"] != cell:
                    cell, before = row["cell"], self.around[row["cell"]][0]
                else:
                    before = (held["block"], held["prefix"], held["key"])
                held = row
        if held is not None:
            yield self._told(held, before, self.around[cell][1])

    def _told(self, row: dict, before: tuple | None, after: tuple | None) -> tuple:
        group, key = (row["block"], row["prefix"]), row["key"]
        shared = shared_length(before[2], key) // WIDTH if before is not None and before[:2] == group else -1
        goes_on = after is not None and after[:2] == group and after[2][: len(key)] == key
        border = self.around[row["cell"]]
        here = (*group, key)
        return row, shared, not row["more"] and not goes_on, border[0] == here, border[1] == here


def _stream(rows: DataFrame, cells: int) -> DataFrame:
    return rows.repartition(cells, "cell").sortWithinPartitions("cell", *SORT)


def _tails(rows: DataFrame, cells: int) -> DataFrame:
    """conv_id, block, tail_leaves, tail_saved: what lies in later blocks of a conversation of many."""
    later, around = _sorted_cells(rows.where("block > 0").drop("many"), cells)
    columns = ["cell", "block", "prefix", "key", "more", "conv_id", "sizes"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            done = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(done, names=["conv_id", "block", "leaves", "saved"])

        for row, shared, ends, _, _ in Rows(around, columns).read(batches):
            out.append((row["conv_id"], row["block"], int(ends), sum(row["sizes"][: max(shared, 0)])))
            if len(out) >= BATCH:
                yield flush()
        yield flush()

    told = _stream(later.select(columns), cells).mapInArrow(tell, "conv_id long, block long, leaves long, saved long")
    first = rows.where("many AND block = 0").select("conv_id", "block", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    told = materialize(told.unionByName(first), "tails")
    return _before(told, ["leaves", "saved"], after=True).select("conv_id", "block", F.col("leaves").alias("tail_leaves"), F.col("saved").alias("tail_saved"))


# ---- the trees -------------------------------------------------------------------------------------


def node_id(block: int, prefix: str, key: bytes) -> bytes:
    """16 bytes that name the prefix ``key`` of a block; a whole block is the root of the next one's group."""
    if len(key) == WIDTH * BLOCK:
        block, prefix, key = block + 1, next_prefix(prefix, block, key), b""
    return hashlib.blake2b(f"{block}:{prefix}:".encode() + key, digest_size=16).digest()


def tree_nodes(group: tuple[int, str], members: list[tuple]) -> Iterator[tuple]:
    """Parts of the nodes of a stretch of one group: depth, node, parent, conv_id, n_convs, n_children, n_leaves, saved.

    ``members`` in order: (key, conv_id, sizes, shared, leaves, saved in later blocks). Of the saved bytes of a node
    at depth d a member adds those of its turns d to ``shared``; only the node's first member shares less.
    """
    tree = RadixTree()
    leaves, later, upto, convs = [0], [0], [0], []
    totals = []  # bytes of the first turns of each member
    for i, (key, conv_id, sizes, shared, leaf, saved) in enumerate(members):
        tree.insert(key, i)
        sums = [0]
        for n in sizes:
            sums.append(sums[-1] + n)
        totals.append(sums)
        leaves.append(leaves[-1] + leaf)
        later.append(later[-1] + saved)
        upto.append(upto[-1] + sums[max(shared, 0)])
        convs.append(conv_id)
    block, prefix = group
    out: list[list] = []
    path: list[int] = []  # places in ``out`` of the nodes above, by depth
    for above, below, first, last in tree.walk():
        # byte depths on this node's way that are whole turns
        for depth in range(above // WIDTH + 1 if below else 0, below // WIDTH + 1):
            key, _, _, shared, _, _ = members[first]
            new = shared < depth or shared < 0
            known = upto[last + 1] - upto[first] - (totals[first][max(shared, 0)] if new else 0)
            above_bytes = totals[first][depth - 1] if depth else 0
            saved = known - (last - first + 1 - new) * above_bytes + later[last + 1] - later[first]
            del path[depth:]
            if depth:
                out[path[-1]][5] += new  # a child that the rows before did not have
            path.append(len(out))
            parent = node_id(block, prefix, key[: WIDTH * (depth - 1)]) if depth else None
            row = [BLOCK * block + depth, node_id(block, prefix, key[: WIDTH * depth]), parent, min(convs[first : last + 1]), last - first + 1, 0, leaves[last + 1] - leaves[first], saved]
            if not depth and block:  # counted in the block before; only the children are new
                row[2:5], row[6:] = [None, None, 0], [0, 0]
            out.append(row)
    yield from map(tuple, out)


def _trees(around: dict[int, tuple], batch_rows: int):
    columns = ["cell", "block", "prefix", "key", "more", "conv_id", "sizes", "tail_leaves", "tail_saved"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.string()]
    names = ["kind", "depth", "node", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "digest", "chunk"]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            done = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types, strict=True)], names=names)

        def end(run: dict) -> None:
            """The members that end at one node: their digest, or their ids where other cells have some too."""
            if run["open"]:
                put_ids(run)
            else:
                run["hash"].update(",".join(run["ids"]).encode())
                out.append((1, None, run["node"], None, None, None, None, None, None, run["hash"].hexdigest(), None))

        def put_ids(run: dict) -> None:
            if run["ids"]:
                out.append((2, None, run["node"], None, int(run["ids"][0]), None, None, None, None, None, ",".join(run["ids"])))
                run["ids"] = []

        group, members, run = None, [], None
        for row, shared, ends, opens, closes in Rows(around, columns).read(batches):
            own = (row["block"], row["prefix"])
            if members and (own != group or len(members) >= batch_rows):
                out.extend((0, *part, None, None) for part in tree_nodes(group, members))
                members = []
                if len(out) >= BATCH:
                    yield flush()
            group = own
            leaves = row["tail_leaves"] if row["more"] else int(ends)
            members.append((row["key"], row["conv_id"], row["sizes"], shared, leaves, row["tail_saved"]))
            if not row["more"]:
                place = (*own, row["key"])
                if run is None or run["place"] != place or run["cell"] != row["cell"]:
                    if run is not None:
                        end(run)
                    run = {"place": place, "cell": row["cell"], "node": node_id(*place), "open": opens or closes, "ids": [], "hash": hashlib.sha256()}
                run["ids"].append(str(row["conv_id"]))
                if len(run["ids"]) >= CHUNK:
                    if run["open"]:
                        put_ids(run)
                    else:
                        run["hash"].update((",".join(run["ids"]) + ",").encode())
                        run["ids"] = []
        if members:
            out.extend((0, *part, None, None) for part in tree_nodes(group, members))
        if run is not None:
            end(run)
        yield flush()

    return columns, grow


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, digest from chunks of ids sorted by node and first id."""
    node, state, done = None, None, []
    for batch in batches:
        for key, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(chunk.encode())
    if state is not None:
        done.append((node, state.hexdigest()))
    columns = list(zip(*done, strict=True)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["node", "digest"])


def prefix_trie(turns: DataFrame, batch_rows: int = BATCH) -> DataFrame:
    """One row per node of the trie over the conversations ``turns`` (conv_id, p from 0, id, bytes, n; p null: none).

    conv_id (smallest member), depth, parent_conv_id (of the root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A node is a distinct sequence of first turns; members begin with it. No conversations give no nodes.
    The ids of members that end at one node are hashed in order by one task, as one SHA-256 must be; it reads them
    as chunks of 4096 ids that other tasks wrote, and only for nodes whose ids lie in more than one cell.
    """
    spark = turns.sparkSession
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(blocks_of(turns), "keys")
    later = _tails(rows, cells) if not rows.where("many").isEmpty() else None
    zero = F.lit(0).cast("long")
    if later is None:
        rows = rows.withColumn("tail_leaves", zero).withColumn("tail_saved", zero)
    else:
        single = rows.where("NOT many").withColumn("tail_leaves", zero).withColumn("tail_saved", zero)
        rows = single.unionByName(rows.where("many").join(later, ["conv_id", "block"]).select(single.columns))
    rows, around = _sorted_cells(rows.drop("many"), cells)
    columns, grow = _trees(around, batch_rows)
    parts = materialize(_stream(rows.select(columns), cells).mapInArrow(grow, PARTS), "trie-parts")

    nodes = parts.where("kind = 0").groupBy("node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    nodes = materialize(nodes, "trie-nodes")
    whole = parts.where("kind = 1").select("node", "digest")
    chunks = parts.where("kind = 2").select("node", "chunk", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = whole.unionByName(chunks.select("node", "chunk").mapInArrow(_digests, "node binary, digest string"))
    # Children of one node meet it in up to SALTS parts.
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    child = nodes.where("parent IS NOT NULL").withColumn("salt", salt)
    wanted = child.select("parent", "salt").distinct()
    above = wanted.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    known = child.join(above, ["parent", "salt"]).drop("salt").unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return known.join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text); see ``with_heads`` and ``prefix_trie``.

    Rows without conv_id belong to no conversation. Null turns come first; equal turns of a conversation are ordered by
    a digest of role and text, so repeated rows are turns of their own. c % 5 keeps the sign of a negative c.
    """
    cells = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prefix_trie(with_heads(*numbered(conversations, cells)))


SQL = r"""
WITH RECURSIVE bits(n, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY n) AS places FROM bits WHERE k = 8
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i, id, bytes FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id
    FROM conversations WHERE conv_id IS NOT NULL)
), sizes AS (
  SELECT conv_id, count(*) AS own FROM turns GROUP BY 1
), convs AS (
  SELECT s.conv_id, s.own, least(h, coalesce(b.own, 0)) AS head, h, s.conv_id - s.conv_id % 5 AS base FROM (
    SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                lambda a, b: xor(a >> 8, places[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM sizes, crc) s
  LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5
), rebuilt AS (
  SELECT conv_id AS c, head + i - h AS d, id, bytes FROM turns JOIN convs USING (conv_id) WHERE i > h
  UNION ALL
  SELECT c.conv_id, i, id, bytes FROM convs c JOIN turns t ON t.conv_id = base AND i <= head
), member AS (
  SELECT c, d, bytes, string_agg(id, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, left(path, greatest(0, length(path) - 64)) AS up FROM member GROUP BY path, d
), child AS (
  SELECT up, count(*) AS n FROM node WHERE d > 0 GROUP BY up
), below AS (
  SELECT r.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((m.n_convs - 1) * m.bytes)::BIGINT AS saved
  FROM node m LEFT JOIN child k ON k.up = m.path JOIN member r ON r.c = m.conv_id AND r.d <= m.d GROUP BY r.path
), ends AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest FROM (
    SELECT c, d, path, max(d) OVER (PARTITION BY c) AS last FROM member) WHERE d = last GROUP BY path
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, n_leaves, saved AS saved_tokens,
       coalesce(digest, sha256('')) AS ends_sha256
FROM node n JOIN below USING (path) LEFT JOIN node p ON p.path = n.up AND n.d > 0 LEFT JOIN child k ON k.up = n.path LEFT JOIN ends e ON e.path = n.path
"""
