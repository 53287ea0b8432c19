"""The trie of conversations against plain dictionaries; the radix tree against sorted lists."""

import hashlib
import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from usagekit.llm import queries, turn_trie
from usagekit.llm.radix_tree import Direct, Indexed, RadixTree, Sorted

TURNS = "conv_id long, turn long, role string, text string, id string, `key` binary, p int"


def brute(rows):
    """Nodes from (conv_id, turn, role, text), by the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = (role or "").encode(), (text or "").encode()
            digest = hashlib.sha256(str(len(role)).encode() + b":" + role + text).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not any(kids[node] for _ in (0,))
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (c[0], len(n), members[n[:-1]][0] if n else -1, len(c), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, c in members.items()
    )


def nodes(df):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", b"y", 1) for r in rows], TURNS).repartition(parts)


def test_small_table_with_every_case(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 71, 72, 1003]:  # some without their base
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bb", "日本", None, ""])))
    rows += [(4, None, "user", "first"), (4, None, "user", "first"), (4, 3, "user", "tie"), (None, 1, "user", "no conversation"), (None, None, None, None)]
    assert nodes(turn_trie.conversation_trie(frame(spark, rows))) == brute(rows)


def test_long_conversations_share_whole_blocks(spark):
    """Beginnings of 64, 128 and more turns in common, conversations that end on a block's last turn, copies, one of 700 turns."""
    texts = [f"turn {i}" for i in range(700)]
    rows = []
    for c, n in enumerate([700, 64, 128, 128, 65, 200, 64, 63, 130, 129, 128, 1, 300, 300, 300]):
        rows += [(c * 5, t, "user", texts[t]) for t in range(n)]
    rows += [(100, t, "user", texts[t] if t != 150 else "other") for t in range(250)]
    assert nodes(turn_trie.conversation_trie(frame(spark, rows))) == brute(rows)


def test_hot_copies_cross_cells_and_batches(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 5) for t in range(3)] + [(c, t, "user", f"own {c}") for c in range(1, 300, 7) for t in range(4)]
    turns = turn_trie.with_heads(*turn_trie.numbered(frame(spark, rows), 4))
    assert nodes(turn_trie.prefix_trie(turns, batch_rows=50)) == brute(rows)


def test_empty_and_turnless(spark):
    assert nodes(turn_trie.conversation_trie(frame(spark, []))) == []
    rows = [(c, 0, "user", "only") for c in range(1, 40) if c % 5]  # no bases: most lose their turn to an absent head
    assert nodes(turn_trie.conversation_trie(frame(spark, rows))) == brute(rows)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op11_turn_trie(spark, sf)) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=5), min_size=1, max_size=40))
def test_tree_holds_the_keys_in_order(keys):
    keys = sorted(keys)
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    found = {}
    for _, depth, first, last in tree.walk():
        prefix = keys[first][:depth]
        found[prefix] = (first, last)
        under = [i for i, k in enumerate(keys) if k[:depth] == prefix]
        assert (under[0], under[-1], len(under)) == (first, last, last - first + 1)
    assert set(keys) <= set(found)


def test_nodes_grow_through_every_layout():
    tree, kinds = RadixTree(), []
    for i in range(256):
        tree.insert(bytes([i, 7]), i)
        kinds.append((type(tree.root.kids), getattr(tree.root.kids, "room", None)))
        assert [b for b, _ in tree.root.kids.items()] == list(range(i + 1))
    assert kinds[3] == (Sorted, 4) and kinds[15] == (Sorted, 16) and kinds[47][0] is Indexed and kinds[48][0] is Direct
