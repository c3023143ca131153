"""The prefix tree against a plain version, with conversations longer than a block, copies and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, d long, heavy string"


def plain_trie(rows):
    """Nodes of rows (conv_id, turn, role, text), in which turns of a conversation differ."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends, kids, parent = defaultdict(list), defaultdict(list), defaultdict(set), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        node = ()
        members[node].append(c)
        for turn in turns:
            up, node = node, (hash(node), len(turns) and turn, len(node) and node[2] + 1 or 1)
            parent[node] = up
            kids[up].add(node)
            members[node].append(c)
        ends[node].append(c)
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=lambda v: -(v[2] if v else 0)):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * (len(node[1][1]) if node else 0)
        if node:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    for node, of in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((of[0], node[2] if node else 0, members[parent[node]][0] if node else None, len(of), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def found(docs):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = prefix_trie.trie(docs).collect()
    assert len({r.node for r in out}) == len(out) and {r.parent for r in out if r.depth} <= {r.node for r in out}
    return sorted(str(tuple(r[c] for c in columns)) for r in out)


def talk(rng, n_convs, n_words):
    """Conversations of few different turns, so that many share prefixes."""
    rows = []
    for c in rng.sample(range(3000), n_convs):
        length = rng.choice([1, 2, 3, 5, 8])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "é" * rng.randint(0, n_words)) for t in range(length)]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_same_as_plain_version(spark, monkeypatch, block):
    """With blocks of three rows every conversation and path is put together from several."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2 if block == 3 else 12)
    rng = random.Random(block)
    rows = talk(rng, 400, 3)
    rows += [(0, t, "user", f"turn {t}") for t in range(40)]  # no other of its family has many turns
    rows += [(c, t, "u", "same") for c in range(5000, 5060) for t in range(12)]  # copies
    rows += [(c, t, "u", "same" if t < c - 6000 else "odd") for c in range(6000, 6030) for t in range(30)]  # a comb
    rows += [(7001, None, "user", "x"), (7001, -5, None, "y"), (7001, 2**62, "user", None), (7100, None, None, None), (None, 1, "user", "lost"), (None, None, None, None)]
    assert found(frame(spark, rows)) == plain_trie(rows)


def test_of_nothing_and_of_one(spark):
    assert prefix_trie.trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).isEmpty()
    assert prefix_trie.trie(frame(spark, [(None, 1, "a", "b")])).isEmpty()
    one = [(5, 1, "user", "hello")]
    assert found(frame(spark, one)) == plain_trie(one)


def test_repeated_rows_and_turns_are_turns_of_their_own(spark):
    rows = [(200, 1, "u", "a")] * 7 + [(200, 1, "u", "b"), (200, None, "u", "c"), (200, None, "u", "c")]
    out = prefix_trie.trie(frame(spark, rows)).select("depth", "n_convs").collect()
    assert sorted(tuple(r) for r in out) == [(d, 1) for d in range(11)]
    again = prefix_trie.trie(frame(spark, rows[::-1])).select("node", "parent")
    assert again.exceptAll(prefix_trie.trie(frame(spark, rows)).select("node", "parent")).isEmpty()


def test_conversation_of_many_turns(spark):
    """20,000 turns, which two conversations share up to the 15,000th: ranks and hashes pass from block to block."""
    turns = spark.range(20_000).withColumnRenamed("id", "turn")
    both = spark.range(2).select((F.col("id") * 100 + 100).alias("conv_id"))
    text = F.when(F.col("turn") < 15_000, F.concat(F.lit("t"), F.pmod("turn", F.lit(7)).cast("string"))).otherwise(F.concat_ws(" ", "conv_id", "turn"))
    rows = turns.join(both).select("conv_id", "turn", F.lit("u").alias("role"), text.alias("text"))
    out = prefix_trie.trie(rows).persist()
    h = [zlib.crc32(str(c).encode()) % 6 for c in (100, 200)]
    assert out.count() == 1 + 15_000 + 2 * 5_000
    got = {r.depth: r for r in out.where("depth in (0, 1, 14999, 15000)").collect()}
    assert [got[d].n_leaves for d in (0, 1, 15000)] == [2, 2, 2] and got[15000].n_children == 2 and h
    assert got[0].saved_tokens == got[1].saved_tokens == 30_000 and got[15000].saved_tokens == 2
    assert out.where("depth = 20000 and n_leaves = 1 and n_convs = 1").count() == 2
    out.unpersist()
