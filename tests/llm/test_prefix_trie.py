"""The trie against one built turn by turn, in one block and in many."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie as trie
from tests.oracle import DATA

COLS = "conv_id long, turn long, role string, text string, conv string, key int, block int, words string, n int"


def brute(convs):
    """Nodes of {conv: [(role, text)]}, by walking every conversation down from the root."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out, below = {}, {}
    for path in nodes:
        if path:
            below.setdefault(path[:-1], []).append(path)
    for path in sorted(nodes, key=len, reverse=True):
        members, kids = nodes[path], below.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves = sum(out[k][5] for k in kids) if kids else 1
        saved = (len(members) - 1) * words + sum(out[k][6] for k in kids)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out[path] = (min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def given(rows):
    """Conversations of rows as the operator orders them."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], (role, text)))
    return {c: [x[-1] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in convs.items()}


def mixed(convs):
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: convs.get(c - c % 20, [])[: h(c)] + turns[h(c) :] for c, turns in convs.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "w", 3) for r in rows], COLS)


def nodes_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(rng, convs, letters, most):
    return [(c, t, rng.choice(["user", "bot"][: rng.randint(1, 2)]), " ".join(rng.choices(letters, k=rng.randint(0, 2)))) for c in convs for t in range(rng.randint(0, most))]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.sample(range(400), 150), "abc"[: 1 + seed], 7)
    rows += [(5000 + i, t, "user", "same words here") for i in range(40) for t in range(3)]  # copies
    rows += [(6000, t, "user", "long " * (t % 3)) for t in range(300)] + [(6001, t, "user", "long " * (t % 3)) for t in range(280)]
    rows += [(None, 1, "user", "lost"), (7001, None, "user", "b"), (7001, None, "user", "a"), (7001, 3, None, None), (7001, 3, None, None), (7002, 1, "", "")]
    rng.shuffle(rows)
    turns = frame(spark, rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small blocks
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        convs = trie.conversations(turns)
        for parts in ("2", "40") if seed == 1 else ("9",):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert nodes_of(trie.prefix_trie(convs)) == brute(given(rows))
        if seed == 2:
            assert nodes_of(trie.prefix_trie(trie.rebuilt(convs))) == brute(mixed(given(rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_few_conversations(spark):
    assert trie.prefix_trie(trie.conversations(frame(spark, []))).count() == 0
    for rows in ([(3, 0, "u", "a b")], [(3, 0, "u", "a"), (4, 0, "u", "b")], [(3, 0, None, None), (3, 1, "", ""), (9, 0, "", None)], [(1, 1, "u", "z " * 60_000), (2, 1, "u", "z " * 60_000)]):
        assert nodes_of(trie.prefix_trie(trie.conversations(frame(spark, rows)))) == brute(given(rows))


def test_conversation_without_turns(spark):
    convs = trie.conversations(frame(spark, [(1, 0, "u", "a"), (2, 0, "u", "b")])).withColumn("turns", F.when(F.col("conv") == 1, F.slice("turns", 1, 0)).otherwise(F.col("turns")))
    assert nodes_of(trie.prefix_trie(convs)) == brute({1: [], 2: [("u", "b")]})
    assert nodes_of(trie.prefix_trie(convs.where("conv = 1"))) == brute({1: []})


def test_query_on_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(trie.op11_prefix_trie(spark, DATA)) == brute(mixed(given(rows)))
