import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import conversations

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(nodes[node]) - 1) * (len(node[-1][1]) if node else 0)
    ends = defaultdict(list)
    for c in sorted(rebuilt):
        ends[rebuilt[c]].append(str(c))
    sha = lambda node: hashlib.sha256(",".join(ends[node]).encode()).hexdigest()
    return sorted(
        (min(convs), len(node), min(nodes[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], sha(node))
        for node, convs in nodes.items()
    ) if nodes else []


def order(row):
    return tuple((x is not None, x) for x in row)


def table(seed, convs=120):
    rng = random.Random(seed)
    texts = ["", "hello", "é\U0001f600", "yes", "no", None]
    rows = []
    for c in rng.sample(range(400), convs):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, rng.choice(["user", "user", "assistant", None]), rng.choice(texts)))
    long = [(399, t, "user", "x" * (t % 5)) for t in range(150)]
    return [r for r in rows if r[0] != 399] + long + [(None, 0, "user", "lost"), (1000, None, None, None), (None, None, None, None)]


def test_find_close_matches_a_stack():
    rng = np.random.default_rng(2)
    for size in (1, 2, 60, 700, 5000):
        steps, excess = [], 0
        while len(steps) < 2 * size:
            up = excess == 0 or (rng.random() < 0.5 and excess < 2 * size - len(steps))
            steps.append(1 if up else -1)
            excess += steps[-1]
        steps = [1, *steps, *[-1] * (excess + 1)]
        tree = conversations.Parentheses(np.array(steps, np.int8))
        want, stack = {}, []
        for i, s in enumerate(steps):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        assert tree.find_close().tolist() == [want[i] for i in tree.opens.tolist()]


@pytest.mark.parametrize("shard, fan", [(1 << 16, 64), (60, 2), (9, 3)])
def test_nodes_match_brute_force(llm, shard, fan):
    """One shard; several; and so many that spines are folded in rounds."""
    rows = table(shard)
    data = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    data = data.withColumn("path", F.lit(b"x")).withColumn("depth", F.lit(5)).repartition(4)
    got = conversations.prefix_trie(data, shard, fan)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(brute(rows), key=order)


def test_small_tables(llm):
    kind = "conv_id long, turn long, role string, text string"
    assert conversations.prefix_trie(llm.createDataFrame([], kind)).collect() == []
    copies = [(c, t, "user", "same" * 3) for c in range(40) for t in (0, 1)] + [(5, 1, "user", "same" * 3)] * 3
    for rows in (copies, [(7, None, None, None)], [(c, 0, "a", "b") for c in (100, 101, 1, -3)]):
        got = conversations.prefix_trie(llm.createDataFrame(rows, kind), 8, 2)
        assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(brute(rows), key=order)


def test_query_over_the_smallest_table(llm):
    from lociforge.llm.queries import QUERIES

    rows = [tuple(r) for r in llm.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversations"](llm, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(brute(rows), key=order)
