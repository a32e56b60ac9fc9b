"""The prefix trie of conversations, a shard at a time in balanced parentheses.

A conversation is its sequence of turns, a turn the digest of its role and text. Distinct sequences are sorted
over the whole table and cut into shards. A shard writes its part of the trie depth first as parentheses; a
tree of minima over blocks of their excess finds the closing one of each node, so a subtree is a range: sums of
conversations and savings are differences of cumulative arrays, leaves the difference of the rank of ``()``.

Nodes on the first and the last sequence of a shard may go on in its neighbours. Such a spine leaves the shard
open, with what its closed subtrees add up to; the spines of neighbouring shards are folded again in the same way,
in rounds of fewer and fewer shards, until one closes all. A spine has a row a shard, so rounds shrink fast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.llm.store import materialise

#: Bytes of a turn's digest.
DIGEST = 16
#: Turns of distinct sequences to a shard, and shards whose spines are folded together.
SHARD = 1 << 16
FAN = 64
BLOCK = 64
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- parentheses ----------------------------------------------------------------------------------

class Parentheses:
    """A balanced sequence of +1 and -1 with minima of its excess over blocks and over ever larger groups of them."""

    def __init__(self, steps: np.ndarray):
        self.steps = steps
        self.excess = np.cumsum(steps, dtype=np.int64)
        blocks = 1 << max(0, int(-(-len(steps) // BLOCK) - 1).bit_length())
        padded = np.full(blocks * BLOCK, NONE)
        padded[: len(steps)] = self.excess
        self.levels = [padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))
        self.opens = np.flatnonzero(steps > 0)

    def _first_low(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """From each place on, the first one in its block with an excess up to the bound, or -1."""
        out, left = np.full(len(at), -1), np.arange(len(at))
        at = at.copy()
        for _ in range(BLOCK):
            left = left[at[left] < len(self.excess)]
            hit = self.excess[at[left]] <= bound[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] % BLOCK != 0]
            if not len(left):
                break
        return out

    def _next_block(self, block: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first block after each with a minimum up to the bound; there is one."""
        block, level = block.copy(), np.zeros(len(block), np.int64)
        climbing = np.arange(len(block))
        while len(climbing):
            block[climbing] += 1
            while (up := climbing[(block[climbing] % 2 == 0) & (level[climbing] < len(self.levels) - 1)]).size:
                block[up] //= 2
                level[up] += 1
            climbing = climbing[self._minima(level[climbing], block[climbing]) > bound[climbing]]
        while (down := np.flatnonzero(level)).size:
            block[down] *= 2
            level[down] -= 1
            block[down] += self._minima(level[down], block[down]) > bound[down]
        return block

    def _minima(self, level: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.empty(len(level), np.int64)
        for k in np.unique(level).tolist():
            out[level == k] = self.levels[k][block[level == k]]
        return out

    def find_close(self) -> np.ndarray:
        """The place of the closing parenthesis of each opening one."""
        bound = self.excess[self.opens] - 1
        found = self._first_low(self.opens, bound)
        far = np.flatnonzero(found < 0)
        if len(far):
            block = self._next_block(self.opens[far] // BLOCK, bound[far])
            found[far] = self._first_low(block * BLOCK, bound[far])
        return found


# --- a shard --------------------------------------------------------------------------------------

ITEM = {
    "path": pa.binary(), "sizes": pa.list_(pa.int64()), "convs": pa.list_(pa.int64()), "least": pa.list_(pa.int64()),
    "children": pa.list_(pa.int64()), "leaves": pa.list_(pa.int64()), "saved": pa.list_(pa.int64()), "ends": pa.list_(pa.string()),
}
NODE = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "key": pa.string(), "parent_key": pa.string(),
}
FOLDED = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "key string, parent_key string, path binary, sizes array<long>, convs array<long>, least array<long>, children array<long>, "
    "leaves array<long>, saved array<long>, ends array<string>"
)
SUMS = ("convs", "leaves", "saved")


def shared_turns(one: bytes, two: bytes) -> int:
    """How many turns two sequences have in common at the front."""
    low, high = 0, min(len(one), len(two)) // DIGEST
    while low < high:
        half = (low + high + 1) // 2
        if one[low * DIGEST : half * DIGEST] == two[low * DIGEST : half * DIGEST]:
            low = half
        else:
            high = half - 1
    return low


def fold(items: dict[str, list], first_round: bool, last: bool) -> tuple[dict[str, list], dict[str, list]]:
    """Closed nodes and open spines of sequences in order.

    An item is a path with one value a node on it (``depth + 1`` of them, the root first): conversations and savings
    that are known to lie under the node but under no node further down the path, and so on; items that
    share a node add up. With ``last`` the sequences are all that there are, and every node closes. Nodes of later
    rounds were open before and get a key, by which children that closed earlier find their parent.
    """
    paths = items["path"]
    depth = np.array([len(p) // DIGEST for p in paths])
    lcp = np.array([-1] + [shared_turns(a, b) for a, b in zip(paths, paths[1:])])
    before = np.concatenate([[-1], depth[:-1]])
    turns = np.stack([before - lcp, depth - lcp], axis=1).ravel()
    turns = np.append(turns, depth[-1] + 1)  # the closing ones at the end
    steps = np.repeat(np.where(np.arange(len(turns)) % 2, 1, -1).astype(np.int8), turns)
    tree = Parentheses(steps)
    n = len(tree.opens)
    node_depth = tree.excess[tree.opens] - 1

    parent, size, ends = np.full(n, -1), np.zeros(n, np.int64), [None] * n
    source = np.zeros(n, np.int64)  # an item that the node lies on
    own = {k: np.zeros(n, np.int64) for k in (*SUMS, "children")}
    least = np.full(n, NONE)
    at: list[int] = []  # the nodes of the path at hand
    first: list[int] = []
    new = 0
    for i in range(len(paths)):
        del at[lcp[i] + 1 :]
        for d in range(lcp[i] + 1, depth[i] + 1):
            parent[new] = at[-1] if at else -1
            size[new] = items["sizes"][i][d - 1] if d else 0
            source[new] = i
            at.append(new)
            new += 1
        first = first or list(at)
        for k in (*SUMS, "children"):
            np.add.at(own[k], at, items[k][i])
        np.minimum.at(least, at, [NONE if x is None else x for x in items["least"][i]])
        for node, e in zip(at, items["ends"][i]):
            ends[node] = e if e is not None else ends[node]
    spine = [] if last else [first, list(at)]
    is_open = np.zeros(n, bool)
    for path in spine:
        is_open[path] = True

    close = tree.find_close()
    opened = np.cumsum(steps > 0)
    end = opened[close]  # nodes are numbered in the order they open: a subtree is a range of numbers
    begin = np.arange(n)
    below = lambda values: np.append(0, np.cumsum(values))[end] - np.append(0, np.cumsum(values))[begin]
    children = own["children"] + np.bincount(parent[1:], minlength=n)
    n_convs = below(own["convs"])
    pairs = np.zeros(len(steps), bool)
    pairs[:-1] = (steps[:-1] > 0) & (steps[1:] < 0)
    childless = pairs[tree.opens] & (children == 0) & ~is_open
    leaves = below(own["leaves"] + childless)
    saved = below(own["saved"] + np.where(is_open, 0, (n_convs - 1) * size))
    under = least.copy()
    for d in range(int(node_depth.max()), 0, -1):
        mine = np.flatnonzero((node_depth == d) & ~is_open)
        np.minimum.at(under, parent[mine], under[mine])

    def key(node: int) -> str:
        return hashlib.sha256(paths[source[node]][: int(node_depth[node]) * DIGEST]).hexdigest()

    closed = np.flatnonzero(~is_open)
    up = parent[closed]
    known = (up >= 0) & ~is_open[up]
    keys = {node: key(node) for path in spine for node in path}
    nodes = {
        "conv_id": under[closed], "depth": node_depth[closed],
        "parent_conv_id": [int(under[p]) if k else None for p, k in zip(up.tolist(), known.tolist())],
        "n_convs": n_convs[closed], "n_children": children[closed], "n_leaves": leaves[closed], "saved_tokens": saved[closed],
        "ends_sha256": [ends[c] or NO_ENDS for c in closed.tolist()],
        "key": [None if first_round else key(c) for c in closed.tolist()],
        "parent_key": [keys.get(p) for p in up.tolist()],
    }
    spines = {k: [] for k in ITEM}
    seen: set[int] = set()
    total = {"convs": n_convs, "leaves": leaves, "saved": saved}
    in_spine = {}  # sums of the spine nodes right below each spine node
    for k in (*SUMS, "children"):
        in_spine[k] = np.zeros(n, np.int64)
        inner = np.flatnonzero(is_open & (parent >= 0))
        np.add.at(in_spine[k], parent[inner], total[k][inner] if k in total else 1)
    for j, nodes_on in enumerate(spine):
        if j and nodes_on == spine[0] and paths[0] == paths[-1]:
            continue
        fresh = [node not in seen for node in nodes_on]
        seen.update(nodes_on)
        path = paths[0] if j == 0 else paths[-1]
        spines["path"].append(path)
        spines["sizes"].append([int(size[x]) for x in nodes_on[1:]])
        for k in SUMS:
            spines[k].append([int(total[k][x] - in_spine[k][x]) if f else 0 for x, f in zip(nodes_on, fresh)])
        spines["children"].append([int(children[x] - in_spine["children"][x]) if f else 0 for x, f in zip(nodes_on, fresh)])
        spines["least"].append([int(under[x]) if f and under[x] != NONE else None for x, f in zip(nodes_on, fresh)])
        spines["ends"].append([ends[x] if f else None for x, f in zip(nodes_on, fresh)])
    return nodes, spines


# --- Spark ----------------------------------------------------------------------------------------

def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: for each conversation the digests of its turns, joined, and the lengths of their texts.

    The first h turns are those of the conversation whose id is the hundred below, none if there is no such one;
    then come its own after its first h. h is the CRC of the id modulo 6.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    turns = materialise(turns.withColumn("at", F.row_number().over(order)).drop("turn"), "turns")
    members = turns.select("conv_id").distinct().withColumn("h", head_length(F.col("conv_id")))
    heads = turns.filter("at <= 5").select(F.col("conv_id").alias("base"), "at", "digest", "size")
    taken = members.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base").filter("at <= h")
    own = turns.filter(F.col("at") > head_length(F.col("conv_id")))
    nothing = members.select("conv_id", F.lit(0).alias("at"), F.lit("").alias("digest"), F.lit(None).cast("long").alias("size"))
    parts = own.select("conv_id", "at", "digest", "size").unionByName(taken.select("conv_id", "at", "digest", "size")).unionByName(nothing)
    rows = F.array_sort(F.collect_list(F.struct("at", "digest", "size")))
    whole = parts.groupBy("conv_id").agg(rows.alias("r"))
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.col("r.digest"), "")).alias("path"),
        F.col("r.size").alias("sizes"),
    ).withColumn("sizes", F.slice("sizes", 2, 1 << 30))


def sequences(convs: DataFrame) -> DataFrame:
    """Each distinct sequence once, as an item of :func:`fold`: its conversations, the least of them and the hash of all.

    The conversations of a sequence pass in order through one hash, without being gathered.
    """

    def item(path: bytes, sizes: list[int], n: int, least: int, ends: str) -> dict:
        rest = len(sizes)
        return {
            "path": path, "sizes": sizes, "convs": [0] * rest + [n], "least": [None] * rest + [least], "children": [0] * (rest + 1),
            "leaves": [0] * (rest + 1), "saved": [0] * (rest + 1), "ends": [None] * rest + [ends],
        }

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = sizes = state = None
        n = least = 0
        out = []
        for batch in batches:
            ids, paths = batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()
            for i, (conv, mine) in enumerate(zip(ids, paths)):
                if mine != path:
                    if path is not None:
                        out.append(item(path, sizes, n, least, state.hexdigest()))
                    path, sizes, n, least = mine, batch.column("sizes")[i].as_py(), 0, conv
                    state = hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
                n += 1
                if len(out) >= 1024:
                    yield _batch(out, ITEM)
                    out = []
        if path is not None:
            out.append(item(path, sizes, n, least, state.hexdigest()))
        if out:
            yield _batch(out, ITEM)

    kind = ", ".join(FOLDED.split(", ")[len(NODE) :])
    return convs.repartition("path").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "sizes").mapInArrow(gather, kind)


def _batch(rows: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in types.items()], list(types))


def folded(items: DataFrame, first_round: bool, last: bool) -> DataFrame:
    """One round over items that lie sorted in their partitions; rows with a path are spines, the others nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {k: [] for k in ITEM}
        for batch in batches:
            for k in ITEM:
                rows[k] += batch.column(k).to_pylist()
        if not rows["path"]:
            return
        types = NODE | ITEM
        for part, kind in zip(fold(rows, first_round, last), (NODE, ITEM)):
            size = len(next(iter(part.values())))
            if size:
                columns = [pa.array(part[k], t) if k in kind else pa.nulls(size, t) for k, t in types.items()]
                yield pa.record_batch(columns, list(types))

    return items.select(*ITEM).mapInArrow(work, FOLDED)


def prefix_trie(conversations: DataFrame, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """A row for each distinct sequence of the first turns of rebuilt conversations (see :func:`rebuilt`), the empty one included.

    ``conv_id`` (the least of its conversations), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``
    (over its subtree, the text of a node counted for all its conversations but one) and ``ends_sha256``, the hash
    of the ids that end there. Turns of equal number are ordered by a hash of role and text; null role or text is empty.
    Rows without conversation are left out; repeated rows are turns of their own; an empty table gives no rows.
    """
    items = materialise(sequences(rebuilt(conversations)), "sequences")
    turns = items.agg(F.sum(F.size("sizes") + 1).alias("n")).first()["n"]
    shards = -(-(turns or 0) // shard)
    closed = []
    while True:
        last = shards <= 1
        dealt = items.coalesce(1) if last else items.repartitionByRange(shards, "path")
        found = materialise(folded(dealt.sortWithinPartitions("path"), not closed, last), "trie")
        closed.append(found.filter("path is null"))
        if last:
            break
        items, shards = found.filter("path is not null"), -(-shards // fan)
    nodes = closed[0]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)
    if len(closed) > 1:
        spine = nodes.filter("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("spine_conv"))
        nodes = nodes.join(spine, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "spine_conv"))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
