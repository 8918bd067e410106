"""Trie of conversation prefixes, as balanced parentheses.

Equal conversations become one sequence of turn hashes; the distinct sequences are sorted and cut into shards by range. A shard
writes its trie as balanced parentheses, one pair a node. A tree of block minima over the excess finds the matching close of every
open, which delimits the node's subtree; ranks count the leaves (pairs "()") between the two, cumulative arrays in the order of the
opens give members and savings. Only nodes on the first and last path of a shard can go on in the neighbouring shards: these
spines keep what their finished subtrees add up to, and are merged, 64 neighbouring shards at a time, by the same encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import arrow_schema, stored, table
from crawlframe.llm.words import grouped
from crawlframe.session import small_or_shuffled

BLOCK, NODES, SHARDS = 64, 50_000, 64
#: Ids of equal conversations are gathered in ranges of so many values.
ID_RANGE = 1 << 16
NONE = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROWS = ("spine boolean, shard long, side int, depth long, label binary, size long, n long, lo long, kids long, leaves long, saved long, "
        "ends string, key binary, parent_lo long, parent_key binary")
NAMES = [x.split()[0] for x in ROWS.split(", ")]


class Parentheses:
    """A balanced sequence (1 open, 0 close) with a tree of the smallest excess of each block and pair of blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        self.opens = np.nonzero(self.bits)[0]
        self._rank = np.r_[0, np.cumsum(self.bits)]
        leaf = self.bits[:-1] & ~self.bits[1:] if len(bits) else self.bits
        self._pairs = np.r_[0, np.cumsum(leaf), leaf.sum()]
        blocks = max(1, -(-len(bits) // BLOCK))
        self.base = 1 << (blocks - 1).bit_length()
        padded = np.full(self.base * BLOCK, NONE)
        padded[:len(bits)] = self.excess
        self._excess = padded
        tree = np.full(2 * self.base, NONE)
        tree[self.base:] = padded.reshape(-1, BLOCK).min(1)
        for x in range(self.base.bit_length() - 2, -1, -1):
            tree[1 << x:2 << x] = tree[2 << x:4 << x].reshape(-1, 2).min(1)
        self.tree = tree

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opens before a place."""
        return self._rank[at]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Leaves whose open stands before a place."""
        return self._pairs[at]

    def _in_block(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``at`` to the end of its block with excess ``target``; -1 if there is none."""
        out = np.full(len(at), -1)
        left, place = np.arange(len(at)), at.copy()
        while len(left):
            hit = self._excess[place[left]] == target[left]
            out[left[hit]] = place[left[hit]]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] % BLOCK != 0]
        return out

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The close of the open at each place."""
        target = self.excess[at] - 1
        inside = (at + 1) % BLOCK != 0
        out = np.full(len(at), -1)
        out[inside] = self._in_block(at[inside] + 1, target[inside])
        left = np.nonzero(out < 0)[0]
        x, t = at[left] // BLOCK + self.base + 1, target[left]
        while len(far := np.nonzero(self.tree[x] > t)[0]):  # to the right, and up from left children
            up = far[x[far] % 2 == 0]
            x[far] = np.where(x[far] % 2 == 1, x[far] + 1, x[far])
            x[up] += 1
            even = far[x[far] % 2 == 0]
            x[even] //= 2
        while len(high := np.nonzero(x < self.base)[0]):
            x[high] *= 2
            x[high] += self.tree[x[high]] > t[high]
        out[left] = self._in_block((x - self.base) * BLOCK, t)
        return out


def range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest of ``values[start:end]`` for each pair; no range is empty."""
    length = end - start
    out, level, table_ = np.zeros(len(start), values.dtype), 0, values
    while True:
        here = (length >= 1 << level) & (length < 2 << level)
        s, e = start[here], end[here] - (1 << level)
        out[here] = np.minimum(table_[s], table_[e])
        if not len(values) or (2 << level) > len(values):
            return out
        table_ = np.minimum(table_[:-(1 << level)], table_[1 << level:])
        level += 1


class Shard:
    """The nodes of sorted paths. A path is a list of [label, size, n, lo, kids, leaves, saved, ends] from the root on: what is known of
    each node besides its subtree in this shard. Nodes that may go on elsewhere stay open; the others are finished."""

    def __init__(self, paths: Iterable[list], left: int, right: bool, keys: bool):
        """``left``: leading nodes of the first path that stay open; ``right``: the last path stays open; ``keys``: key finished nodes too."""
        bits: list[int] = []
        nodes: list[list] = []
        depth, parent = [], []
        stack: list[int] = []
        first: list[int] = []
        for path in paths:
            k = 0
            while k < len(stack) and k < len(path) and nodes[stack[k]][0] == path[k][0]:
                k += 1
            for at, more in zip(stack[:k], path, strict=False):
                if more[2] or more[4] or more[7] or more[5] or more[6]:
                    mine = nodes[at]
                    mine[2:7] = mine[2] + more[2], min(mine[3], more[3]), mine[4] + more[4], mine[5] + more[5], mine[6] + more[6]
                    mine[7] = mine[7] or more[7]
            bits += [0] * (len(stack) - k)
            del stack[k:]
            for d in range(k, len(path)):
                bits.append(1)
                parent.append(stack[-1] if stack else -1)
                stack.append(len(nodes))
                nodes.append(list(path[d]))
                depth.append(d)
            first = first or list(stack)
        bits += [0] * len(stack)
        self.nodes, self.depth, self.parent = nodes, depth, parent
        on_left, on_right = first[:left], stack if right else []
        self.left, self.right = on_left, on_right
        self.open = np.zeros(len(nodes), bool)
        self.open[on_left] = self.open[on_right] = True
        self._add_up(Parentheses(np.array(bits, np.int8)), np.array(parent, np.int64))
        self._name(keys)

    def _add_up(self, tree: Parentheses, parent: np.ndarray) -> None:
        column = lambda i: np.array([x[i] for x in self.nodes], np.int64)
        n, kids = column(2), column(4)
        start = np.arange(len(n))
        close = tree.find_close(tree.opens)
        end = tree.rank(close)
        below = lambda x: (c := np.r_[0, np.cumsum(x)])[end] - c[start]
        children = np.bincount(parent[parent >= 0], minlength=len(n))
        self.n, self.lo = below(n), range_min(column(3), start, end)
        stub = (children == 0) & (self.open | (kids > 0))  # a pair that is no leaf
        self.leaves = tree.pairs(close) - tree.pairs(tree.opens) - below(stub) + below(column(5))
        self.saved = below(column(6) + np.where(self.open, 0, (self.n - 1) * column(1)))
        inner = np.nonzero(self.open)[0]
        self.kids = kids + children
        # an open node keeps what its finished subtrees add up to
        for total in (self.n, self.leaves, self.saved):
            whole = total.copy()
            for v in inner.tolist():
                if parent[v] >= 0:
                    total[parent[v]] -= whole[v]
        for v in inner.tolist():
            if parent[v] >= 0:
                self.kids[parent[v]] -= 1

    def _name(self, keys: bool) -> None:
        self.key: dict[int, bytes] = {}
        for v in (range(len(self.nodes)) if keys else np.nonzero(self.open)[0].tolist()):
            above = self.key[self.parent[v]] if self.parent[v] >= 0 else b""
            self.key[v] = hashlib.blake2b(above + self.nodes[v][0], digest_size=16).digest()

    def own(self, v: int) -> list:
        """An open node as part of a path."""
        label, size, *_, ends = self.nodes[v]
        return [label, size, *(int(x[v]) for x in (self.n, self.lo, self.kids, self.leaves, self.saved)), ends]

    def finished(self) -> dict[str, list]:
        """Rows of the nodes that are complete."""
        done = np.nonzero(~self.open)[0]
        above = [self.parent[v] for v in done.tolist()]
        plain = [p >= 0 and not self.open[p] for p in above]
        out: dict[str, list] = {c: [None] * len(done) for c in NAMES}
        lo = self.lo.tolist()
        out |= {"spine": [False] * len(done), "depth": [self.depth[v] for v in done.tolist()]}
        out |= {c: x[done].tolist() for c, x in (("n", self.n), ("lo", self.lo), ("kids", self.kids), ("leaves", self.leaves), ("saved", self.saved))}
        out |= {"ends": [self.nodes[v][7] for v in done.tolist()], "key": [self.key.get(v) for v in done.tolist()]}
        out |= {"parent_lo": [lo[p] if x else None for p, x in zip(above, plain, strict=True)]}
        out |= {"parent_key": [self.key[p] if p >= 0 and not x else None for p, x in zip(above, plain, strict=True)]}
        return out


def spines(shard: int, left: list, right: list) -> dict[str, list]:
    """Rows of a shard's first and last path."""
    out: dict[str, list] = {c: [] for c in NAMES}
    for side, path in enumerate((left, right)):
        for depth, node in enumerate(path):
            row = dict(zip(("label", "size", "n", "lo", "kids", "leaves", "saved", "ends"), node, strict=True))
            row |= {"spine": True, "shard": shard, "side": side, "depth": depth}
            for c in NAMES:
                out[c].append(row.get(c))
    return out


class Builder:
    """Feeds sorted paths to shards of bounded size; between them only the last path stays."""

    def __init__(self):
        self.left: list[list] | None = None  # the first path, as far as it is closed
        self.left_open = 0
        self.last: list[list] = []

    def add(self, paths: list[list]) -> dict[str, list]:
        if self.left is None:
            self.left, self.left_open = [[x[0], x[1], 0, NONE, 0, 0, 0, None] for x in paths[0]], len(paths[0])
        shard = Shard([self.last, *paths] if self.last else paths, self.left_open, True, False)
        self.last = [shard.own(v) for v in shard.right]
        still = sum(a == b for a, b in zip(shard.left, shard.right, strict=False))
        for d in range(still, len(shard.left)):
            self.left[d] = shard.own(shard.left[d])
        self.left_open = still
        return shard.finished()

    def rest(self, shard: int) -> dict[str, list]:
        return spines(shard, self.left or [], self.last)


def build(classes: DataFrame) -> DataFrame:
    """ROWS of the sorted, range-partitioned classes (shard, labels, sizes, n, lo, ends)."""
    target = arrow_schema(ROWS)

    def run(parts: Iterator[pa.RecordBatch]):
        made, held, size, shard = Builder(), [], 0, None
        batch = lambda rows: pa.RecordBatch.from_pydict(rows, schema=target)
        for part in parts:
            for at in range(part.num_rows):
                (row,) = part.slice(at, 1).to_pylist()
                shard = row["shard"]
                path = [[x, s, 0, NONE, 0, 0, 0, None] for x, s in zip([b"", *row["labels"]], [0, *row["sizes"]], strict=True)]
                path[-1][2], path[-1][3], path[-1][7] = row["n"], row["lo"], row["ends"]
                held.append(path)
                size += len(path)
                if size >= NODES:
                    yield batch(made.add(held))
                    held, size = [], 0
        if held:
            yield batch(made.add(held))
        if shard is not None:
            yield batch(made.rest(shard))

    return classes.mapInArrow(run, ROWS)


def merge_spines(rows: DataFrame, final: bool) -> DataFrame:
    """Spines of neighbouring shards as one shard's nodes; ``final`` finishes all of them."""

    def work(cols: dict) -> dict:
        order = sorted(range(len(cols["shard"])), key=lambda i: (cols["shard"][i], cols["side"][i], cols["depth"][i]))
        paths: list[list] = []
        for i in order:
            if cols["depth"][i] == 0:
                paths.append([])
            paths[-1].append([cols[c][i] for c in ("label", "size", "n", "lo", "kids", "leaves", "saved", "ends")])
        shard = Shard(paths, 0 if final else len(paths[0]), not final, True)
        out = shard.finished()
        if not final:
            same = set(shard.right)
            empty = lambda v: [shard.nodes[v][0], shard.nodes[v][1], 0, NONE, 0, 0, 0, None]
            left = [empty(v) if v in same else shard.own(v) for v in shard.left]
            more = spines(cols["group"][0], left, [shard.own(v) for v in shard.right])
            out = {c: out[c] + more[c] for c in NAMES}
        return out

    return grouped(rows.withColumn("group", F.floor(F.col("shard") / SHARDS)), ["group"], work, ROWS)


def spliced(conversations: DataFrame, most: Column | None = None, every: int = 100, key: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv, labels, sizes: each conversation's turns (16-byte hash of role and text, code points), its first ones taken from a leader.

    The first h turns come from conversation ``conv - conv % every`` (all it has if fewer, none if it is absent), the rest are the
    conversation's own turns after its first h; h is ``most`` of the column ``conv``, by default crc32(id as text) % 6. Turns are ordered
    by number, null first; equal numbers by the hash. Rows of a null id belong to no conversation. Null roles and texts are empty.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)))
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.struct(F.col(turn).alias("t"), label.alias("label"), F.length(text_).cast("long").alias("size")).alias("e"))
    own = stored(rows.groupBy("conv").agg(F.sort_array(F.collect_list("e")).alias("own")), "conversation-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6 if most is None else most
    head = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("leader"), F.col("own").alias("head"))
    both = own.withColumns({"h": h.cast("int"), "_to": F.col("conv") - F.col("conv") % every}).join(head, F.col("_to") == F.col("leader"), "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    path = F.concat(first, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return both.select("conv", path.alias("path")).select("conv", F.col("path.label").alias("labels"), F.col("path.size").alias("sizes"))


def classes(paths: DataFrame) -> DataFrame:
    """labels, sizes, n, lo, ends of every distinct sequence: its conversations' number, smallest id and the hash of all ids.

    Ids are gathered by ranges of values; the hash runs over a class's ranges in order, holding one at a time.
    """
    a, b = F.xxhash64("labels"), F.xxhash64(F.lit(1), "labels")
    parts = paths.groupBy(a.alias("a"), b.alias("b"), F.floor(F.col("conv") / ID_RANGE).alias("range")).agg(
        F.min("conv").alias("lo"), F.count("*").alias("n"), F.sort_array(F.collect_list("conv")).alias("ids"),
        F.first("labels").alias("labels"), F.first("sizes").alias("sizes"))
    parts = parts.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    schema = "labels array<binary>, sizes array<long>, n long, lo long, ends string"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        key, held, digest = None, None, None
        rows: list[dict] = []
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                if (row["a"], row["b"]) != key:
                    if held:
                        rows.append(held | {"ends": digest.hexdigest()})
                    key, digest = (row["a"], row["b"]), hashlib.sha256(row["ids"].encode())
                    held = {c: row[c] for c in ("labels", "sizes", "n", "lo")}
                else:
                    digest.update(b"," + row["ids"].encode())
                    held["n"] += row["n"]
                if len(rows) >= 1_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                    rows = []
        if held:
            rows.append(held | {"ends": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=target)

    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "range").mapInArrow(run, schema)


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv long, labels array<binary>, sizes array<long>), the root (depth 0) included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without
    conversations there is no node. Conversations that are equal or end inside another one are members of the same nodes. A
    conversation's hashes are held in one row, so they must fit into a task; texts are not.
    """
    spark = paths.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = classes(paths).repartitionByRange(n, "labels").sortWithinPartitions("labels")
    out = stored(build(shards.withColumn("shard", F.spark_partition_id().cast("long"))), "trie-shards")
    done, named, spine = [out.where("NOT spine")], [], out.where("spine")
    width = spine.agg(F.max("shard")).first()[0]
    while width is not None:
        final = width < SHARDS
        out = stored(merge_spines(spine.select("shard", "side", "depth", "label", "size", "n", "lo", "kids", "leaves", "saved", "ends"), final), "trie-spines")
        named.append(out.where("NOT spine"))
        spine, width = out.where("spine"), None if final else width // SHARDS
    nodes = done[0]
    for more in named:
        nodes = nodes.unionByName(more)
    above = named[0] if named else nodes.limit(0)
    for more in named[1:]:
        above = above.unionByName(more)
    above = small_or_shuffled(above.select(F.col("key").alias("_key"), F.col("lo").alias("_lo")))
    nodes = nodes.join(above, F.col("parent_key") == F.col("_key"), "left")
    return nodes.select(
        F.col("lo").alias("conv_id"), "depth", F.coalesce("parent_lo", "_lo").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all ``conversations``, rebuilt with the leaders' first turns (see ``spliced`` and ``prefix_trie``)."""
    return prefix_trie(spliced(table(spark, folder, "conversations")))


ORACLE_TRIE = r"""
WITH o AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, p, c - c % 100 AS leader, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(l.p[1:h], []), h.p[h + 1:]) AS p FROM h LEFT JOIN o l ON l.c = h.leader),
m AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM b),
k AS (SELECT c, d, len(p) AS len, CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS size, md5(CAST(p[1:d] AS VARCHAR)) AS k,
        CASE WHEN d > 0 THEN md5(CAST(p[1:d - 1] AS VARCHAR)) END AS up FROM m),
n AS (SELECT d, k, min(up) AS up, min(c) AS lo, count(*) AS n, min(size) AS size,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends FROM k GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
sub AS (SELECT a.d, a.k, sum((f.kids = 0)::INT) AS leaves, sum((f.n - 1) * f.size) AS saved
        FROM f JOIN k a ON a.c = f.lo AND a.d <= f.d GROUP BY ALL)
SELECT f.lo AS conv_id, f.d AS depth, p.lo AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       f.ends AS ends_sha256
FROM f JOIN sub USING (d, k) LEFT JOIN n p ON p.d = f.d - 1 AND p.k = f.up
"""
