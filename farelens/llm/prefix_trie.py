"""Operator 13: the prefix trie of conversations, by ternary search trees over range shards.

Every conversation becomes one path: the 128-bit fingerprints (SHA-256) and
word counts of its turns, so texts never travel.  Paths are range-partitioned
and sorted by (path, conv_id) with splitters that Spark samples, so copies of
one conversation are dealt over shards like any others, and a shard is a block
of at most about BLOCK_TURNS consecutive turns of that order.  A shard encodes
its turns by a dictionary of its own, inserts its distinct paths into a
ternary search tree, medians first, and an iterative traversal accumulates
members, leaves and savings bottom up.

Only nodes on a shard's first and last path can stand in another shard too.
These boundary nodes (at most two paths a shard) are merged by their prefix
fingerprint: counts add up, and what must be counted once (a node's own saving
and its place among its parent's children; whether it is a leaf) is counted
by the first, or by the last, shard that holds it.  Their nodes' ends travel
as packed text and are digested as a stream in order, whatever their number.

Defined results: rows without conv_id are left out; turns sort null first, and
equal turns by their fingerprint; repeated rows are turns of their own; null
role or text is empty; a conversation that is rebuilt to nothing is a member of
the root; an empty table has no node.  A remainder has its dividend's sign, as
in SQL.  One conversation is one row (about 20 bytes a turn), since it is one
path of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import saved, shuffle_width, small_batches

#: Conversations that share a first part stand STRIDE apart; the part has fewer than HEADS turns.
STRIDE, HEADS = 20, 4
#: Turns (plus conversations) of a shard, and conversation ids in one piece of packed ends.
BLOCK_TURNS, ENDS_PIECE = 1 << 17, 4096
_WORDS = r"[^\x20\x09-\x0D]+"
_PRINT = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
INNER, UNDER, EDGE, ENDS = range(4)
_FOUND = (
    "kind int, block long, slot int, up int, depth long, node binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, words long, childless boolean, ends string"
)
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def fingerprint(role: F.Column, text: F.Column) -> F.Column:
    """128 bits (hex) of a turn's role and text."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _PRINT)


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation: its family's first h turns, then its own after its first h."""
    c = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    turn = F.struct(F.col("turn"), fingerprint(role, text).alias("print"), F.regexp_count(text, F.lit(_WORDS)).alias("words")).alias("of")
    rows = conversations.where(c.isNotNull()).select(c.alias("conv_id"), (c - c % STRIDE).alias("family"), turn)
    # One exchange: a family's conversations meet in one task, and grouping by conversation needs no other.
    whole = rows.repartition(shuffle_width(rows.sparkSession), "family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("of")).alias("turns"))
    first = F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, HEADS - 1))
    heads = whole.withColumn("heads", F.max(first).over(Window.partitionBy("family")))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    path = F.concat(F.when(F.col("heads").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("heads", F.lit(1), h)), own)
    of = heads.select("conv_id", path.alias("path"))
    prints = F.unhex(F.array_join(F.transform("path", lambda t: t["print"]), ""))
    return of.select("conv_id", prints.alias("path"), F.transform("path", lambda t: t["words"].cast("int")).alias("words"))


class Shard:
    """The trie of sorted paths as a ternary search tree: parallel lists, node 0 is the root."""

    def __init__(self, turns: np.ndarray, start: np.ndarray):
        """turns: dictionary ids of all paths' turns; path i is turns[start[i]:start[i + 1]]."""
        self.symbol, self.low, self.equal, self.high, self.up = [-1], [-1], [-1], [-1], [-1]
        self.first_turn = [-1]  # a place in ``turns`` where the node's last turn stands
        size = np.diff(start)
        same = np.zeros(len(size), bool)
        flat = turns.tolist()
        begin = start.tolist()
        for i in np.flatnonzero(size[1:] == size[:-1]).tolist():
            same[i + 1] = flat[begin[i] : begin[i + 1]] == flat[begin[i + 1] : begin[i + 2]]
        #: Runs of equal paths: run r is paths bounds[r] to bounds[r + 1], and ends in node end[r].
        self.bounds = np.append(np.flatnonzero(~same), len(size)).tolist()
        self.end = [0] * (len(self.bounds) - 1)
        halves = [(0, len(self.end))]
        while halves:  # medians first keep the siblings' trees balanced
            a, z = halves.pop()
            if a < z:
                m = (a + z) // 2
                self.end[m] = self._insert(flat, begin[self.bounds[m]], begin[self.bounds[m] + 1])
                halves += [(a, m), (m + 1, z)]

    def _insert(self, flat: list[int], at: int, stop: int) -> int:
        symbol, low, equal, high = self.symbol, self.low, self.equal, self.high
        node = 0
        for k in range(at, stop):
            s, here, link, near = flat[k], equal[node], equal, node
            while here >= 0 and symbol[here] != s:
                link, near = (low, here) if s < symbol[here] else (high, here)
                here = link[here]
            if here < 0:
                here = link[near] = len(symbol)
                symbol.append(s)
                for side in (low, equal, high):
                    side.append(-1)
                self.up.append(node)
                self.first_turn.append(k)
            node = here
        return node

    def order(self) -> list[int]:
        """Nodes in an order that has every node after its parent, by a traversal with a stack of its own."""
        out, todo = [], [0]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += [s for s in (self.high[k], self.low[k], self.equal[k]) if s >= 0]
        return out

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = [node]
        while node:
            node = self.up[node]
            out.append(node)
        return out[::-1]


def _shard_rows(block: int, prints: bytes, start: np.ndarray, words: np.ndarray, convs: np.ndarray) -> Iterator[pa.RecordBatch]:
    turns = np.unique(np.frombuffer(prints, f"S{_PRINT}"), return_inverse=True)[1]
    tree = Shard(turns, start)
    n = len(tree.symbol)
    up, order = tree.up, tree.order()
    word = [0] + words[np.array(tree.first_turn[1:], np.int64)].tolist()
    depth, members, least, children, ends = [0] * n, [0] * n, [None] * n, [0] * n, [None] * n
    for a, z, node in zip(tree.bounds, tree.bounds[1:], tree.end, strict=False):
        members[node], least[node], ends[node] = z - a, int(convs[a]), (a, z)
    for k in order[1:]:
        depth[k] = depth[up[k]] + 1
    edge: dict[int, int] = {}
    for node in (tree.end[0], tree.end[-1]):
        for k in tree.path(node):
            edge.setdefault(k, len(edge))
    for k in reversed(order[1:]):
        p = up[k]
        members[p] += members[k]
        children[p] += 1
        least[p] = least[k] if least[p] is None else min(least[p], least[k])
    # What a boundary node gathers here stops at inner nodes; the boundary's own part is added when shards are merged.
    childless = [c == 0 for c in children]
    leaves = [0 if k in edge else int(childless[k]) for k in range(n)]
    saved_tokens = [0 if k in edge else (members[k] - 1) * word[k] for k in range(n)]
    inner = children.copy()
    for k in reversed(order[1:]):
        p = up[k]
        if k in edge:
            inner[p] -= 1
        else:
            leaves[p] += leaves[k]
            saved_tokens[p] += saved_tokens[k]
    own: list[tuple] = []
    node_print: dict[int, bytes] = {0: b""}
    for k in order:
        p = up[k]
        if k in edge:
            if k:
                at = tree.first_turn[k] * _PRINT
                node_print[k] = hashlib.sha256(node_print[p] + prints[at : at + _PRINT]).digest()[:_PRINT]
            own.append((EDGE, block, edge[k], edge[p] if k else -1, depth[k], node_print[k], least[k], None, members[k], inner[k], leaves[k], saved_tokens[k], word[k], childless[k], None))
            if ends[k]:
                a, z = ends[k]
                for part, i in enumerate(range(a, z, ENDS_PIECE)):
                    text = ",".join(map(str, convs[i : min(z, i + ENDS_PIECE)].tolist()))
                    own.append((ENDS, block, part, None, None, node_print[k], None, None, None, None, None, None, None, None, text))
            continue
        digest = _EMPTY if ends[k] is None else hashlib.sha256(",".join(map(str, convs[ends[k][0] : ends[k][1]].tolist())).encode()).hexdigest()
        kind, slot, parent = (UNDER, edge[p], None) if p in edge else (INNER, None, least[p])
        own.append((kind, block, slot, None, depth[k], None, least[k], parent, members[k], children[k], leaves[k], saved_tokens[k], None, None, digest))
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in _FOUND.split(", ")])
    for i in range(0, len(own), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own[i : i + (1 << 14)], strict=True), schema, strict=True)], schema=schema)


def _shards(block_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, load = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            paths = table.column("path").to_pylist()
            start = np.concatenate(([0], np.cumsum([len(p) // _PRINT for p in paths]))).astype(np.int64)
            words = np.concatenate([c.flatten().to_numpy() for c in table.column("words").chunks])
            yield from _shard_rows((part << 32) + seq, b"".join(paths), start, words, table.column("conv_id").to_numpy())

        for b in batches:
            at = 0
            turns = np.cumsum(np.diff(b.column("words").offsets.to_numpy()) + 1)
            while at < b.num_rows:  # close the shard at the row that fills it
                done = int(turns[at - 1]) if at else 0
                to = min(int(np.searchsorted(turns, done + block_turns - load)) + 1, b.num_rows)
                held.append(b.slice(at, to - at))
                load += int(turns[to - 1]) - done
                at = to
                if load >= block_turns:
                    yield from shard()
                    held, load, seq = [], 0, seq + 1
        if held:
            yield from shard()

    return run


_MERGED = "node binary, block long, slot int, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _settle(table: pa.Table) -> pa.Table:
    """One shard's boundary nodes, with what each adds to its ancestors in this shard."""
    rows = sorted(table.to_pylist(), key=lambda r: r["depth"])
    at = {r["slot"]: r for r in rows}
    for r in rows:
        r["n_leaves"] += r["childless"] and r["block"] == r["last"]
        if r["block"] == r["first"]:
            r["saved_tokens"] += (r["total"] - 1) * r["words"]
        r["parent_conv_id"] = at[r["up"]]["least"] if r["up"] >= 0 else None
    for r in reversed(rows):
        if r["up"] >= 0:
            p = at[r["up"]]
            p["n_leaves"] += r["n_leaves"]
            p["saved_tokens"] += r["saved_tokens"]
            p["n_children"] += r["block"] == r["first"]
    names = [c.split()[0] for c in _MERGED.split(", ")]
    rename = {"conv_id": "least", "n_convs": "total"}
    types = [pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 7]
    return pa.table([pa.array([r[rename.get(c, c)] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = digest = None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["of", "ends_sha256"])

    for b in batches:
        for at, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if at == node:
                digest.update(b",")
            else:
                if digest:
                    yield done()
                node, digest = at, hashlib.sha256()
            digest.update(ends.encode())
    if digest:
        yield done()


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    width = shuffle_width(conversations.sparkSession)
    paths = saved(rebuilt_paths(conversations), "paths")
    dealt = paths.repartitionByRange(width, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("path", "words", "conv_id")
    found = saved(dealt.mapInArrow(_shards(block_turns), _FOUND), "trie")
    edge = found.where(F.col("kind") == EDGE).drop("kind", "parent_conv_id", "ends")
    whole = edge.groupBy("node").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("total"), F.min("block").alias("first"), F.max("block").alias("last")
    )
    settled = saved(edge.join(whole, "node").groupBy("block").applyInArrow(_settle, _MERGED), "trie-edges")
    ends = found.where(F.col("kind") == ENDS).select("node", "block", "slot", "ends")
    digests = ends.repartition(width, "node").sortWithinPartitions("node", "block", "slot").drop("block", "slot").mapInArrow(_digest, "of binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    nodes = settled.groupBy("node", "conv_id", "depth", "parent_conv_id", "n_convs").agg(*sums)
    nodes = nodes.join(digests, nodes.node == digests.of, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    inner = found.where(F.col("kind") == INNER).withColumnRenamed("ends", "ends_sha256").select(COLUMNS)
    parents = settled.select("block", "slot", F.col("conv_id").alias("of"))
    under = found.where(F.col("kind") == UNDER).drop("parent_conv_id").join(parents, ["block", "slot"])
    under = under.withColumnRenamed("ends", "ends_sha256").withColumnRenamed("of", "parent_conv_id").select(COLUMNS)
    return inner.unionByName(under).unionByName(nodes.select(COLUMNS))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB statement of the same rows: nodes are whole prefixes (joined fingerprints), subtrees are joins of nodes with their prefixes.
ORACLE = rf"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn,
        substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS print
    FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
    SELECT c, print, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
        row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, print) AS pos FROM turns),
ids AS (SELECT DISTINCT c FROM placed),
steps AS (
    SELECT c, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
        lambda s: list_prepend(CAST(ascii(s) AS BIGINT), list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))) AS ops FROM ids),
heads AS (
    SELECT c, xor(list_reduce(ops, lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END),
        4294967295) % {HEADS} AS h FROM steps),
rebuilt AS (
    SELECT heads.c, 0 AS part, pos, print, w FROM heads JOIN placed ON placed.c = heads.c - heads.c % {STRIDE} AND pos <= h
    UNION ALL SELECT heads.c, 1, pos, print, w FROM heads JOIN placed ON placed.c = heads.c AND pos > h),
paths AS MATERIALIZED (
    SELECT c, row_number() OVER s AS d, string_agg(print, '') OVER s AS path, w FROM rebuilt WINDOW s AS (PARTITION BY c ORDER BY part, pos)
    UNION ALL SELECT c, 0, '', 0 FROM ids),
lengths AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM paths JOIN lengths USING (c, d) GROUP BY path),
nodes AS MATERIALIZED (SELECT path, d, min(c) AS c, count(*) AS n, any_value(w) AS w FROM paths GROUP BY path, d),
kids AS (SELECT p.path, count(*) AS k FROM nodes JOIN paths p ON p.c = nodes.c AND p.d = nodes.d - 1 GROUP BY p.path),
below AS (
    SELECT p.path, sum((nodes.n - 1) * nodes.w) AS saved, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS leaves
    FROM nodes LEFT JOIN kids USING (path) JOIN paths p ON p.c = nodes.c AND p.d <= nodes.d GROUP BY p.path)
SELECT nodes.c AS conv_id, CAST(nodes.d AS BIGINT) AS depth, up.c AS parent_conv_id, nodes.n AS n_convs,
    CAST(coalesce(kids.k, 0) AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
    sha256(coalesce(ends.e, '')) AS ends_sha256
FROM nodes JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)
    LEFT JOIN paths p ON p.c = nodes.c AND p.d = nodes.d - 1 LEFT JOIN nodes up ON up.path = p.path
"""
