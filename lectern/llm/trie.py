"""Prefix tries of conversations: each distinct beginning is a node, with counts over its subtree, by burst tries.

A conversation becomes its path, a string of 16 bytes for each turn (from SHA-256 of role and text), so that texts do not
move. Equal paths are one, with their smallest conv_id, number and a digest of their ids. Distinct paths
are dealt by range into shards of bounded size, so a first turn or beginning that many share is split, too.

A shard builds a burst trie: heads branch by the next turn id, containers under them hold the rest of
each path, and one that grows beyond its capacity bursts into a head with containers of its own. What remains
is sorted container by container and swept: turns that a path shares with the one before it are open nodes already,
those after them begin here, and a node closes when a path leaves it and adds its sums to its parent.

Nodes on a shard's first and last path may reach into neighbours. Each shard knows the last path of the one before it and
counts as new only what begins in it, so that all of their sums add up: those partial nodes (a path's length of
them at most at each end of a shard) are merged by a digest of their prefix, all others are complete.

Defined results: null role and text are empty; rows of one turn number (null first) are ordered by role, then by
turn id; rows without conv_id are left out; repeated rows are turns of their own; an empty table gives an empty result; further
columns are left out. A conversation's turn ids and numbers of words are one value, so its longest bounds memory.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.llm.common import durable, word_count
from lectern.operators.fold import fold_by_key

ID = 16  # bytes of a turn id
EMPTY = hashlib.sha256(b"").hexdigest()
SUMS = ["n_convs", "n_children", "n_leaves", "repeated", "once"]
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, repeated long, once long, ends_sha256 string"
#: partial: key of a node to be merged with other shards' parts of it; open_parent: key of the partial parent, its conv_id not yet known.
SWEPT = f"shard int, {NODE}, partial binary, open_parent binary"


def conversation_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns (id as hex digits, words) of rows (conv_id, turn, role, text), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length parts it from the text
    name = F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * ID)
    turns = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), name.alias("id"), word_count("text").alias("words")).alias("t"))
    # sorting structs puts null first
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """convs, each beginning with the first h turns of conversation conv_id - conv_id % every in place of its own first h; h = crc32 of its id, modulo most."""
    heads = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")
    given = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    return joined.select("conv_id", F.concat(given, own).alias("turns"))


class Joined:
    """SHA-256 of one path's parts, comma-joined."""

    def __init__(self, key: Any):
        self.key, self.hash = key, None

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        if self.hash is None:
            self.hash = hashlib.sha256()
        else:
            self.hash.update(b",")
        self.hash.update(row["ids"].encode())
        return []

    def end(self) -> list[dict[str, Any]]:
        return [{"key": self.key, "ends": self.hash.hexdigest()}]


def distinct_paths(convs: DataFrame, block: int = 4096) -> DataFrame:
    """path, words, conv_id (smallest), n, ends_sha256 of each distinct sequence of turns in convs (conv_id, turns).

    Ids are joined in blocks of so many numbers first, so that a path that many conversations have is many groups; only its
    joined blocks pass through one hash, streamed, as a digest of one string must be made in order.
    """
    paths = durable(convs.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.words").alias("words")))
    keyed = paths.select("conv_id", F.unhex(F.sha2("path", 256)).alias("key"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = keyed.groupBy("key", F.floor(F.col("conv_id") / block).alias("block")).agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), ids.alias("ids"))
    blocks = durable(blocks.withColumn("one", F.sha2("ids", 256)))
    groups = durable(blocks.groupBy("key").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("one").alias("one")))
    several = blocks.join(groups.filter("blocks > 1").select("key"), "key", "left_semi").select("key", "block", "ids")
    joined = fold_by_key(several, "key", ["block"], Joined, "key binary, ends string")
    ends = groups.join(joined, "key", "left").select("conv_id", "n", F.coalesce("ends", "one").alias("ends_sha256"))
    return paths.join(ends, "conv_id")


class BurstTrie:
    """Rows with a path, under heads that branch by the next turn id, in containers of bounded size."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.root: dict[bytes, dict | list] = {}  # a head: next id to head or container; b"" to the row that ends there

    def add(self, path: bytes, row: Any) -> None:
        head, at = self.root, 0
        while isinstance(below := head.get(path[at : at + ID]), dict):
            head, at = below, at + ID
        container = head.setdefault(path[at : at + ID], [])
        container.append((path, row))
        if len(container) > self.capacity:
            self._burst(head, path[at : at + ID], at + ID)

    def _burst(self, head: dict, name: bytes, at: int) -> None:
        """Puts a head in place of a container, and one below it as long as one container is still too large."""
        while len(held := head[name]) > self.capacity:
            below: dict[bytes, dict | list] = {}
            for path, row in held:
                below.setdefault(path[at : at + ID], []).append((path, row))
            head[name] = below
            head, name, at = below, max(below, key=lambda k: len(below[k])), at + ID

    def in_order(self) -> Iterator[Any]:
        """All rows by path: heads by id, each container sorted."""
        waiting: list[dict | list] = [self.root]
        while waiting:
            top = waiting.pop()
            if isinstance(top, dict):
                waiting += [top[k] for k in sorted(top, reverse=True)]
            else:
                yield from (row for _, row in sorted(top, key=lambda x: x[0]))


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two paths begin with alike."""
    n = min(len(a), len(b)) // ID
    if a[: n * ID] == b[: n * ID]:
        return n
    low, high = 0, n  # the first low turns are alike, the first high ones are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[: middle * ID] == b[: middle * ID]:
            low = middle
        else:
            high = middle
    return low


class Sweep:
    """Nodes of one shard's paths, given in order, after the last path of the shard before (None in the first)."""

    def __init__(self, shard: int, before: bytes | None):
        self.shard, self.last = shard, before
        self.open: list[dict[str, Any]] = []  # nodes from the root to the last path's end
        self.closed: list[dict[str, Any]] = []

    def _begin(self, words: int, here: bool) -> None:
        node = {"shard": self.shard, "conv_id": None, "depth": len(self.open), "words": words, "here": here, "ends_sha256": None, "parent": None}
        node |= {"n_convs": 0, "n_children": 0, "n_leaves": 0, "repeated": 0, "once": words if here else 0}
        if self.open:
            node["parent"] = self.open[-1]
            self.open[-1]["n_children"] += here
        self.open.append(node)

    def _close(self) -> None:
        """The deepest open node adds its sums, and its smallest member, to its parent."""
        node = self.open.pop()
        node["repeated"] += node["n_convs"] * node["words"]
        if up := node["parent"]:
            for k in ("n_convs", "n_leaves", "repeated", "once"):
                up[k] += node[k]
            up["conv_id"] = min((c for c in (up["conv_id"], node["conv_id"]) if c is not None), default=None)
        self.closed.append(node)

    def step(self, path: bytes, words: list[int], conv_id: int, n: int, ends: str) -> None:
        depth = len(path) // ID
        shared = 0 if self.last is None else shared_turns(self.last, path)
        if not self.open:  # what the shard before has open goes on, or the root begins
            for d in range(shared + 1):
                self._begin(words[d - 1] if d else 0, self.last is None)
            self.first = path
        while len(self.open) > shared + 1:
            self._close()
        if self.last is not None and shared == len(self.last) // ID:
            self.open[-1]["n_leaves"] -= 1  # the path before ends at a node that goes on
        for d in range(shared, depth):
            self._begin(words[d], True)
        top = self.open[-1]
        top["n_convs"] += n
        top["n_leaves"] += 1
        top["ends_sha256"] = ends
        top["conv_id"] = conv_id if top["conv_id"] is None else min(conv_id, top["conv_id"])
        self.last = path

    def rows(self) -> list[dict[str, Any]]:
        """Rows with SWEPT's columns, once all paths are given; sums of partial ones are this shard's."""
        for key, node in zip(prefix_keys(self.last, len(self.open)), self.open):
            node["partial"] = key
        early = [x for x in self.closed if not x["here"]]
        names = prefix_keys(self.first, max((x["depth"] + 1 for x in early), default=0))
        for node in early:
            node["partial"] = names[node["depth"]]
        while self.open:
            self._close()
        out = []
        for node in self.closed:
            row = {"partial": None, **node, "parent_conv_id": None, "open_parent": None}
            if up := row.pop("parent"):
                row["open_parent"] = up.get("partial")
                row["parent_conv_id"] = None if row["open_parent"] else up["conv_id"]
            out.append(row)
        return out


def prefix_keys(path: bytes, n: int) -> list[bytes]:
    """SHA-256 of a path's first n prefixes, from the empty one on."""
    so_far, keys = hashlib.sha256(), []
    for d in range(n):
        if d:
            so_far.update(path[(d - 1) * ID : d * ID])
        keys.append(so_far.digest())
    return keys


def sweep_shards(paths: DataFrame, shard_turns: int = 32768, capacity: int = 64) -> DataFrame:
    """Rows of SWEPT, of distinct paths (path, words, conv_id, n, ends_sha256); about so many turns a shard."""
    total = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    dealt = paths.select("path", "words", "conv_id", "n", "ends_sha256").repartitionByRange(max(1, -(-total // shard_turns)), "path")
    dealt = durable(dealt.withColumn("shard", F.spark_partition_id()))
    # one row a shard: its last path is told to the next shard that has any
    lasts = dealt.groupBy("shard").agg(F.max("path").alias("path"))
    told = lasts.withColumn("path", F.lag("path").over(W.orderBy("shard"))).filter("path IS NOT NULL")

    kinds = to_arrow_schema(StructType.fromDDL(SWEPT))

    def sweep(table: pa.Table) -> pa.Table:
        trie, here, root = BurstTrie(capacity), None, None
        for row in table.to_pylist():
            if row["n"] is None:
                here = row["path"]
            elif row["path"]:
                trie.add(row["path"], row)
            else:
                root = row
        nodes = Sweep(table.column("shard")[0].as_py(), here)
        for row in itertools.chain([root] if root else [], trie.in_order()):
            nodes.step(row["path"], row["words"], row["conv_id"], row["n"], row["ends_sha256"])
        return pa.Table.from_pylist(nodes.rows(), kinds)

    return dealt.unionByName(told, allowMissingColumns=True).groupBy("shard").applyInArrow(sweep, SWEPT)


def trie_nodes(convs: DataFrame, shard_turns: int = 32768, capacity: int = 64) -> DataFrame:
    """Nodes of the conversations' trie (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens: words that n_convs - 1 members need not hold again, over the node's subtree. capacity: paths a container holds.
    """
    swept = durable(sweep_shards(distinct_paths(convs), shard_turns, capacity))
    parts = swept.filter("partial IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in SUMS]
    merged = durable(parts.groupBy("partial").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("open_parent").alias("open_parent")))
    ids = merged.select(F.col("partial").alias("open_parent"), F.col("conv_id").alias("up"))
    # a shard's nodes meet the partial parents of that shard alone, so no parent gathers more rows than a shard has
    local = parts.select("shard", F.col("partial").alias("open_parent")).join(ids, "open_parent")
    complete = swept.filter("partial IS NULL").join(local, ["shard", "open_parent"], "left").withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id"))
    crossing = merged.join(ids, "open_parent", "left").withColumn("parent_conv_id", F.col("up"))
    names = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("repeated") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return complete.select(names).unionByName(crossing.select(names))
