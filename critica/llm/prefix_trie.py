"""The prefix trie of conversations, by range-partitioned shards and a skeleton of their splitters.

A conversation is a path: 16 bytes of SHA-256 for each turn (role, text), so paths sort as byte strings and the members of a
trie node are neighbours.

1. Paths are range-partitioned by (path, conv_id) and stored with their shard. Copies of one conversation, however
   many, spread over shards by conv_id.
2. The skeleton is the trie of the splitter paths: each shard's first path as far as it agrees with the last
   path before it. A shard meets it only on its own first and last path, so what is broadcast is two depths a
   shard (``opens``, ``closes``): 16 bytes a shard, whatever the data.
3. Each shard walks its sorted paths once with a stack of the open nodes that two neighbours share. A node that is not
   in the skeleton has all of its members in the shard: it is final when it closes. What lies below the last shared
   node of a path has one member and a closed form; it leaves the walk as one row (a *tail*).
4. Skeleton nodes leave partial aggregates (members, children, leaves, savings, the ids that end there in chunks),
   which are reduced by key. What skeleton nodes add to their own ancestors is a running sum along each splitter
   path. Children of skeleton nodes look up their parent's smallest member in the reduced skeleton.

The ids that end at a skeleton node come in shard order, hence ascending; they are hashed as a stream of chunks.

Memory: a path has 20 bytes a turn and is one row, a shard's walk holds the open nodes and the finished children of the
open nodes only. Rows with a null conv_id belong to no conversation and are left out; null roles and texts are
empty; equal turn numbers are ordered by role, then by digest; a repeated row is one more turn. Very long texts are only hashed.
An empty table has no nodes. Other columns are not read, so clashing names do not arise."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critica.llm.common import salted_join, shuffle_partitions, stored

WIDTH = 16               # bytes of a turn's digest
CHUNK_BYTES = 1 << 20    # ids that end at a skeleton node, a row
BROADCAST_NODES = 200_000
ROWS = 10_000            # rows of one Arrow batch
TURN = "struct<turn: bigint, role: string, key: binary, size: int>"
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- conversations as paths ----------------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as (turn, role, digest, UTF-8 bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"),
                    F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH)).alias("key"),
                    F.octet_length(text).cast("int").alias("size"))
    return (conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def paths(listed: DataFrame) -> DataFrame:
    """conv_id, path, sizes of (conv_id, turns)."""
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
                         F.transform("turns", lambda t: t["size"]).alias("sizes"))


def grafted(listed: DataFrame, step: int, heads: Column) -> DataFrame:
    """Each conversation c with its first ``heads`` (at most 8) turns taken from conversation c - c % step."""
    first = listed.filter(F.col("conv_id") % step == 0).select(
        F.col("conv_id").alias("__base"), F.slice("turns", 1, 8).alias("__head"))
    none = F.array().cast(f"array<{TURN}>")
    own = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return (listed.withColumn("__base", F.col("conv_id") - F.col("conv_id") % step).withColumn("__h", heads.cast("int"))
            .join(first, "__base", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("__head", none), F.lit(1), F.col("__h")), own).alias("turns")))


# --- shards --------------------------------------------------------------------------------------------

def shared(a: bytes, b: bytes) -> int:
    """The turns in which two paths agree from the start."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    x, y = (np.frombuffer(p, "S1", n * WIDTH) for p in (a, b))
    return int(np.argmax(x != y)) // WIDTH


def edges(shards: DataFrame) -> DataFrame:
    """shard, opens, closes: how deep a shard's first (last) path is shared with the shard before (after). One row a shard."""
    def run(batches):
        held = None  # (shard, last path, opens)
        out = []
        for b in batches:
            for shard, first, last in zip(*(c.to_pylist() for c in b.columns)):
                opens = shared(held[1], first) if held else 0
                if held:
                    out.append((held[0], held[2], opens))
                held = shard, last, opens
        if held:
            out.append((held[0], held[2], 0))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in (zip(*out) if out else [()] * 3)],
                                         ["shard", "opens", "closes"])

    ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    return ends.coalesce(1).sortWithinPartitions("shard").mapInArrow(run, "shard int, opens int, closes int")


FINAL, TAIL, PART, ENDS = range(4)
WALK = [("kind", "int", pa.int32()), ("shard", "int", pa.int32()), ("key", "binary", pa.binary()), ("parent_key", "binary", pa.binary()),
        ("parent_conv_id", "long", pa.int64()), ("conv_id", "long", pa.int64()), ("depth", "long", pa.int64()),
        ("until", "long", pa.int64()), ("n_convs", "long", pa.int64()), ("n_children", "long", pa.int64()),
        ("n_leaves", "long", pa.int64()), ("saved", "long", pa.int64()), ("size", "long", pa.int64()), ("ends", "string", pa.string())]
WALK_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in WALK)


class Node:
    """An open node. ``key`` is set for skeleton nodes, ``opened`` for those on the shard's splitter path; ``waiting`` holds
    finished children that lack the parent's id."""

    __slots__ = ("key", "least", "convs", "children", "leaves", "saved", "size", "ends", "listed", "waiting", "opened")

    def __init__(self, key: bytes | None, size: int, opened: bool = False):
        self.key, self.size, self.opened, self.least = key, size, opened, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends, self.listed, self.waiting = None, [], []


class Walk:
    """One shard: ``path`` for each sorted path, then ``close``; ``rows`` holds what is ready (WALK columns)."""

    def __init__(self, shard: int, opens: int, closes: int, rows: list):
        self.shard, self.opens, self.closes, self.rows = shard, opens, closes, rows
        self.stack: list[Node] = []
        self.held = None  # (conv_id, path, sizes, turns shared with the path before)
        self.chunks = 0

    def path(self, conv_id: int, path: bytes, sizes: np.ndarray) -> None:
        if self.held is None:
            before = self.opens
        else:
            before = shared(self.held[1], path)
            self._place(*self.held, before, 0)
        self.held = conv_id, path, sizes, before

    def close(self) -> None:
        if self.held:
            self._place(*self.held, self.closes, self.closes)
            self._pop(0)

    def _place(self, conv_id: int, path: bytes, sizes: np.ndarray, before: int, after: int, closes: int) -> None:
        """Enter one path: nodes that it shares with a neighbour are opened, the rest is its tail."""
        depth, length = max(before, after), len(path) // WIDTH
        first = not self.stack
        skeleton = max(self.opens if first else 0, closes)
        if skeleton or first:
            digest = hashlib.sha256()
            for d in range(skeleton + 1):
                digest.update(path[(d - 1) * WIDTH:d * WIDTH] if d else b"")
                if d == len(self.stack):
                    self.stack.append(Node(digest.digest()[:WIDTH], int(sizes[d - 1]) if d else 0, first and d <= self.opens))
                elif self.stack[d].key is None:
                    self._skeleton(d, digest.digest()[:WIDTH])
        for d in range(len(self.stack), depth + 1):
            self.stack.append(Node(None, int(sizes[d - 1])))
        top = self.stack[-1]
        top.convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        if length == depth:
            self._end(top, conv_id)
        else:
            top.children += 1
            top.leaves += 1
            self._child(top, [TAIL, self.shard, None, None, None, conv_id, depth + 1, length, 1, None, 1, 0, None, None])
        self._pop(after + 1)

    def _skeleton(self, depth: int, key: bytes) -> None:
        """An open node turns out to reach into the next shard."""
        node = self.stack[depth]
        node.key = key
        for row in node.waiting:
            row[3] = key
        self.rows += node.waiting
        node.waiting = []
        for text in node.ends or ():
            self._chunk(node, text)

    def _end(self, node: Node, conv_id: int) -> None:
        node.listed.append(str(conv_id))
        if len(node.listed) * 8 > CHUNK_BYTES:
            self._flush(node)

    def _flush(self, node: Node) -> None:
        text, node.listed = ",".join(node.listed), []
        if node.key is not None:
            self._chunk(node, text)
        elif node.ends is None:
            node.ends = [text]
        else:
            node.ends.append(text)

    def _chunk(self, node: Node, text: str) -> None:
        self.rows.append([ENDS, self.shard, node.key, None, None, None, self.chunks, None, None, None, None, None, None, text])
        self.chunks += 1

    def _child(self, parent: Node, row: list) -> None:
        if parent.key is None:
            parent.waiting.append(row)
        else:
            row[3] = parent.key
            self.rows.append(row)

    def _pop(self, keep: int) -> None:
        """Close open nodes until ``keep`` are left."""
        while len(self.stack) > keep:
            node = self.stack.pop()
            parent = self.stack[-1] if self.stack else None
            depth = len(self.stack)
            if node.key is None:
                node.leaves += not node.children
                node.saved += (node.convs - 1) * node.size
                ends = hashlib.sha256(",".join([*(node.ends or ()), *([",".join(node.listed)] if node.listed else ())]).encode())
                for row in node.waiting:
                    row[4] = node.least
                self.rows += node.waiting
                parent.children += 1
                self._child(parent, [FINAL, self.shard, None, None, None, node.least, depth, None, node.convs, node.children,
                                     node.leaves, node.saved, None, ends.hexdigest()])
            else:
                if node.listed:
                    self._flush(node)
                self.rows.append([PART, self.shard, node.key, parent.key if parent else None, None, node.least, depth,
                                  int(node.opened), node.convs, node.children, node.leaves, node.saved, node.size, None])
            if parent:
                parent.convs += node.convs
                parent.leaves += node.leaves
                parent.saved += node.saved
                if node.least is not None:
                    parent.least = node.least if parent.least is None else min(parent.least, node.least)


def _batch(rows: list) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(WALK)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, _, t) in zip(cols, WALK)], [n for n, _, _ in WALK])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards sorted by (shard, path, conv_id): shard, opens, closes, conv_id, path, sizes."""
    now, rows = None, []
    for b in batches:
        shards, opens, closes, ids, keys = (b.column(i).to_pylist() for i in range(5))
        sizes = b.column(5)
        values, at = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_numpy()
        for i, shard in enumerate(shards):
            if now is None or now.shard != shard:
                if now:
                    now.close()
                now = Walk(shard, opens[i], closes[i], rows)
            now.path(ids[i], keys[i], values[at[i]:at[i + 1]])
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows.clear()
    if now:
        now.close()
    yield _batch(rows)


# --- the skeleton --------------------------------------------------------------------------------------

def _hash_chunks(batches):
    key, digest, out = None, None, []
    for b in batches:
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if key is not None:
        out.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())],
                                     ["key", "ends_sha256"])


def skeleton(walked: DataFrame) -> DataFrame:
    """key and node columns of the skeleton's nodes, from the shards' partial aggregates."""
    parts = walked.filter(F.col("kind") == PART)
    total = parts.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    below = total.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("__below"))
    total = total.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("__below", F.lit(0)))
    own = total.select("key", (F.col("n_children") == 0).cast("long").alias("__leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("__saved"))
    # Splitter paths: a node counts on the first of them that holds it, for itself and for all nodes above it there.
    on = parts.filter(F.col("until") == 1).select("shard", "depth", "key")
    home = on.groupBy("key").agg(F.min("shard").alias("__home"))
    down = Window.partitionBy("shard").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at_home = F.col("shard") == F.col("__home")
    added = on.join(home, "key").join(own, "key").select(
        "key", *[F.sum(F.when(at_home, F.col(c)).otherwise(F.lit(0))).over(down).alias(c) for c in ("__leaf", "__saved")])
    added = added.groupBy("key").agg(F.sum("__leaf").alias("__leaf"), F.sum("__saved").alias("__saved"))
    ends = (walked.filter(F.col("kind") == ENDS).select("key", "shard", "depth", "ends").repartition("key")
            .sortWithinPartitions("key", "shard", "depth").mapInArrow(_hash_chunks, "key binary, ends_sha256 string"))
    parent = total.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (total.join(added, "key").join(ends, "key", "left").join(parent, "parent_key", "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("__leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("__saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def trie(listed: DataFrame) -> DataFrame:
    """The nodes (columns NODES) of conversations given as paths: conv_id (unique), path, sizes."""
    spark = listed.sparkSession
    shards = stored(listed.repartitionByRange("path", "conv_id").withColumn("shard", F.spark_partition_id()), "trie_shards")
    walked = stored(
        shards.join(F.broadcast(edges(shards)), "shard").select("shard", "opens", "closes", "conv_id", "path", "sizes")
        .repartitionById(shuffle_partitions(spark), F.col("shard"))
        .sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walk, WALK_SCHEMA), "trie_walk")
    frame = stored(skeleton(walked), "trie_skeleton")
    rows = walked.filter(F.col("kind") <= TAIL).drop("key")
    parent = frame.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    if frame.count() <= BROADCAST_NODES:
        rows = rows.join(F.broadcast(parent), "parent_key", "left")
    else:
        rows = salted_join(rows, parent, "parent_key", "conv_id", "left")
    rows = rows.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__parent"))
    final = rows.filter(F.col("kind") == FINAL).withColumnRenamed("saved", "saved_tokens").withColumnRenamed("ends", "ends_sha256")
    tails = rows.filter(F.col("kind") == TAIL).withColumn("__d", F.explode(F.sequence("depth", "until")))
    first, last = F.col("__d") == F.col("depth"), F.col("__d") == F.col("until")
    tails = tails.select(
        "conv_id", F.col("__d").alias("depth"), F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
    return final.select(*NODES).unionByName(tails).unionByName(frame.select(*NODES))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a conversation table as it is."""
    return trie(paths(turns(conversations)))


def op13(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after each took its first turns from its base conversation."""
    listed = stored(turns(conversations), "trie_turns")
    return trie(paths(grafted(listed, 5, F.crc32(F.col("conv_id").cast("string")) % 9)))
