"""Near duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

* Documents with equal shingle sets are one *node*, so exact copies collapse before any join.
* Each node's shingle hashes fall into ``BANDS * ROWS`` bins; a bin's value is its least hash. An empty bin
  borrows the value of the first filled bin in its own fixed random order of bins (for any two sets
  the borrowed bins agree as often as the sets do). ``ROWS`` bins make a band, a band's hash a bucket.
  At a similarity of 0.8 a pair misses all 40 buckets with a chance of (1 - 0.8^6)^40 = 5e-6.
* In each bucket, every node is compared with one centre only: pairs grow with the members, not
  with their square. A second star takes the best-linked member as the centre and looks only at buckets whose
  members are in more than one component.
* A star may miss a link between two non-centres. So the members that are still outside their bucket's main
  component meet all of its members, on the full sets, in blocks; only links leave a block. (Copies
  of one original have met in its component by then, so few members are outside.) Before that, nodes are left out that
  cannot link to another component: a link needs ``percent`` of a node's shingles, so too few of them found in any other
  component rule it out. That is one count by shingle, whatever the size of a bucket, and clears texts that share a template.
* Every link is confirmed on the full sets: 100 * intersection >= ``percent`` * union.

Definitions. Words are separated by ASCII white space, A-Z lower-cased; a set holds the distinct
``width``-word windows, or the whole sequence where there are fewer words. Null, empty and blank texts
have no set and link with nothing. A component's id is its least doc_id (nulls aside; a document
with a null doc_id and no other in its component gets null). Repeated rows are copies of each other. Texts of any length
are hashed whole; a set is one row of 8 bytes a shingle. ``near_dups`` reads doc_id and text only and ``keep_one`` renames the
other columns while it works, so names cannot clash. Empty tables give empty results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.llm.common import TO_LOWER, salted_join, shuffle_partitions, stored
from critica.llm.word_hash import WordHashes, combine, windows

BANDS = 40
ROWS = 6
BINS = BANDS * ROWS
PART = 512
BORROW = np.random.Generator(np.random.PCG64(20240229)).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = hashes.of((text or "").encode().translate(TO_LOWER).split())
    return np.unique(windows(h, min(width, len(h)))) if len(h) else h


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; empty bins densified. ``shingles`` is sorted and not empty."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    used, first = np.unique(bins, return_index=True)
    used = used.astype(np.int64)
    values = np.zeros(BINS, np.uint64)
    values[used] = shingles[first]
    filled = np.zeros(BINS, bool)
    filled[used] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = BORROW[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return values


def band_hashes(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = combine(out, rows[:, j])
    return out.astype(np.int64)


def _features(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, nodes, bands = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width, hashes)
                n.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_hashes(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()),
                 pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n", "node", "bands"])
    return run


def _sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "shingles"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the least node of its component.

    Each round takes the least label among neighbours, then the label's own label, until
    nothing changes; every round is a written table."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(salted_join(met, up, "label", "node").select("node", "old", F.least("label", "up").alias("label")), "labels")
        if new.filter("old != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more (stored) links between their components, and between nodes that had none."""
    if links.isEmpty():
        return labels
    named = lambda end: links.select(F.col(end).alias("node")).join(labels, "node", "left").select(
        F.col("node").alias(end), F.coalesce("label", "node").alias(f"{end}_label")).distinct()
    between = stored(links.join(named("a"), "a").join(named("b"), "b").select(
        F.col("a_label").alias("a"), F.col("b_label").alias("b")).filter("a != b").distinct(), "between")
    up = components(between).select(F.col("node").alias("label"), F.col("label").alias("up"))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(fresh.withColumn("label", F.col("node")))
    return stored(salted_join(every, up, "label", "node", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored ``pairs`` (a, b, n_a, n_b) with ``linked``: the full sets meet the similarity."""
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    common = F.size(F.array_intersect("left", "right"))
    joined = pairs.filter(fits).join(right, "b").join(left, "a")
    return stored(joined.select("a", "b", (common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).alias("linked")),
                  "checked")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored (bucket, node, n, label, main, members, outside) of the buckets with members of more than one component:
    the commonest component, the number of members, and of those outside it."""
    return sized(buckets.select("bucket", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def sized(now: DataFrame) -> DataFrame:
    """``open_buckets`` of (bucket, node, n, label)."""
    many = (now.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(
        F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("members"), F.count("*").alias("labels")).filter("labels > 1")
        .select("bucket", F.col("top.label").alias("main"), "members", (F.col("members") - F.col("top.c")).alias("outside")))
    return stored(now.join(many, "bucket"), "open")


def able_to_link(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``open_`` (bucket, node, n, label) without the nodes whose shingles are too seldom found in other components.

    Nodes and labels are counted as 64-bit hashes: two nodes under one hash add up, which leaves out less."""
    who = stored(open_.groupBy("node").agg(F.first("n").alias("n"), F.xxhash64(F.first("label")).alias("x")), "who")
    rows = who.join(sets, "node").select(F.xxhash64("node").alias("at"), "x", F.explode("shingles").alias("s"))
    several = rows.groupBy("s").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a != b").select("s")
    able = rows.select("at", "s").join(several, "s").groupBy("at").agg(F.count("*").alias("c"))
    fits = who.withColumn("at", F.xxhash64("node")).join(able, "at").filter(F.col("c") * 100 >= F.col("n") * percent)
    return open_.select("bucket", "node", "n", "label").join(fits.select("node"), "node", "left_semi")


def _cross_links(asked: list[dict], members: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links of the asked rows to members of other components: the first linked member of each."""
    sets = [np.asarray(m["shingles"], np.int64) for m in members]
    n = np.array([len(x) for x in sets])
    labels, which = np.unique(np.array([m["label"] for m in members], dtype=object), return_inverse=True)
    number = {label: i for i, label in enumerate(labels)}
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    found = []
    for x in asked:
        own = np.asarray(x["shingles"], np.int64)
        lo, hi = np.searchsorted(element, own, "left"), np.searchsorted(element, own, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size)
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((common * 100 >= (n + len(own) - common) * percent) & (which != number.get(x["label"], -1)))
        found += [(x["node"], members[near[i]]["node"]) for i in np.unique(which[near], return_index=True)[1]]
    return found


def _compare(percent: int):
    """Rows arrive sorted by block (bucket, part, chunk): one block after the other in memory."""
    def close(rows):
        asked, members = ([r for r in rows if r["asks"] == a] for a in (True, False))
        ends = [sorted(e) for e in _cross_links(asked, members, percent)] if asked and members else []
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        block, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["bucket"], r["part"], r["chunk"])
                if key != block and rows:
                    yield close(rows)
                    rows = []
                block = key
                rows.append(r)
        if rows:
            yield close(rows)
    return run


def rest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored links (a, b) between members of a bucket in different components.

    Members outside a bucket's main component (chunks of about ``PART``) meet all of its members (parts of
    about ``PART``) on their full sets, a block a pair of chunk and part. Only links leave a block, one for an
    outside member and component."""
    count = lambda c: F.ceil(F.col(c) / PART).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("node", "bucket"), count(c)).cast("int")
    members = open_.select("bucket", "node", "label", place("members").alias("part"), every("outside").alias("chunk"), F.lit(False).alias("asks"))
    asked = open_.filter("label != main").select(
        "bucket", "node", "label", every("members").alias("part"), place("outside").alias("chunk"), F.lit(True).alias("asks"))
    block = ["bucket", "part", "chunk"]
    rows = (members.unionByName(asked).join(sets, "node").repartition(shuffle_partitions(open_.sparkSession), *block)
            .sortWithinPartitions(*block))
    found = rows.select(*block, "asks", "node", "label", "shingles").mapInArrow(_compare(percent), "a binary, b binary")
    return stored(found.distinct(), "links")


def link(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, node, label): one row per input row; ``label`` names the component (null without a set)."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    feats = stored(docs.mapInArrow(
        _features(width), "doc_id long, text_hash long, n long, node binary, bands array<long>"), "features")
    nodes = feats.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    members = stored(nodes.select("node", "rep", "n", F.explode("bands").alias("bucket")), "bands")
    crowded = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("center")).filter("c > 1").drop("c")
    buckets = stored(members.join(crowded, "bucket"), "buckets")
    near = buckets.groupBy("node").agg(F.first("rep").alias("rep"))
    texts = docs.join(near.select("node", "rep"), F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))
                      & F.col("text_hash").eqNullSafe(F.col("rep.text_hash")))
    sets = stored(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(
        _sets(width), "node binary, shingles array<long>"), "sets")
    size = buckets.select("node", "n").distinct()

    def with_sizes(pairs: DataFrame) -> DataFrame:
        return (pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
                .join(size.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b"))

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    checked = confirm(with_sizes(buckets.filter("node != center").select(*ordered("node", "center")).distinct()), sets, percent)
    labels = components(checked.filter("linked"))
    links = checked.filter("linked").select("a", "b")
    # once more around the best-linked member of each bucket that is not yet in one component
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    now = open_buckets(buckets, labels)
    center = now.join(degree, "node", "left").groupBy("bucket").agg(
        F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "label")).alias("top"))
    pairs = now.join(center, "bucket").filter(F.col("label") != F.col("top.label")).select(
        *ordered(F.col("node"), F.col("top.node"))).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    labels = merged(labels, confirm(with_sizes(pairs), sets, percent).filter("linked").select("a", "b"))
    left = sized(able_to_link(open_buckets(buckets, labels), sets, percent))
    labels = merged(labels, rest(left, sets, percent))
    return feats.select("doc_id", "text_hash", "n", "node").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))


def near_dups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, label, n_shingles, component_id, kept: one row per input row."""
    linked = link(docs, width, percent)
    least = linked.filter("label is not null").groupBy("label").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    out = salted_join(linked, least, "label", "text_hash", "left").withColumn("component_id", F.coalesce("least_id", "doc_id"))
    return out.select("doc_id", "text_hash", "label", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input's columns: one document of each component, and every document without a set."""
    found = near_dups(docs, width, percent).filter("kept")
    alone = found.filter("label is null").select("doc_id", "text_hash").distinct()
    one = found.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(
        "k.doc_id", "k.text_hash")
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)],
                        F.col("doc_id").alias("kd"), F.xxhash64("text").alias("kt"))
    match = F.col("kd").eqNullSafe(F.col("doc_id")) & (F.col("kt") == F.col("text_hash"))
    rows = (keyed.join(one, match, "left_semi").dropDuplicates(["kd", "kt"])
            .unionByName(keyed.join(alone, match, "left_semi")))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4(docs: DataFrame) -> DataFrame:
    return near_dups(docs.select("doc_id", "text"), width=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")
